"""Queries over parkings, roads, regions and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators import spatial, terrain
from ridgeline.plans.registry import PARKING, ROAD, SIDE, cells_sql, registry
from ridgeline.sources.fixtures import cells, parkings, roads

QUERIES, ORACLE_SQL, query = registry()
D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"
SUMMIT = f"""{cells_sql()}, pv AS (SELECT *, max(z) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS h, min(z) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS l FROM cell),
pw AS (SELECT r, c, z, max(h) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS high, min(l) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS low FROM pv),
summit AS MATERIALIZED (SELECT 's' || r || '_' || c AS summit, c*10e0+5 AS x, r*10e0+5 AS y FROM pw WHERE z = high AND z >= 900 AND z - low >= 100)"""


def summits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = terrain.peaks(cells(spark, sf_dir), window=30, relief=100)
    return found.select(F.concat_ws("_", F.concat(F.lit("s"), "r"), "c").alias("summit"), (F.col("c") * 10.0 + 5).alias("x"), (F.col("r") * 10.0 + 5).alias("y"))


@query(f"WITH {SIDE}, {PARKING}, {ROAD}, k AS (SELECT a.parking, b.road, {D} AS d, row_number() OVER (PARTITION BY a.parking ORDER BY {D}, b.road) AS i FROM parking a, road b) SELECT parking, road, round(d, 4) AS distance FROM k WHERE i = 1")
def nearest_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.nearest(parkings(spark, sf_dir), roads(spark, sf_dir), "parking", "road", 80.0)
    return out.select("parking", F.col("nearest_road").alias("road"), F.round("distance", 4).alias("distance"))


@query(f"""WITH {SIDE}, {PARKING}, {ROAD}, k AS (SELECT a.parking, b.class, b.closed, row_number() OVER (PARTITION BY a.parking ORDER BY {D}, b.road) AS i FROM parking a, road b WHERE {D} <= 80)
SELECT p.parking, k.class AS road, CASE WHEN k.closed THEN 'closed' WHEN k.class IN ('BUILDING', 'MACHINERY') THEN 'plowed' ELSE 'unknown' END AS status FROM parking p LEFT JOIN k ON k.parking = p.parking AND i = 1
WHERE coalesce(p.access, '') NOT IN ('private', 'no', 'customers') AND coalesce(k.class, '') <> 'HOUSEHOLD'""")
def parking_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.within(parkings(spark, sf_dir), roads(spark, sf_dir), 80.0)
    best = near.groupBy("l.parking").agg(F.min(F.struct("d", "r.road", "r.class", "r.closed")).alias("best"))
    out = parkings(spark, sf_dir).join(best, "parking", "left").select("parking", "access", F.col("best.class").alias("road"), F.col("best.closed").alias("closed"))
    public = ~F.coalesce("access", F.lit("")).isin("private", "no", "customers") & (F.coalesce("road", F.lit("")) != "HOUSEHOLD")
    status = F.when(F.col("closed"), "closed").when(F.col("road").isin("BUILDING", "MACHINERY"), "plowed").otherwise("unknown")
    return out.where(public).select("parking", "road", status.alias("status"))


@query(f"WITH {SIDE}, {PARKING}, {ROAD} SELECT road FROM road a WHERE NOT EXISTS (SELECT 1 FROM parking b WHERE {D} <= 60)")
def anti_dedupe_60m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.apart_from(roads(spark, sf_dir), parkings(spark, sf_dir), "road", 60.0).select("road")


@query(f"WITH {SUMMIT}, {PARKING}, k AS (SELECT a.summit, b.parking, {D} AS d, row_number() OVER (PARTITION BY a.summit ORDER BY {D}, b.parking) AS i FROM summit a, parking b WHERE {D} <= 700) SELECT summit, parking, i::INT AS rank, round(d, 4) AS distance FROM k WHERE i <= 4")
def knn_parkings(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.within(summits(spark, sf_dir), parkings(spark, sf_dir), 700.0).select("l.summit", "r.parking", "d")
    rank = F.row_number().over(Window.partitionBy("summit").orderBy("d", "parking"))
    return near.withColumn("rank", rank).where("rank <= 4").select("summit", "parking", "rank", F.round("d", 4).alias("distance"))


@query(f"WITH {SIDE}, {PARKING} SELECT a.parking AS one, b.parking AS other, round({D}, 4) AS distance FROM parking a JOIN parking b ON a.parking < b.parking AND {D} <= 60")
def radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parkings(spark, sf_dir)
    near = spatial.within(p, p, 60.0).where(F.col("l.parking") < F.col("r.parking"))
    return near.select(F.col("l.parking").alias("one"), F.col("r.parking").alias("other"), F.round("d", 4).alias("distance"))


#: Blocks of 28 km on a lattice through (24000, 12000).
BLOCK, BLOCK_X, BLOCK_Y = 28000, 24000, 12000


def lattice(radius: float) -> tuple[F.Column, F.Column]:
    low = lambda v, o: F.floor((F.col(v) - radius - o) / BLOCK)
    high = lambda v, o: F.floor((F.col(v) + radius - o) / BLOCK)
    return F.sequence(low("x", BLOCK_X), high("x", BLOCK_X)), F.sequence(low("y", BLOCK_Y), high("y", BLOCK_Y))


def blocks_within(points: DataFrame, radius: float, square: bool = False, closed: bool = False) -> DataFrame:
    """points with every block (block_x, block_y) whose rectangle touches their circle or square, and dist_km.

    A block's upper edges are its own only if closed: then one that ends just radius before a point counts.
    """
    xs, ys = lattice(radius + 1.0 if closed else radius)  # a metre more than d below lets pass
    out = points.withColumn("_i", F.explode(xs)).withColumn("_j", F.explode(ys))
    out = out.select(*points.columns, (F.col("_i") * BLOCK + BLOCK_X).alias("block_x"), (F.col("_j") * BLOCK + BLOCK_Y).alias("block_y"))
    dx = F.greatest(F.col("block_x") - F.col("x"), F.lit(0.0), F.col("x") - F.col("block_x") - BLOCK)
    dy = F.greatest(F.col("block_y") - F.col("y"), F.lit(0.0), F.col("y") - F.col("block_y") - BLOCK)
    d = F.greatest(dx, dy) if square else F.sqrt(dx * dx + dy * dy)
    return out.withColumn("dist_km", F.round(d / 1000, 3)).where(d <= radius)


_BLOCKS = """(SELECT *, greatest(block_x - x, 0e0, x - block_x - 28000) AS dx, greatest(block_y - y, 0e0, y - block_y - 28000) AS dy FROM (SELECT *, i*28000+24000 AS block_x, j*28000+12000 AS block_y FROM
(SELECT *, unnest(range(floor((x-{r}-24000)/28000)::BIGINT, floor((x+{r}-24000)/28000)::BIGINT + 1)) AS i FROM {t}) q, LATERAL (SELECT unnest(range(floor((q.y-{r}-12000)/28000)::BIGINT, floor((q.y+{r}-12000)/28000)::BIGINT + 1)) AS j)))"""


@query(f"WITH p AS (SELECT n_nationkey AS region, n_nationkey*9000e0 AS x, n_nationkey*7000e0-50000 AS y FROM nation) SELECT region, block_x, block_y, round(sqrt(dx*dx+dy*dy)/1000, 3) AS dist_km FROM {_BLOCKS.format(r='60000', t='p')} WHERE sqrt(dx*dx+dy*dy) <= 60000")
def region_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.sources.tables import table

    points = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"), (F.col("n_nationkey") * 9000.0).alias("x"), (F.col("n_nationkey") * 7000.0 - 50000).alias("y"))
    return blocks_within(points, 60000.0).select("region", "block_x", "block_y", "dist_km")


@query(f"WITH {SIDE}, {PARKING}, far AS (SELECT parking, x*100 AS x, y*100 AS y FROM parking) SELECT DISTINCT block_x, block_y FROM {_BLOCKS.format(r='12000', t='far')} WHERE sqrt(dx*dx+dy*dy) <= 12000")
def approach_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = parkings(spark, sf_dir).select("parking", (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y"))
    return blocks_within(far, 12000.0).select("block_x", "block_y").distinct()


@query(f"""WITH {SIDE}, {PARKING}, far AS (SELECT parking, access, drive_min, x*100 AS x, y*100 AS y FROM parking),
q AS (SELECT *, CASE WHEN access IS NOT NULL THEN 'not_public' WHEN drive_min IS NULL THEN 'unknown' WHEN drive_min <= 120 THEN 'eligible' ELSE 'outside' END AS bucket FROM far WHERE sqrt((x-60000)*(x-60000)+(y-60000)*(y-60000)) <= 60000),
b AS (SELECT parking, bucket, count(*) AS blocks FROM {_BLOCKS.format(r='12000', t='q')} WHERE sqrt(dx*dx+dy*dy) <= 12000 GROUP BY ALL)
SELECT bucket, count(*) AS parkings, sum(blocks)::BIGINT AS block_visits FROM b GROUP BY bucket""")
def plan_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = parkings(spark, sf_dir).withColumns({"x": F.col("x") * 100, "y": F.col("y") * 100})
    dx, dy = F.col("x") - 60000, F.col("y") - 60000
    bucket = F.when(F.col("access").isNotNull(), "not_public").when(F.col("drive_min").isNull(), "unknown").when(F.col("drive_min") <= 120, "eligible").otherwise("outside")
    inside = far.where(F.sqrt(dx * dx + dy * dy) <= 60000).select("parking", "x", "y", bucket.alias("bucket"))
    each = blocks_within(inside, 12000.0).groupBy("parking", "bucket").agg(F.count(F.lit(1)).alias("blocks"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("parkings"), F.sum("blocks").alias("block_visits"))
