"""Queries that write and read back what the sinks make."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.plans.registry import PATH, registry
from ridgeline.sources import readers, sinks
from ridgeline.sources.fixtures import paths as points
from ridgeline.sources.scratch import shared_folder
from ridgeline.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH b AS (SELECT o_custkey % 5 AS block_x, o_custkey % 3 AS block_y, o_totalprice AS v FROM orders) SELECT block_x, block_y, count(*) AS legs, round(sum(v), 2) AS total FROM b WHERE NOT (block_x = 4 AND block_y = 2) GROUP BY ALL""")
def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan by block in two parts: the second finds the first's results and works the other blocks alone."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("block_x"), (F.col("o_custkey") % 3).alias("block_y"), F.col("o_totalprice").alias("v"))
    work = lambda open_: rows.join(open_, sinks.BLOCK).groupBy(*sinks.BLOCK).agg(F.count(F.lit(1)).alias("legs"), F.round(F.sum("v"), 2).alias("total"))
    blocks, path = rows.select(*sinks.BLOCK).distinct().where("NOT (block_x = 4 AND block_y = 2)"), _folder(spark, "block-scan")
    sinks.scan_blocks(blocks.where("block_x < 2"), work, path)
    return sinks.scan_blocks(blocks, work, path).select("block_x", "block_y", "legs", "total")


_LINES = f"""{PATH}, v AS (SELECT path, seq, round(9 + path/777e0 + seq/1333e0, 5) AS lon, round(z, 1) AS z, max(seq) OVER (PARTITION BY path) AS n FROM path), k AS (SELECT path, count(*) AS vertices, round(sum(lon), 4) AS lon_sum, round(sum(z), 1) AS z_sum FROM v WHERE path % 3 = 0 OR n <= 3 OR (seq - 1) % 2 = 0 OR seq = n GROUP BY path)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertex = F.struct((9 + F.col("path") / 777.0 + F.col("seq") / 1333.0).alias("lon"), (62 + F.col("seq") / 1000.0).alias("lat"), "z")
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", vertex.alias("p")))), lambda s: s["p"])
    each = points(spark, sf_dir).groupBy("path").agg(line.alias("line"))
    return each.select("path", F.concat(F.lit("leg"), "path").alias("key"), (F.col("path") % 7).alias("block"), F.when(F.col("path") % 3 == 0, "run").otherwise("leg").alias("kind"), "line")


@query(f"WITH {_LINES}, want AS (SELECT s_suppkey AS path FROM supplier) SELECT want.path, coalesce(vertices, 0) AS vertices, coalesce(lon_sum, 0) AS lon_sum, coalesce(z_sum, 0) AS z_sum FROM want LEFT JOIN k USING (path)")
def geometry_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines thinned, rounded, sharded by block, and joined to their rows again by key."""
    path = _folder(spark, "geometry")
    sinks.save_geometry(_lines(spark, sf_dir).drop("path"), path)
    want = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.concat(F.lit("leg"), "s_suppkey").alias("key"))
    total = lambda f: F.aggregate("line", F.lit(0.0), lambda a, p: a + p[f])
    return sinks.with_geometry(want, path).select("path", F.size("line").cast("long").alias("vertices"), F.round(total("lon"), 4).alias("lon_sum"), F.round(total("z"), 1).alias("z_sum"))


@query(f"""WITH {PATH}, n AS (SELECT path, count(*) AS vertices FROM path GROUP BY path), need AS (SELECT s_suppkey % 11 AS summit, s_suppkey AS path FROM supplier UNION SELECT s_suppkey % 11, s_suppkey + 1 FROM supplier)
SELECT summit, count(*) AS lines, sum(vertices)::BIGINT AS vertices FROM need JOIN n USING (path) GROUP BY summit""")
def summit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each summit the lines of all that it shows: of the ways to it, its runs, and the ways back from these."""
    s = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier")
    key = lambda k: supplier.select((s % 11).alias("summit"), F.concat(F.lit("leg"), k).alias("key"))
    shards = sinks.summit_shards(key(s).unionByName(key(s + 1)), _lines(spark, sf_dir))
    vertices = F.aggregate(F.map_values("lines"), F.lit(0).cast("long"), lambda a, x: a + F.size(x))
    return shards.select("summit", F.size("lines").cast("long").alias("lines"), vertices.alias("vertices"))


@query(f"WITH {PATH}, v AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS i FROM path) SELECT path, count(*) FILTER (seq % 2 = 1)::BIGINT AS up, (count(*) FILTER (seq % 2 = 0))::BIGINT AS down, round(avg(round(z, 1)) FILTER (seq % 2 = 1), 3) AS mean_up FROM v GROUP BY path")
def gpx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tracks written as GPX and read again; the reader prefers the track whose name starts with Up."""
    p = points(spark, sf_dir).select("path", F.when(F.col("seq") % 2 == 1, "Up").otherwise("Down").alias("track"), "seq", (9 + F.col("path") / 1000.0).alias("lon"), (62 + F.col("seq") / 1000.0).alias("lat"), "z")
    docs = sinks.gpx(p)
    up = readers.gpx_points(docs, "xml")
    down = F.size(F.xpath("xml", F.lit('//*[local-name()="trk"][*[local-name()="name"]="Down"]//*[local-name()="trkpt"]/@lat')))
    down = docs.select("path", down.cast("long").alias("down"))
    return up.groupBy("path").agg(F.count(F.lit(1)).alias("up"), F.round(F.avg("z"), 3).alias("mean_up")).join(down, "path").select("path", "up", "down", "mean_up")


@query(f"WITH {PATH} SELECT path, 'leg'||path AS key, count(*) AS vertices FROM path GROUP BY path")
def geojson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as GeoJSON, read again."""
    f = sinks.geojson(_lines(spark, sf_dir).select("path", "key", "line"))
    shape = "properties struct<path:long,key:string>, geometry struct<type:string,coordinates:array<array<double>>>"
    e = f.select(F.from_json("value", shape).alias("f"))
    return e.select("f.properties.path", "f.properties.key", F.size("f.geometry.coordinates").cast("long").alias("vertices"))


@query("""WITH k AS (SELECT 'plan '||(o_custkey % 80) AS name, o_orderkey AS saved FROM orders), m AS (SELECT name, max(saved) AS saved FROM k GROUP BY name ORDER BY saved DESC, name LIMIT 50) SELECT name, saved FROM m""")
def saved_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty plans saved last, one of each name."""
    k = table(spark, sf_dir, "orders").select(F.concat(F.lit("plan "), F.col("o_custkey") % 80).alias("name"), F.col("o_orderkey").alias("saved"), F.lit("{}").alias("doc"))
    return sinks.saved_plans(k.where("saved % 2 = 0"), k.where("saved % 2 = 1")).select("name", "saved")
