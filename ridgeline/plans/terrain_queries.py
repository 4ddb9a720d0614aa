"""Queries over raster cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import terrain
from ridgeline.plans.registry import DERIVED, cells_sql, registry
from ridgeline.sources.fixtures import cells

QUERIES, ORACLE_SQL, query = registry()
GENTLE, ROUGH, GAPS = cells_sql(0.9, 0.8), cells_sql(), cells_sql(gaps=True)
BLOCK = 16


def _round(c: str) -> F.Column:
    return F.round(c, 4).alias(c)


@query(f"WITH {GAPS}, {DERIVED} SELECT r, c, round(slope, 4) AS slope, round(aspect, 4) AS aspect FROM d")
def slope_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.derivatives(cells(spark, sf_dir, gaps=True)).select("r", "c", _round("slope"), _round("aspect"))


@query(f"WITH {GENTLE}, {DERIVED} SELECT r, c, coalesce(slope > 20 AND slope < 30 AND abs((((aspect - 180 + 180) % 360) + 360) % 360 - 180) <= 45, false) AS matched FROM d")
def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = terrain.derivatives(cells(spark, sf_dir, "gentle"))
    return d.select("r", "c", terrain.matches(F.col("slope"), F.col("aspect")).alias("matched"))


@query(f"""WITH {GAPS}, {DERIVED}
SELECT r//16 AS block_r, c//16 AS block_c, count(*) AS cells, round(avg((z IS NOT NULL)::INT::DOUBLE), 4) AS coverage, round(avg(slope), 4) AS mean_slope,
round(avg(CASE WHEN slope IS NOT NULL THEN (slope > 20 AND slope < 30)::INT::DOUBLE END), 4) AS band_share, round(avg(CASE WHEN slope IS NOT NULL THEN (slope >= 35)::INT::DOUBLE END), 4) AS steep_share,
round(((degrees(atan2(avg(sin(radians(aspect))), avg(cos(radians(aspect))))) % 360) + 360) % 360, 2) AS mean_aspect FROM d GROUP BY ALL""")
def aspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = terrain.derivatives(cells(spark, sf_dir, gaps=True))
    known = lambda p: F.avg(F.when(F.col("slope").isNotNull(), F.when(p, 1.0).otherwise(0.0)))
    out = d.groupBy(F.floor(F.col("r") / BLOCK).cast("int").alias("block_r"), F.floor(F.col("c") / BLOCK).cast("int").alias("block_c")).agg(
        F.count(F.lit(1)).alias("cells"),
        F.round(F.avg(F.col("z").isNotNull().cast("double")), 4).alias("coverage"),
        F.round(F.avg("slope"), 4).alias("mean_slope"),
        F.round(known((F.col("slope") > 20) & (F.col("slope") < 30)), 4).alias("band_share"),
        F.round(known(F.col("slope") >= 35), 4).alias("steep_share"),
        F.round(terrain.circular_mean(F.col("aspect")), 2).alias("mean_aspect"),
    )
    return out


@query(f"WITH {GAPS} SELECT r, c, coalesce(z, 700e0 + (r + c) % 50) AS z, z IS NULL AS coarse FROM cell")
def coverage_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = cells(spark, sf_dir, gaps=True)
    fallback = cells(spark, sf_dir).select("r", "c", (F.lit(700.0) + (F.col("r") + F.col("c")) % 50).alias("fallback"))
    both = primary.join(fallback, ["r", "c"], "left")
    return both.select("r", "c", F.coalesce("z", "fallback").alias("z"), (F.col("z").isNull() & F.col("fallback").isNotNull()).alias("coarse"))


SMOOTH = """s1 AS (SELECT *, coalesce(slope, 90e0) AS v FROM d), s2 AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY c ORDER BY r), v) + v + coalesce(lead(v) OVER (PARTITION BY c ORDER BY r), v) AS w FROM s1),
sm AS MATERIALIZED (SELECT *, (coalesce(lag(w) OVER (PARTITION BY r ORDER BY c), w) + w + coalesce(lead(w) OVER (PARTITION BY r ORDER BY c), w))/9 AS smooth FROM s2)"""


@query(f"WITH {GAPS}, {DERIVED}, {SMOOTH} SELECT r, c, round(smooth, 4) AS smooth FROM sm")
def smooth3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = terrain.derivatives(cells(spark, sf_dir, gaps=True))
    return terrain.box_mean(d, "slope", 90.0).select("r", "c", _round("smooth"))


@query(f"""WITH {ROUGH}, v AS (SELECT *, max(z) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS h, min(z) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS l FROM cell),
w AS (SELECT r, c, z, max(h) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS high, min(l) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS low FROM v)
SELECT r, c, round(z, 4) AS z, round(z - low, 4) AS relief FROM w WHERE z = high AND z >= 900 AND z - low >= 100""")
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = terrain.peaks(cells(spark, sf_dir), window=30, relief=100)
    return found.select("r", "c", _round("z"), F.round(F.col("z") - F.col("low"), 4).alias("relief"))


@query(f"""WITH {GAPS}, {DERIVED}, k AS (SELECT *, (r + c) % 4 AS water, (r * c) % 7 = 0 AS runout FROM d)
SELECT r, c, CASE WHEN water < 2 THEN CASE WHEN slope < 20 THEN 1e0 WHEN slope < 25 THEN 1.3e0 WHEN slope < 30 THEN 1.8e0 WHEN slope < 35 THEN 4e0 END * CASE WHEN water = 1 THEN 2e0 ELSE 1e0 END END * CASE WHEN runout THEN 1.5e0 ELSE 1e0 END AS cost FROM k""")
def ascent_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = terrain.derivatives(cells(spark, sf_dir, gaps=True))
    water, runout = (F.col("r") + F.col("c")) % 4, (F.col("r") * F.col("c")) % 7 == 0
    return d.select("r", "c", terrain.ascent_cost(F.col("slope"), water=water, runout=runout).alias("cost"))


#: Red, green, blue and class (1 deciduous, 2 conifer, 3 mixed).
FOREST = [(128, 255, 8, 1), (125, 191, 110, 2), (158, 204, 115, 3)]


@query(f"""WITH {ROUGH}, colour(red, green, blue, class) AS (VALUES {', '.join(map(str, FOREST))}),
px AS (SELECT r, c, CASE (r+c)%4 WHEN 0 THEN 128 WHEN 1 THEN 125 WHEN 2 THEN 158 ELSE 1 END AS red, CASE (r+c)%4 WHEN 0 THEN 255 WHEN 1 THEN 191 WHEN 2 THEN 204 ELSE 2 END AS green, CASE (r+c)%4 WHEN 0 THEN 8 WHEN 1 THEN 110 WHEN 2 THEN 115 ELSE 3 END AS blue, CASE WHEN r%9=0 THEN 0 ELSE 255 END AS alpha FROM cell),
k AS (SELECT r, c, CASE WHEN alpha > 0 THEN coalesce(class, 0) ELSE 0 END AS class FROM px LEFT JOIN colour USING (red, green, blue)),
n2 AS (SELECT r//16 AS block_r, class, count(*) AS n FROM k GROUP BY ALL),
f AS (SELECT block_r, class, row_number() OVER (PARTITION BY block_r ORDER BY n DESC, class) AS i FROM n2 WHERE class > 0)
SELECT k.r//16 AS block_r, count(*) AS cells, count(*) FILTER (k.class = 0) AS without, max(f.class)::INT AS dominant FROM k LEFT JOIN f ON f.block_r = k.r//16 AND f.i = 1 GROUP BY ALL""")
def class_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("r") + F.col("c")) % 4
    pick = lambda i, other: F.when(kind == 0, FOREST[0][i]).when(kind == 1, FOREST[1][i]).when(kind == 2, FOREST[2][i]).otherwise(other)
    pixels = cells(spark, sf_dir).select("r", "c", pick(0, 1).alias("red"), pick(1, 2).alias("green"), pick(2, 3).alias("blue"), F.when(F.col("r") % 9 == 0, 0).otherwise(255).alias("alpha"))
    values = ", ".join(map(str, FOREST))
    k = terrain.decode(pixels, spark.sql(f"SELECT * FROM VALUES {values} AS c(red, green, blue, class)"))
    counts = k.groupBy(F.floor(F.col("r") / BLOCK).cast("int").alias("block_r"), "class").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("class") > 0, F.struct("n", (-F.col("class")).alias("back"))))
    out = counts.groupBy("block_r").agg(F.sum("n").alias("cells"), F.sum(F.when(F.col("class") == 0, F.col("n")).otherwise(0)).alias("without"), (-best["back"]).alias("dominant"))
    return out


_EIGHT = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
DOWNHILL = """o(k, dr, dc, len) AS (VALUES %s),
nb AS (SELECT a.r, a.c, a.z, o.k, o.dr, o.dc, (a.z - coalesce(b.z, -1e9))/len AS gain FROM cell a CROSS JOIN o JOIN cell b ON b.r = a.r + o.dr AND b.c = a.c + o.dc WHERE a.z IS NOT NULL),
dh AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY gain DESC, k) AS i FROM nb WHERE gain > 0) WHERE i = 1)""" % ", ".join(f"({k}, {dr}, {dc}, {'10e0*sqrt(2e0)' if dr and dc else '10e0'})" for k, (dr, dc) in enumerate(_EIGHT))


@query(f"WITH {GAPS}, {DOWNHILL} SELECT cell.r, cell.c, dr::INT AS dr, dc::INT AS dc FROM cell LEFT JOIN dh ON dh.r = cell.r AND dh.c = cell.c")
def d8_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.downhill(cells(spark, sf_dir, gaps=True)).select("r", "c", "dr", "dc")
