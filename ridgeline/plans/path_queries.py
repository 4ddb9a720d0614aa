"""Queries over ordered points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import paths, terrain
from ridgeline.plans.registry import PATH, registry
from ridgeline.sources.fixtures import paths as points
from ridgeline.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()


@query(f"""WITH {PATH}, s AS (SELECT *, z - lag(z) OVER (PARTITION BY path ORDER BY seq) AS dz FROM path), t AS (SELECT *, sqrt(dz*dz+100e0) AS len, degrees(atan(abs(dz)/10e0)) AS slope FROM s)
SELECT path, count(*) AS points, round(sum(len), 4) AS length_m, round(sum(greatest(dz, 0e0)) FILTER (dz IS NOT NULL), 4) AS gain_m, round(sum(greatest(-dz, 0e0)) FILTER (dz IS NOT NULL), 4) AS loss_m, round(max(slope), 4) AS max_slope, round(avg(slope), 4) AS mean_slope,
round(avg((slope >= 30)::INT::DOUBLE), 4) AS share_30, round(avg((slope >= 25)::INT::DOUBLE), 4) AS share_25, round(avg((slope >= 20 AND slope < 30)::INT::DOUBLE), 4) AS share_band,
round(sum(len)/1000/4 + sum(greatest(dz, 0e0)) FILTER (dz IS NOT NULL)/400, 4) AS hours FROM t GROUP BY path""")
def path_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.path_stats(points(spark, sf_dir).withColumn("z", F.col("z")))
    return out.select("path", "points", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


@query(f"""WITH {PATH}, s AS (SELECT *, lead(z) OVER (PARTITION BY path ORDER BY seq) AS nz FROM path),
d AS (SELECT path, seq, k, z + (nz - z) * k / 4e0 AS h FROM s, (SELECT unnest(range(0, 4)) AS k) WHERE nz IS NOT NULL UNION ALL SELECT path, seq, 0, z FROM s WHERE nz IS NULL),
g AS (SELECT *, h - lag(h) OVER (PARTITION BY path ORDER BY seq, k) AS dh FROM d)
SELECT path, count(*) AS samples, round((count(*)-1)*10/1000e0, 4) AS distance_km, round(coalesce(sum(greatest(dh, 0e0)) FILTER (dh IS NOT NULL), 0), 4) AS ascent_m, round((count(*)-1)*10/1000e0/4 + coalesce(sum(greatest(dh, 0e0)) FILTER (dh IS NOT NULL), 0)/400, 6) AS hours,
(round((count(*)-1)*10/1000e0/4 + coalesce(sum(greatest(dh, 0e0)) FILTER (dh IS NOT NULL), 0)/400, 6) BETWEEN 3 AND 4) AS in_target FROM g GROUP BY path""")
def route_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices 40 m apart, filled up to every 10 m; the flat distance counts, and gain only if all is known."""
    from pyspark.sql import Window

    s = points(spark, sf_dir).withColumn("nz", F.lead("z").over(paths.in_order()))
    k = F.explode(F.when(F.col("nz").isNotNull(), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0))))
    d = s.withColumn("k", k).withColumn("h", F.when(F.col("nz").isNotNull(), F.col("z") + (F.col("nz") - F.col("z")) * F.col("k") / 4.0).otherwise(F.col("z")))
    d = d.withColumn("dh", F.col("h") - F.lag("h").over(Window.partitionBy("path").orderBy("seq", "k")))
    out = d.groupBy("path").agg(F.count(F.lit(1)).alias("samples"), F.count("h").alias("known"), F.coalesce(F.sum(F.greatest("dh", F.lit(0.0))), F.lit(0.0)).alias("gain"))
    km = (F.col("samples") - 1) * 10 / 1000.0
    gain = F.when(F.col("known") == F.col("samples"), F.col("gain"))
    hours = F.round(km / 4 + gain / 400, 6)
    return out.select("path", "samples", F.round(km, 4).alias("distance_km"), F.round(gain, 4).alias("ascent_m"), hours.alias("hours"), hours.between(3, 4).alias("in_target"))


@query(f"WITH {PATH}, s AS (SELECT path, max(z) OVER (PARTITION BY path ORDER BY seq) - z AS fall FROM path) SELECT path, round(max(fall), 4) AS drawdown FROM s GROUP BY path")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.drawdown(points(spark, sf_dir)).withColumn("drawdown", F.round("drawdown", 4))


@query(f"""WITH {PATH}, s AS (SELECT *, floor(z/40)::INT AS dir FROM path), t AS (SELECT *, lead(dir) OVER w AS nd, lag(seq) OVER w AS b, lead(seq) OVER w AS a FROM s WINDOW w AS (PARTITION BY path ORDER BY seq))
SELECT path, seq FROM t WHERE b IS NULL OR a IS NULL OR (seq-1)%8=0 OR nd <> dir""")
def simplify_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.turning_points(points(spark, sf_dir), F.floor(F.col("z") / 40), 8).select("path", "seq")


@query(f"WITH {PATH} SELECT path, seq, round(z, 1) AS z FROM (SELECT *, max(seq) OVER (PARTITION BY path) AS m FROM path) WHERE (seq-1)%2=0 OR seq = m")
def thin_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.thinned(points(spark, sf_dir), 2).select("path", "seq", F.round("z", 1).alias("z"))


@query(f"WITH {PATH} SELECT path, max(seq)::INT AS last, count(*) AS kept FROM (SELECT *, max(CASE WHEN z > 60 AND z < 80 THEN seq END) OVER (PARTITION BY path) AS m FROM path) WHERE seq <= m GROUP BY path")
def inband_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = paths.until_last(points(spark, sf_dir), (F.col("z") > 60) & (F.col("z") < 80))
    return kept.groupBy("path").agg(F.max("seq").alias("last"), F.count(F.lit(1)).alias("kept"))


@query("""WITH s AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), m AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM s)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS slots FROM m GROUP BY user_id, g""")
def sun_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.islands(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 12 * 3600)


@query("SELECT event_type, round(((degrees(atan2(avg(sin(radians(value))), avg(cos(radians(value))))) % 360) + 360) % 360, 4) AS aspect, round(median(value), 4) AS median_value, count(*) AS n FROM events GROUP BY event_type")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.round(terrain.circular_mean(F.col("value")), 4).alias("aspect"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("median_value"), F.count(F.lit(1)).alias("n"))
