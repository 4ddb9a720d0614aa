"""Queries of horizons and sun."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators import sun
from ridgeline.plans.registry import SIDE, cells_sql, registry
from ridgeline.plans.scalar_queries import solar_sql
from ridgeline.sources.fixtures import cells, parkings, side
from ridgeline.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
BEARINGS = [0, 45, 90, 135, 180, 225, 270, 315]
NEAR, FAR = list(range(20, 120, 20)), list(range(120, 260, 20))
#: 2026-03-15 08:00 to 16:05 civil time, in UTC.
BEGIN, END = 1773558000, 1773558000 + 8 * 3600 + 300

_POINT = f"""{cells_sql(gaps=True)}, pt AS MATERIALIZED (SELECT s_suppkey AS parking, c*10e0 + 5 AS x, 10e0*n - r*10 - 5 AS y, z, (s_suppkey % 35)*1e0 AS slope, (s_suppkey*29 % 360)*1e0 AS aspect FROM (SELECT s_suppkey, ((s_suppkey*7919 % (10*n)) // 10)::INT AS c, ((s_suppkey*104729 + 37) % (10*n) // 10)::INT AS r, n FROM supplier, n) q JOIN cell USING (r, c)),
ray AS MATERIALIZED (SELECT parking, b, d, cell.z, pt.z AS h FROM pt CROSS JOIN (SELECT unnest({BEARINGS}) AS b) CROSS JOIN (SELECT unnest({NEAR + FAR}) AS d) CROSS JOIN n LEFT JOIN cell ON cell.r = floor((10e0*n - (y + cos(radians(b::DOUBLE))*d))/10)::INT AND cell.c = floor((x + sin(radians(b::DOUBLE))*d)/10)::INT),
hz AS MATERIALIZED (SELECT parking, b, CASE WHEN bool_and(z - h IS NOT NULL) FILTER (d <= {NEAR[-1]}) THEN max(degrees(atan2(z - h, d))) FILTER (d <= {NEAR[-1]}) END AS near, CASE WHEN bool_and(z - h IS NOT NULL) THEN max(degrees(atan2(z - h, d))) END AS far FROM ray GROUP BY parking, b)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = side(spark, sf_dir), F.col("parking")
    p = parkings(spark, sf_dir).select("parking", F.floor(F.col("x") / 10).cast("int").alias("c"), F.floor(F.col("y") / 10).cast("int").alias("r"))
    p = p.join(cells(spark, sf_dir, gaps=True), ["r", "c"])
    return p.select("parking", (F.col("c") * 10.0 + 5).alias("x"), (10.0 * n - F.col("r") * 10 - 5).alias("y"), "z", (k % 35).cast("double").alias("slope"), (k * 29 % 360).cast("double").alias("aspect"))


def _rays(spark: SparkSession, sf_dir: str, distances: list[int]) -> DataFrame:
    return sun.horizons(_points(spark, sf_dir), cells(spark, sf_dir, gaps=True), "parking", BEARINGS, distances, 0.0, 10.0 * side(spark, sf_dir))


@query(f"WITH {_POINT} SELECT parking, b::DOUBLE AS bearing, round(near, 4) AS angle FROM hz")
def horizon_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rays(spark, sf_dir, NEAR).select("parking", "bearing", F.round("angle", 4).alias("angle"))


@query(f"WITH {_POINT} SELECT parking, round(max(far - near), 4) AS delta, count(far) AS known FROM hz GROUP BY parking")
def horizon_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the horizon rises when rays reach farther; unknown rays don't count."""
    far = _rays(spark, sf_dir, NEAR + FAR).withColumnRenamed("angle", "far")
    both = _rays(spark, sf_dir, NEAR).join(far, ["parking", "bearing"])
    return both.groupBy("parking").agg(F.round(F.max(F.col("far") - F.col("angle")), 4).alias("delta"), F.count("far").alias("known"))


_SLOT = f"""hr AS MATERIALIZED (SELECT parking, list(near ORDER BY b) AS angles FROM hz GROUP BY parking), t AS (SELECT unnest(range({BEGIN}, {END}, 600)) AS sec), lt AS (SELECT sec*1e0 AS sec, 62.7e0 AS lat, 9.0e0 AS lon FROM t), st AS MATERIALIZED ({solar_sql('lt', 'lat', 'lon', 'sec')}),
vis AS (SELECT parking, sec, least(10, ({END} - sec)/60e0) AS minutes, CASE WHEN a IS NOT NULL AND b2 IS NOT NULL THEN elevation > 0 AND elevation > greatest(a, b2) AND (CASE WHEN slope < 0.001 THEN sin(radians(elevation)) ELSE sin(radians(elevation))*cos(radians(slope)) + cos(radians(elevation))*sin(radians(slope))*cos(radians(azimuth) - radians(aspect)) END) > 0 END AS lit
FROM (SELECT pt.parking, slope, aspect, sec, azimuth, elevation, angles[(floor(azimuth/45)::INT % 8) + 1] AS a, angles[((floor(azimuth/45)::INT + 1) % 8) + 1] AS b2 FROM pt JOIN hr USING (parking) CROSS JOIN st))"""


def states(spark: SparkSession, points: DataFrame, rays: DataFrame, key: str) -> DataFrame:
    """(key, sec, minutes, lit) of points (key, slope, aspect) with their rays (key, bearing, angle), for each slot of the day."""
    angles = rays.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("bearing", "angle"))), lambda x: x.angle).alias("angles"))
    lit = lambda x: F.lit(x).cast("long")
    at = spark.range(1).select(F.explode(sun.slots(lit(BEGIN), lit(END))).alias("sec"))
    azimuth, elevation = geo.solar(F.lit(62.7), F.lit(9.0), F.col("sec").cast("double"))
    at = at.select("sec", azimuth.alias("azimuth"), elevation.alias("elevation"))
    s = points.select(key, "slope", "aspect").join(angles, key).crossJoin(F.broadcast(at))  # 49 slots of a day
    state = sun.sun_state(F.col("azimuth"), F.col("elevation"), sun.between_rays(F.col("angles"), F.col("azimuth"), 45.0), F.col("slope"), F.col("aspect"))
    return s.select(key, "sec", F.least(F.lit(10.0), (END - F.col("sec")) / 60.0).alias("minutes"), state.alias("lit"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, _points(spark, sf_dir), _rays(spark, sf_dir, NEAR), "parking")


@query(f"WITH {_POINT}, {_SLOT} SELECT parking, CASE WHEN bool_and(lit IS NOT NULL) THEN round(sum(CASE WHEN lit THEN minutes ELSE 0 END)/60e0, 4) END AS hours FROM vis GROUP BY parking")
def sun_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sun.sun_hours(_states(spark, sf_dir), "parking").withColumn("hours", F.round("hours", 4))


@query(f"WITH {_POINT}, {_SLOT} SELECT sec::BIGINT AS sec, count(*) FILTER (lit)::BIGINT AS sun, count(*) FILTER (NOT lit)::BIGINT AS shade, count(*) FILTER (lit IS NULL)::BIGINT AS unknown FROM vis GROUP BY sec")
def sun_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.count(F.when(p, 1))
    return _states(spark, sf_dir).groupBy("sec").agg(count(F.col("lit")).alias("sun"), count(~F.col("lit")).alias("shade"), count(F.col("lit").isNull()).alias("unknown"))
