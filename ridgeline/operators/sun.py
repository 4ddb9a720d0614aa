"""Terrain horizons along rays and the hours of direct sun below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geo


def horizons(points: DataFrame, cells: DataFrame, key: str, bearings: list[float], distances: list[float], west: float, north: float, res: float = 10.0) -> DataFrame:
    """(key, bearing, angle) of points (key, x, y, z): the highest terrain along each ray, null if any sample is unknown.

    Only the samples' cells are joined, each ray a handful of equi-joined rows; cells outside the raster don't match.
    """
    ray = F.explode(F.array(*[F.lit(float(b)) for b in bearings]))
    far = F.explode(F.array(*[F.lit(float(d)) for d in distances]))
    s = points.select(key, "x", "y", F.col("z").alias("h"), ray.alias("bearing")).withColumn("d", far)
    x, y = F.col("x") + F.sin(F.radians("bearing")) * F.col("d"), F.col("y") + F.cos(F.radians("bearing")) * F.col("d")
    s = s.select(key, "h", "bearing", "d", F.floor((north - y) / res).cast("int").alias("r"), F.floor((x - west) / res).cast("int").alias("c"))
    angle = F.degrees(F.atan2(F.col("z") - F.col("h"), F.col("d")))
    seen = s.join(cells.select("r", "c", "z"), ["r", "c"], "left").groupBy(key, "bearing")
    known = F.count(angle) == F.count(F.lit(1))
    return seen.agg(F.when(known, F.max(angle)).alias("angle"))


def slots(begin: Column, end: Column, minutes: int = 10) -> Column:
    """Unix seconds of slot starts in [begin, end), as an array."""
    step = 60 * minutes
    return F.when(begin < end, F.sequence(begin, end - 1, F.lit(step).cast("long")))


def between_rays(angles: Column, azimuth: Column, width: float, turn: Column | float = 0.0) -> Column:
    """The higher of the two rays beside an azimuth; unknown if either is. angles start at north."""
    n = F.size(angles)
    at = F.floor(F.pmod(azimuth - turn, F.lit(360.0)) / width).cast("int")
    one, two = F.get(angles, at % n), F.get(angles, (at + 1) % n)
    return F.when(one.isNotNull() & two.isNotNull(), F.greatest(one, two))


def sun_state(azimuth: Column, elevation: Column, horizon: Column, slope: Column, aspect: Column) -> Column:
    """True in direct sun, false in shade or at night, null where horizon or ground is unknown."""
    lit = (elevation > 0) & (elevation > horizon) & (geo.incidence(slope, aspect, azimuth, elevation) > 0)
    return F.when(horizon.isNotNull() & slope.isNotNull(), lit)


def sun_hours(states: DataFrame, key: str) -> DataFrame:
    """(key, hours) of rows (key, lit, minutes); null if any slot is unknown."""
    known = F.count("lit") == F.count(F.lit(1))
    return states.groupBy(key).agg(F.when(known, F.sum(F.when(F.col("lit"), F.col("minutes")).otherwise(0)) / 60.0).alias("hours"))
