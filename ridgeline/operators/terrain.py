"""Slope, aspect and neighbourhood filters over raster cells (r, c, z).

Neighbours are found by windows along rows and columns, so a filter is two sorts and no join. ``tile``
columns, if any, part the raster; without one the raster is a single tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(tile: list[str], line: str, place: str):
    return Window.partitionBy(*tile, line).orderBy(place)


def _difference(z: str, w, res: float) -> Column:
    """Central difference, one-sided at the raster's edge; unknown beside an unknown cell."""
    edge_low, edge_high = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    before, after = F.lag(z).over(w), F.lead(z).over(w)
    return (
        F.when(edge_low & edge_high, F.lit(None).cast("double"))
        .when(edge_low, (after - F.col(z)) / res)
        .when(edge_high, (F.col(z) - before) / res)
        .otherwise((after - before) / (2 * res))
    )


def derivatives(cells: DataFrame, res: float = 10.0, tile: list[str] | None = None) -> DataFrame:
    """cells with slope and aspect in degrees; a flat cell has no aspect, an unknown cell neither."""
    tile = tile or []
    out = cells.withColumns({"south": _difference("z", _along(tile, "c", "r"), res), "east": _difference("z", _along(tile, "r", "c"), res)})
    slope = F.degrees(F.atan(F.sqrt(F.col("south") * F.col("south") + F.col("east") * F.col("east"))))
    out = out.withColumn("slope", F.when(F.col("z").isNotNull(), slope))
    aspect = F.pmod(F.degrees(F.atan2(-F.col("east"), F.col("south"))), F.lit(360.0))
    return out.withColumn("aspect", F.when(F.col("slope") >= 0.001, aspect)).drop("south", "east")


def matches(slope: Column, aspect: Column, lower: float = 20, upper: float = 30, bearing: float = 180, width: float = 45) -> Column:
    """Strictly inside the slope band, and within width of the bearing around the circle; unknown is no match."""
    turn = F.abs(F.pmod(aspect - bearing + 180, F.lit(360.0)) - 180)
    return F.coalesce((slope > lower) & (slope < upper) & (turn <= width), F.lit(False))


def circular_mean(degrees: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))), F.lit(360.0))


def box_mean(cells: DataFrame, value: str, unknown: float, tile: list[str] | None = None) -> DataFrame:
    """cells with smooth: the 3 x 3 mean; the edge is repeated outwards, unknown counts as given."""
    tile, v = tile or [], F.coalesce(F.col(value), F.lit(unknown))

    def three(x: str, line: str, place: str) -> Column:
        w = _along(tile, line, place)
        return F.coalesce(F.lag(x).over(w), F.col(x)) + F.col(x) + F.coalesce(F.lead(x).over(w), F.col(x))

    out = cells.withColumn("_v", v).withColumn("_v", three("_v", "r", "c"))
    return out.withColumn("smooth", three("_v", "c", "r") / 9).drop("_v")


def box_extremes(cells: DataFrame, before: int, after: int, tile: list[str] | None = None) -> DataFrame:
    """cells with high and low of z over the rectangle from -before to +after, along columns, then rows."""
    tile = tile or []
    for line, place in (("c", "r"), ("r", "c")):
        w = _along(tile, line, place).rowsBetween(-before, after)
        high, low = ("z", "z") if line == "c" else ("high", "low")
        cells = cells.withColumns({"high": F.max(high).over(w), "low": F.min(low).over(w)})
    return cells


def peaks(cells: DataFrame, window: int = 150, least_z: float = 900, relief: float = 150, tile: list[str] | None = None) -> DataFrame:
    """Cells that are the highest of their window, high enough and above its lowest; plateaus give several."""
    out = box_extremes(cells, window // 2, (window - 1) // 2, tile)
    return out.where((F.col("z") == F.col("high")) & (F.col("z") >= least_z) & (F.col("z") - F.col("low") >= relief))


def ascent_cost(slope: Column, most: float = 35, lower: float = 20, water: Column | None = None, runout: Column | None = None) -> Column:
    """Cost of a step: by slope class; null where impassable. water: 1 lake, 2 sea, 3 glacier."""
    cost = F.when(slope < lower, 1.0).when(slope < 25, 1.3).when(slope < 30, 1.8).when(slope < most, 4.0)
    if water is not None:
        cost = F.when(F.coalesce(water, F.lit(0)) < 2, cost * F.when(F.coalesce(water, F.lit(0)) == 1, 2.0).otherwise(1.0))
    if runout is not None:
        cost = cost * F.when(F.coalesce(runout, F.lit(False)), 1.5).otherwise(1.0)
    return cost


def decode(pixels: DataFrame, colours: DataFrame) -> DataFrame:
    """pixels (…, red, green, blue, alpha) with the class of exactly that colour; 0 if none or transparent.

    colours is a handful of rows fixed in code, so Spark broadcasts it by its size.
    """
    found = pixels.join(colours, ["red", "green", "blue"], "left")
    return found.withColumn("class", F.when(F.col("alpha") > 0, F.coalesce("class", F.lit(0))).otherwise(0))


def downhill(cells: DataFrame, res: float = 10.0) -> DataFrame:
    """cells with dr, dc and gain of the steepest descent among 8 neighbours; the first direction wins ties.

    An unknown neighbour counts as a pit of -1e9, which draws the flow and ends it.
    """
    rows, cols = Window.partitionBy("c").orderBy("r"), Window.partitionBy("r").orderBy("c")
    z = F.coalesce(F.col("z"), F.lit(-1e9))
    out = cells.withColumn("_z", z)
    out = out.withColumns({"_up": F.lag("_z").over(rows), "_down": F.lead("_z").over(rows)})
    named = {}
    for dc, shift in ((-1, F.lag), (1, F.lead)):
        for dr, source in ((-1, "_up"), (0, "_z"), (1, "_down")):
            named[f"_n{dr}_{dc}"] = shift(source).over(cols)
    out = out.withColumns(named)
    at = {(-1, 0): "_up", (1, 0): "_down"} | {(dr, dc): f"_n{dr}_{dc}" for dr in (-1, 0, 1) for dc in (-1, 1)}
    order = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    options = []
    for k, (dr, dc) in enumerate(order):
        length = res * (2**0.5 if dr and dc else 1.0)
        gain = (F.col("_z") - F.col(at[dr, dc])) / F.lit(length)
        options.append(F.struct(gain.alias("gain"), F.lit(-k).alias("turn"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")))
    best = F.array_max(F.filter(F.array(*options), lambda o: o.gain > 0))
    out = out.withColumn("_best", F.when(F.col("z").isNotNull(), best))
    return out.select(*cells.columns, F.col("_best.dr").alias("dr"), F.col("_best.dc").alias("dc"), F.col("_best.gain").alias("gain"))
