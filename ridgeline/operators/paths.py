"""Statistics, windows and thinning along ordered points (path, seq, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F



def in_order() -> WindowSpec:
    return Window.partitionBy("path").orderBy("seq")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole() -> WindowSpec:
    return Window.partitionBy("path")


def with_steps(points: DataFrame, step: float) -> DataFrame:
    """points with dz from the point before, and the 3-D length of that step."""
    dz = F.col("z") - F.lag("z").over(in_order())
    return points.withColumn("dz", dz).withColumn("length", F.sqrt(F.col("dz") * F.col("dz") + step * step))


def path_stats(points: DataFrame, step: float = 10.0, horizontal: float = 4.0, vertical: float = 400.0) -> DataFrame:
    """Length, gain, loss, slopes, shares of steep ground and moving time; share bands include the low end only."""
    steps = with_steps(points, step).withColumn("slope", F.degrees(F.atan(F.abs(F.col("dz")) / step)))
    known = F.col("dz").isNotNull()
    share = lambda p: F.avg(F.when(known, F.when(p, 1.0).otherwise(0.0)))
    out = steps.groupBy("path").agg(
        F.count(F.lit(1)).alias("points"),
        F.sum("length").alias("length_m"),
        F.sum(F.greatest("dz", F.lit(0.0))).alias("gain_m"),
        F.sum(F.greatest(-F.col("dz"), F.lit(0.0))).alias("loss_m"),
        F.max("slope").alias("max_slope"),
        F.avg("slope").alias("mean_slope"),
        share(F.col("slope") >= 30).alias("share_30"),
        share(F.col("slope") >= 25).alias("share_25"),
        share((F.col("slope") >= 20) & (F.col("slope") < 30)).alias("share_band"),
    )
    return out.withColumn("hours", F.col("length_m") / 1000 / horizontal + F.col("gain_m") / vertical)


def drawdown(points: DataFrame) -> DataFrame:
    """(path, drawdown): the largest drop below the highest point so far."""
    return points.withColumn("_fall", F.max("z").over(so_far()) - F.col("z")).groupBy("path").agg(F.max("_fall").alias("drawdown"))


def until_last(points: DataFrame, inside: Column) -> DataFrame:
    """Points up to the last one inside; paths without one vanish."""
    return points.withColumn("_last", F.max(F.when(inside, F.col("seq"))).over(whole())).where(F.col("seq") <= F.col("_last")).drop("_last")


def thinned(points: DataFrame, step: int) -> DataFrame:
    """Every step-th point from the first, and the last."""
    return points.withColumn("_last", F.max("seq").over(whole())).where(((F.col("seq") - 1) % step == 0) | (F.col("seq") == F.col("_last"))).drop("_last")


def turning_points(points: DataFrame, direction: Column, step: int) -> DataFrame:
    """Both ends, every step-th point and every change of direction."""
    out = points.withColumn("_d", direction)
    changes = F.lead("_d").over(in_order()) != F.col("_d")
    first, last = F.lag("seq").over(in_order()).isNull(), F.lead("seq").over(in_order()).isNull()
    keep = first | last | ((F.col("seq") - 1) % step == 0) | F.coalesce(changes, F.lit(False))
    return out.withColumn("_keep", keep).where("_keep").drop("_keep", "_d")


def islands(events: DataFrame, key: str, time: str, tie: str, gap_seconds: float) -> DataFrame:
    """(key, first, last, slots) of runs without a gap longer than given."""
    w = Window.partitionBy(key).orderBy(time, tie)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    marked = events.withColumn("_new", F.coalesce((gap > int(gap_seconds * 1e6)).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "_run").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("slots")).drop("_run")


def surfaces(points: DataFrame, step: float = 10.0) -> DataFrame:
    """(path, forest_share, lake_m, runout_m) from forest, water and runout codes; a path without a mask gets null."""
    metres = lambda c: (F.count(F.when(F.col(c) == 1, 1)) * step).cast("long")
    if_known = lambda c, x: F.when(F.count(c) > 0, x)
    share = 100.0 * F.count(F.when(F.col("forest") > 0, 1)) / F.count(F.lit(1))
    return points.groupBy("path").agg(if_known("forest", share).alias("forest_share"), if_known("water", metres("water")).alias("lake_m"), if_known("runout", metres("runout")).alias("runout_m"))


def terrain_class(share: Column) -> Column:
    return F.when(share >= 60, "trees").when(share <= 20, "open").when(share.isNotNull(), "mixed")


def without_head(points: DataFrame, length: float) -> DataFrame:
    """Points from the last one walked to within length on."""
    cut = F.max(F.when(F.col("walked") <= length, F.col("seq"))).over(whole())
    return points.withColumn("_cut", cut).where(F.col("seq") >= F.col("_cut")).drop("_cut")
