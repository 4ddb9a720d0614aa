"""Routes over terrain: samples at most so far apart along true vertices, and what they say of the whole route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a route at most: 200 km at ten metres.
LONGEST = 20_001


def resampled(points: DataFrame, spacing: float = 10.0, most: int = LONGEST) -> DataFrame:
    """(path, seq from 0, x, y, step): samples of each path of vertices (path, seq, x, y) in metres.

    A segment is cut into equal steps of at most spacing, one step where its ends coincide; step is the length from the sample
    before, null at the first. A path with more than most samples keeps no sample, nor does one with an unknown vertex.
    """
    w, whole = Window.partitionBy("path").orderBy("seq"), Window.partitionBy("path")
    ends = points.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "last": F.lead("seq").over(w).isNull()})
    length = F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y")))
    ends = ends.withColumn("length", length).withColumn("n", F.when(F.col("last"), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("length") / spacing))).cast("long"))
    ends = ends.withColumns({"total": F.sum("n").over(whole), "unknown": F.max(F.col("x").isNull() | F.col("y").isNull()).over(whole)})
    each = ends.where((F.col("total") <= most) & ~F.col("unknown")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = lambda a, b: F.when(F.col("last"), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n"))
    order = Window.partitionBy("path").orderBy("seq", "k")
    step = F.when(F.col("k") > 0, F.col("length") / F.col("n")).otherwise(F.lag(F.col("length") / F.col("n")).over(order))
    return each.select("path", (F.row_number().over(order) - 1).alias("_i"), at("x", "nx").alias("x"), at("y", "ny").alias("y"), step.alias("step")).withColumnRenamed("_i", "seq")


def metrics(samples: DataFrame, horizontal: float = 4.0, vertical: float = 400.0, steep: float = 30.0) -> DataFrame:
    """Of samples (path, seq, step, z, slope): distance, climbing, time, steep samples and the share of known heights.

    Climbing counts only where all heights are known, time only where all slopes are too.
    """
    w = Window.partitionBy("path").orderBy("seq")
    s = samples.withColumn("dz", F.col("z") - F.lag("z").over(w))
    n = F.count(F.lit(1))
    up = lambda x: F.when(F.count("z") == n, F.coalesce(F.sum(F.greatest(x, F.lit(0.0))), F.lit(0.0)))
    out = s.groupBy("path").agg(
        n.alias("samples"), (F.coalesce(F.sum("step"), F.lit(0.0)) / 1000).alias("distance_km"), up(F.col("dz")).alias("ascent_m"), up(-F.col("dz")).alias("descent_m"), F.max("slope").alias("max_slope"),
        F.count_if(F.col("slope") >= steep).alias("steep_samples"), (100.0 * F.count("z") / n).alias("coverage"), ((F.count("z") == n) & (F.count("slope") == n)).alias("complete"),
    )
    hours = F.when(F.col("complete"), F.col("distance_km") / horizontal + F.col("ascent_m") / vertical)
    return out.withColumn("hours", hours).withColumn("in_target", F.col("hours").between(3, 4))
