"""Heights of a coarser source in longitude and latitude on cells of the metric raster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of known cells at least; less is unknown.
LEAST = 1e-6


def warped(targets: DataFrame, source: DataFrame, lon0: float, lat0: float, dlon: float, dlat: float) -> DataFrame:
    """(r, c, z): source on targets (r, c, lon, lat), as each target looks up its four source cells, weighted bilinearly.

    source: tile, i, j, z, with cell (0, 0)'s corner at lon0, lat0 and rows to the south. Unknown source cells
    weigh nothing; tiles don't mix, and the first tile with a height counts. Targets without one have no row.
    """
    at = targets.withColumns({"_i": (lat0 - F.col("lat")) / dlat - 0.5, "_j": (F.col("lon") - lon0) / dlon - 0.5})
    at = at.withColumns({"_i0": F.floor("_i"), "_j0": F.floor("_j")}).withColumns({"_a": F.col("_i") - F.col("_i0"), "_b": F.col("_j") - F.col("_j0")})
    share = lambda x, k: F.col(x) if k else 1 - F.col(x)
    four = F.explode(F.array(*[F.struct((F.col("_i0") + p).alias("i"), (F.col("_j0") + q).alias("j"), (share("_a", p) * share("_b", q)).alias("w")) for p in (0, 1) for q in (0, 1)]))
    each = at.select("r", "c", four.alias("n")).select("r", "c", "n.*")
    known = source.where("z IS NOT NULL").select("tile", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "z")
    met = each.join(known, ["i", "j"]).groupBy("r", "c", "tile").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"), F.sum("w").alias("w"))
    return met.where(F.col("w") > LEAST).groupBy("r", "c").agg(F.min_by("z", "tile").alias("z"))


def filled(cells: DataFrame, fallback: DataFrame) -> DataFrame:
    """cells (r, c, z) with fallback (r, c, z) where they are unknown, which coarse says."""
    both = cells.join(fallback.withColumnRenamed("z", "_fallback"), ["r", "c"], "left")
    return both.withColumn("coarse", F.col("z").isNull() & F.col("_fallback").isNotNull()).withColumn("z", F.coalesce("z", "_fallback")).drop("_fallback")
