"""Raster tiles as ASCII grids: a header of six lines, then a line of values for each row from the north."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.sources.readers import plausible

#: Fixed names of the header, in order.
HEADER = ["ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "NODATA_value"]
NODATA = -9999.0


def write_grids(cells: DataFrame, path: str, west: float, north: float, res: float = 10.0) -> None:
    """cells (ti, tj, r, c, z) as one file a tile, under path by tile: their heights in order, unknown ones as NODATA."""
    value = F.coalesce(F.col("z"), F.lit(NODATA)).cast("string")
    in_order = lambda key, x: F.transform(F.sort_array(F.collect_list(F.struct(key, x))), lambda s: s[x])
    rows = cells.withColumn("v", value).groupBy("ti", "tj", "r").agg(F.array_join(in_order("c", "v"), " ").alias("line"), F.count(F.lit(1)).alias("n"), F.min("c").alias("c"))
    tiles = rows.groupBy("ti", "tj").agg(F.array_join(in_order("r", "line"), "\n").alias("body"), F.max("n").alias("ncols"), F.count(F.lit(1)).alias("nrows"), F.min("c").alias("c"), F.max("r").alias("r"))
    head = [F.col("ncols"), F.col("nrows"), west + F.col("c") * res, north - (F.col("r") + 1) * res, F.lit(res), F.lit(NODATA)]
    text = F.concat_ws("\n", *[F.concat_ws(" ", F.lit(n), x.cast("string")) for n, x in zip(HEADER, head, strict=True)], "body")
    tiles.select("ti", "tj", text.alias("value")).write.partitionBy("ti", "tj").mode("overwrite").text(path)


def read_grids(spark: SparkSession, path: str, size: int, west: float, north: float, extent: tuple[int, int], res: float = 10.0, only: Column | None = None) -> DataFrame:
    """(ti, tj, r, c, z) of the tiles under path, a file a task at least; heights out of range are unknown.

    A tile of size x size cells (less at the end of the raster of extent rows and columns) that has another size, place,
    cell size or anything but numbers can't be read: it keeps one row without r and c. only limits ti and tj; other
    tiles' files aren't opened.
    """
    files = spark.read.schema("value string, ti int, tj int").text(path, wholetext=True)
    files = files.where(only) if only is not None else files
    number = lambda n: F.regexp_extract("value", rf"(?im)^{n}\s+(\S+)\s*$", 1).try_cast("double")
    t = files.withColumns({n.lower(): number(n) for n in HEADER})
    lines = F.filter(F.split(F.trim("value"), r"\s*\n\s*"), lambda x: x.rlike(r"^[-+0-9.]"))
    t = t.withColumn("rows", F.transform(lines, lambda x: F.transform(F.split(x, r"\s+"), lambda v: v.try_cast("double"))))
    n_rows, n_cols = (F.least(F.lit(size), F.lit(n) - F.col(k) * size) for n, k in zip(extent, ("ti", "tj"), strict=True))
    near = lambda a, b: F.abs(F.col(a) - b) < 0.1
    fits = (F.col("nrows") == n_rows) & (F.col("ncols") == n_cols) & (F.size("rows") == n_rows) & (F.col("cellsize") == res)
    fits &= near("xllcorner", west + F.col("tj") * size * res) & near("yllcorner", north - (F.col("ti") * size + n_rows) * res)
    fits &= F.forall("rows", lambda x: (F.size(x) == F.col("ncols")) & F.forall(x, lambda v: v.isNotNull()))
    t = t.withColumn("rows", F.when(F.coalesce(fits, F.lit(False)), F.col("rows")))
    each = t.select("ti", "tj", "nodata_value", F.posexplode_outer("rows").alias("i", "row")).select("ti", "tj", "nodata_value", "i", F.posexplode_outer("row").alias("j", "z"))
    z = plausible(F.when(F.col("nodata_value").isNull() | (F.col("z") != F.col("nodata_value")), F.col("z")))
    return each.select("ti", "tj", (F.col("ti") * size + F.col("i")).alias("r"), (F.col("tj") * size + F.col("j")).alias("c"), z.alias("z"))
