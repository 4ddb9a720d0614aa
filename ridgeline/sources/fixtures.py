"""Terrain, access and graph tables derived from the driver's star schema by fixed formulas."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.sources.tables import table

#: Slopes of the two height profiles.
PROFILES = {"rough": (1.2, 1.5), "gentle": (0.9, 0.8)}
RES = 10.0


def side(spark: SparkSession, sf_dir: str) -> int:
    """Cells along each edge of the square raster; the count comes from Parquet footers."""
    return isqrt(table(spark, sf_dir, "orders").count())


def cells(spark: SparkSession, sf_dir: str, profile: str = "rough", gaps: bool = False) -> DataFrame:
    """(r, c, z): z is null where unknown."""
    n, (p, q) = side(spark, sf_dir), PROFILES[profile]
    key = F.col("o_orderkey")
    r, c = F.floor(key / F.lit(n)).cast("int"), (key % n).cast("int")
    z = F.lit(900.0) + p * F.abs((2 * F.col("r") + 3 * F.col("c")) % 180 - 90) + q * F.abs((F.col("r") - 2 * F.col("c") + 1400) % 140 - 70) + F.floor("o_totalprice") % 2
    grid = table(spark, sf_dir, "orders").where(key < n * n).select(r.alias("r"), c.alias("c"), "o_totalprice", "o_orderpriority")
    z = F.when(F.col("o_orderpriority") != "1-URGENT", z) if gaps else z
    return grid.select("r", "c", z.cast("double").alias("z"))


def valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, z): wide flats between ridges, with steep cones on them."""
    n, key = side(spark, sf_dir), F.col("o_orderkey")
    r, c = F.floor(key / F.lit(n)).cast("int"), (key % n).cast("int")
    ridge = F.greatest(F.lit(0), F.abs((F.col("r") + 2 * F.col("c")) % 192 - 96) - 64)
    cone = F.greatest(F.lit(0), 5 - F.greatest(*(F.abs(F.col(x) % 48 - 24) for x in "rc")))
    grid = table(spark, sf_dir, "orders").where(key < n * n).select(r.alias("r"), c.alias("c"), "o_totalprice")
    return grid.select("r", "c", (F.lit(900.0) + 2.2 * ridge + 9.0 * cone + F.floor("o_totalprice") % 2).cast("double").alias("z"))


def leg_ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """sources (source, r, c), one a nation, and targets (source, target, r, c), its suppliers."""
    n = side(spark, sf_dir)
    at = lambda k, a, b, name: ((k * a + b) % n).cast("int").alias(name)
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    sources = table(spark, sf_dir, "nation").select(k.cast("long").alias("source"), at(k, 6007, 11, "r"), at(k, 3571, 5, "c"))
    return sources, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("source"), s.cast("long").alias("target"), at(s, 7919, 0, "r"), at(s, 104729, 37, "c"))


def parkings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = side(spark, sf_dir)
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("parking"),
        ((k * 7919) % (10 * n)).cast("double").alias("x"),
        ((k * 104729 + 37) % (10 * n)).cast("double").alias("y"),
        F.when(k % 7 == 0, "private").alias("access"),
        F.when(k % 11 != 0, (k * 37) % 180).cast("int").alias("drive_min"),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = side(spark, sf_dir)
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 10 == 0).select(
        k.alias("road"),
        ((k * 3571) % (10 * n)).cast("double").alias("x"),
        ((k * 6007 + 11) % (10 * n)).cast("double").alias("y"),
        F.col("c_mktsegment").alias("class"),
        (F.col("c_acctbal") < 0).alias("closed"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    skin = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("s"), F.col("l_partkey")).alias("dst"), F.lit("skin").alias("kind"), (F.col("l_quantity") / 10).alias("hours")
    )
    walk = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey") % 500).alias("src"), F.concat(F.lit("p"), F.col("o_custkey") % 100).alias("dst"), F.lit("walk").alias("kind"), (F.col("o_totalprice") / 1e5).alias("hours")
    )
    return skin.unionByName(walk)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, seq, z): one path a user, its points in time order."""
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.row_number().over(own).alias("seq"), F.col("value").alias("z"), "ts", "event_type")
