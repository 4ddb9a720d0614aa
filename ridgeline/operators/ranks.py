"""Places of rows in a total order, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.sources.scratch import materialize

#: monotonically_increasing_id() has the partition above these bits and the row's place in it below.
BITS = 33


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df, written, with its rows' places from 0 in the given order as column name.

    Rows are dealt out by sampled ranges of the order and sorted there; the sizes of the ranges give each one's
    first place. Rows that agree in all of order stay in one range, so order should tell rows apart. The keys
    of the order are sampled to the driver by Spark and should be short.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    written = materialize(sorted_, "ranked")
    part = F.shiftright("_at", BITS)
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))  # a row a range
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    place = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << BITS) - 1))
    return written.withColumn("_part", part).join(F.broadcast(firsts), "_part").withColumn(name, place).drop("_part", "_at", "_first")
