"""Work by block: each block reads its cells and a margin around them, and owns its cells alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns that part cells by block; operators take them as their tile.
BLOCK = ["block_r", "block_c"]


def with_halo(cells: DataFrame, size: int, margin: int) -> DataFrame:
    """cells (r, c, ...) once for each block whose cells or margin they are in; blocks are half open and start at 0."""
    spans = lambda x: F.sequence(F.greatest(F.lit(0), F.floor((F.col(x) - margin) / size)).cast("int"), F.floor((F.col(x) + margin) / size).cast("int"))
    return cells.withColumn("block_r", F.explode(spans("r"))).withColumn("block_c", F.explode(spans("c")))


def owned(size: int) -> Column:
    """Whether a row of with_halo() is its block's own."""
    return (F.floor(F.col("r") / size) == F.col("block_r")) & (F.floor(F.col("c") / size) == F.col("block_c"))


def by_block(cells: DataFrame, size: int, margin: int, work: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """work(cells, tile) done block by block, with the rows that blocks own: the same as over the whole raster, if margin is as wide as work looks."""
    return work(with_halo(cells, size, margin), BLOCK).where(owned(size))
