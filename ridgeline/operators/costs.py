"""Least costs over rasters: the search of legs over the graph of all cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.graph import neighbours
from ridgeline.operators.legs import LOW, TILE, leaf_node, search, ways_back


def raster_costs(cells: DataFrame, start: DataFrame, tile: int = TILE, res: float = 10.0) -> DataFrame:
    """(source, r, c, best, from_r, from_c): the cheapest way from each start (source, r, c) over cells (r, c, cost).

    A step costs its length times the mean cost of its two cells; cells without a cost can't be crossed. A start
    without a cost reaches nothing.
    """
    known = cells.where("cost IS NOT NULL").select("r", "c", "cost")
    length = F.when((F.col("r") != F.col("to_r")) & (F.col("c") != F.col("to_c")), res * 2**0.5).otherwise(res)
    edges = neighbours(known, ["cost"]).select(leaf_node("r", "c").alias("src"), leaf_node("to_r", "to_c").alias("dst"), (length * (F.col("cost") + F.col("to_cost")) / 2).alias("w"))
    starts = known.select("r", "c").join(start, ["r", "c"]).select("source", leaf_node("r", "c").alias("node"))
    found = search(edges, starts, tile)
    before = F.col("prev") >= 0
    return found.select("source", *_cell("node", "r", "c"), F.col("cost").alias("best"), *[F.when(before, x).alias(f"from_{n}") for x, n in zip(_cell("prev", "r", "c"), "rc", strict=True)])


def _cell(node: str, r: str, c: str) -> list:
    return [F.shiftright(node, 32).cast("int").alias(r), F.col(node).bitwiseAND(F.lit(LOW)).cast("int").alias(c)]


def ways(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, to_r, to_c, seq, r, c) from each target (source, r, c) back to its source, seq 0 at the target."""
    prev = F.coalesce(leaf_node("from_r", "from_c"), F.lit(-1).cast("long"))
    chains = found.select("source", leaf_node("r", "c").alias("node"), prev.alias("prev"))
    way = ways_back(chains, targets.select("source", leaf_node("r", "c").alias("target"), leaf_node("r", "c").alias("node")))
    return way.select("source", *_cell("target", "to_r", "to_c"), "seq", *_cell("node", "r", "c"))
