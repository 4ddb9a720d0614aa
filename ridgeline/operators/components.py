"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.skew import split_join
from ridgeline.sources.scratch import discard, materialize


def _signature(edges: DataFrame) -> tuple[int, int]:
    """Number and hash of distinct edges; a sum of hashes would leave the range of long at some ten million edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_passes: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge to another one.

    Every pass rewires each node's larger neighbours to the smallest node it sees (large star), then
    each node's smaller neighbours likewise (small star), until the edges no longer change; chains
    shrink geometrically. Neighbour lists are only ever reduced to a minimum, so a hub needs no memory, and
    a hub's edges are joined where they lie.
    Null ends, self loops and repeated edges are ignored; an empty edge list gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    e = (
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    seen = _signature(e)
    for _ in range(max_passes):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        low = materialize(low, "least")
        large = split_join(both.where(F.col("v") > F.col("u")), low, ["u"], "n", 2 * seen[0], sort=True).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = (
            split_join(large, least, ["u"], "n", 2 * seen[0], sort=True)
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        before, e = e, materialize(small, "edges")
        for done in (before, low, large, least):
            discard(done)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_passes} passes")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
