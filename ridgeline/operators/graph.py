"""Iterative operators over cells and edges: flow, reach, meshes and least costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.sources.scratch import Growing, discard, materialize

LEVELS = (16, 8, 4, 2)


def accumulate(steps: DataFrame, sums: list[str], max_passes: int = 64) -> DataFrame:
    """(node, sums): each node's sums along its chain of successors (node, next, sums) until a null next.

    Pointer jumping: every pass doubles how far a node has looked, so a chain of n needs log2(n) passes.
    """
    live = materialize(steps.select("node", "next", *sums), "chain")
    for _ in range(max_passes):
        if live.where("next IS NOT NULL").isEmpty():
            return live.drop("next")
        ahead = live.select(F.col("node").alias("next"), F.col("next").alias("_next"), *[F.col(c).alias(f"_{c}") for c in sums])
        joined = live.join(ahead, "next", "left")
        last, live = live, materialize(joined.select("node", F.col("_next").alias("next"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in sums]), "chain")
        discard(last)
    raise RuntimeError("a chain of successors has a cycle")


def reachable(start: DataFrame, edges: DataFrame, max_passes: int = 1000) -> DataFrame:
    """(node) reached from start (node) along edges (src, dst). What was seen is one table that every pass adds to."""
    front = materialize(start.select("node").distinct(), "front")
    seen = Growing(front, "seen")
    for _ in range(max_passes):
        new = edges.join(front, edges["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        last, front = front, materialize(new.join(seen.read(), "node", "left_anti"), "front")
        discard(last)
        if front.isEmpty():
            return seen.read()
        seen.add(front)
    raise RuntimeError(f"more than {max_passes} steps to the farthest node")


def follow(starts: DataFrame, steps: DataFrame, most: int) -> DataFrame:
    """(start, seq, node): the chain of successors (node, next) from each start, of at most most steps; seq counts from 0.

    Doubling: a pass appends what lies 2**k steps ahead of all that is known, so most needs log2(most) passes.
    """
    jump = materialize(steps.select("node", "next").where("next IS NOT NULL"), "jumps")
    out = materialize(starts.select(F.col("node").alias("start"), F.lit(0).alias("seq"), "node"), "traces")
    ahead = 1
    while ahead <= most and not jump.isEmpty():
        far = out.join(jump, "node").select("start", (F.col("seq") + ahead).alias("seq"), F.col("next").alias("node")).where(F.col("seq") <= most)
        last, out = out, materialize(out.unionByName(far), "traces")
        discard(last)
        twice = jump.select(F.col("node").alias("next"), F.col("next").alias("_next"))
        last, jump = jump, materialize(jump.join(twice, "next").select("node", F.col("_next").alias("next")), "jumps")
        discard(last)
        ahead *= 2
    return out


def largest_apart(pairs: DataFrame, nodes: DataFrame, max_passes: int = 1000) -> DataFrame:
    """(node) that a pass in order of rank accepts, each node that no accepted one of a better rank is paired with.

    nodes: node, rank (distinct). pairs: worse, better. Every pass accepts all nodes whose better partners are
    decided, so passes are as many as the longest chain of ranks, not as nodes.
    """
    open_, taken = materialize(nodes.select("node"), "open"), None
    pairs = materialize(pairs.select("worse", "better").distinct(), "conflicts")
    for _ in range(max_passes):
        waits = pairs.join(open_.select(F.col("node").alias("better")), "better", "left_semi").select(F.col("worse").alias("node"))
        new = materialize(open_.join(waits, "node", "left_anti"), "accepted")
        if new.isEmpty():
            return (taken or Growing(new, "taken")).read()
        taken = taken.add(new) if taken else Growing(new, "taken")
        gone = pairs.join(new.select(F.col("node").alias("better")), "better", "left_semi").select(F.col("worse").alias("node"))
        last, open_ = open_, materialize(open_.join(new, "node", "left_anti").join(gone, "node", "left_anti"), "open")
        discard(last)
    raise RuntimeError(f"ranks not decided in {max_passes} passes")


def mesh(cells: DataFrame, fine: Column, levels: tuple[int, ...] = LEVELS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(r, c, size, leaf_r, leaf_c) and columns to keep: each cell's leaf. A block is a leaf if it is whole, of one cost and has no fine cell.

    A block that may be a leaf has smaller blocks that may be, so a cell's leaf is the largest such block around it. The
    blocks of all levels are windows within the largest ones, by which cells are dealt out once.
    """
    top = max(levels)
    block = lambda x, k: F.floor(F.col(x) / k).cast("int")
    at = cells.withColumn("_fine", fine).withColumns({"_r": block("r", top), "_c": block("c", top)}).repartition("_r", "_c")
    size = F.lit(1)
    for k in sorted(levels):
        w = Window.partitionBy("_r", "_c", block("r", k), block("c", k))
        known = F.count("cost").over(w)
        one = (known == 0) | ((known == k * k) & (F.min("cost").over(w) == F.max("cost").over(w)))
        at = at.withColumn(f"_fits_{k}", (F.count(F.lit(1)).over(w) == k * k) & ~F.max("_fine").over(w) & one)
        size = F.when(F.col(f"_fits_{k}"), k).otherwise(size)
    return at.select("r", "c", *keep, size.alias("size")).select("r", "c", *keep, "size", *((F.floor(F.col(x) / F.col("size")) * F.col("size")).cast("int").alias(f"leaf_{x}") for x in "rc"))


def mesh_graph(cells: DataFrame, fine: Column, pinned: DataFrame | None = None) -> DataFrame:
    """Edges between touching leaves of cells (r, c, cost, …) that can be crossed, both ways, with weight w.

    Ways lead from a leaf's anchor, the cell at its middle, to the portal where the leaves meet, over it and on to
    the other anchor. pinned cells (r, c), such as endpoints, are leaves of their own.
    """
    if pinned is not None:
        pins = pinned.select("r", "c").distinct().withColumn("_pin", F.lit(True))
        cells = cells.join(pins, ["r", "c"], "left").withColumn("_pin", F.coalesce("_pin", F.lit(False)))
        fine = fine | F.col("_pin")
    leaves = mesh(cells, F.coalesce(fine, F.lit(True)), keep=("cost",)).where("cost IS NOT NULL")
    own = ["leaf_r", "leaf_c", "size", "cost"]
    last = lambda x: F.col(f"leaf_{x}") + F.col("size") - 1
    # a leaf's inner cells touch no other leaf
    rim = (F.col("r") == F.col("leaf_r")) | (F.col("r") == last("r")) | (F.col("c") == F.col("leaf_c")) | (F.col("c") == last("c"))
    e = neighbours(materialize(leaves.where(rim), "leaves"), own).where("leaf_r <> to_leaf_r OR leaf_c <> to_leaf_c").select(*own, *[f"to_{x}" for x in own]).distinct()
    out_r, in_r = geo.portal(F.col("leaf_r"), F.col("size"), F.col("to_leaf_r"), F.col("to_size"))
    out_c, in_c = geo.portal(F.col("leaf_c"), F.col("size"), F.col("to_leaf_c"), F.col("to_size"))
    middle = lambda low, size: F.col(low) + F.floor((F.col(size) - 1) / 2)
    e = e.withColumns({"_xr": out_r, "_er": in_r, "_xc": out_c, "_ec": in_c})
    leave = geo.octile(F.col("_xr") - middle("leaf_r", "size"), F.col("_xc") - middle("leaf_c", "size")) * F.col("cost")
    cross = geo.octile(F.col("_er") - F.col("_xr"), F.col("_ec") - F.col("_xc")) * (F.col("cost") + F.col("to_cost")) / 2
    enter = geo.octile(middle("to_leaf_r", "to_size") - F.col("_er"), middle("to_leaf_c", "to_size") - F.col("_ec")) * F.col("to_cost")
    return e.withColumn("w", leave + cross + enter).drop("_xr", "_er", "_xc", "_ec")


def neighbours(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Every cell with those of its 8 neighbours that exist: columns of both, the neighbour's after ``to_``.

    Written cells take so little room that Spark would broadcast millions of them; so they are joined by sorting.
    """
    turn = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    each = cells.select("r", "c", *columns, turn.alias("_t")).withColumns({"to_r": F.col("r") + F.col("_t.dr"), "to_c": F.col("c") + F.col("_t.dc")}).drop("_t")
    return each.join(cells.select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), *[F.col(x).alias(f"to_{x}") for x in columns]).hint("merge"), ["to_r", "to_c"])
