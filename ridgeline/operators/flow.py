"""Fall lines over cells, the runs along them and the faces that they make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators import graph, terrain
from ridgeline.operators.components import connected_components
from ridgeline.sources.scratch import materialize

#: A trace holds its start and at most so many cells more.
LONGEST = 600
#: Sums of one line that are added in different orders are closer than this, in metres.
SLACK = 1e-6


def face_flags(smooth: Column, slope: Column, lower: float, upper: float) -> tuple[Column, Column]:
    """ok and counted for a search of faces: not steeper than the band, and within it."""
    ok = F.coalesce((smooth > 3) & (smooth < upper) & slope.isNotNull(), F.lit(False))
    return ok.alias("ok"), (ok & (smooth > lower)).alias("counted")


def graph_flags(smooth: Column, slope: Column, lower: float, upper: float, most: float) -> tuple[Column, Column]:
    """ok and counted for a tour graph: below the steepest descent both smoothed and raw, and smoothed within the band."""
    ok = F.coalesce((smooth > 3) & (smooth < most) & (slope < most), F.lit(False))
    return ok.alias("ok"), (ok & (smooth > lower) & (smooth < upper)).alias("counted")


def node(r: str | Column, c: str | Column) -> Column:
    r, c = (F.col(x) if isinstance(x, str) else x for x in (r, c))
    return F.shiftleft(r.cast("long"), 32) + c


def row(x: str) -> Column:
    return F.shiftright(x, 32).cast("int")


def column(x: str) -> Column:
    return F.col(x).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def steps(cells: DataFrame, res: float = 10.0) -> DataFrame:
    """(node, next, total_len, total_drop, band_len, band_drop) of the cells (r, c, z, ok, counted) that go on downhill.

    A step into ground where a run can't go on contributes nothing and ends the chain, so it isn't one.
    """
    d = terrain.downhill(cells).where("ok AND dr IS NOT NULL").select("r", "c", "gain", "counted", (F.col("r") + F.col("dr")).alias("to_r"), (F.col("c") + F.col("dc")).alias("to_c"), (F.col("dr") * F.col("dc") != 0).alias("slanted"))
    go = cells.where("ok").select(F.col("r").alias("to_r"), F.col("c").alias("to_c"))
    d = d.join(go, ["to_r", "to_c"], "left_semi")
    flat = F.when(F.col("slanted"), res * 2**0.5).otherwise(res)
    drop = F.col("gain") * flat
    d = d.select(node("r", "c").alias("node"), node("to_r", "to_c").alias("next"), "counted", F.sqrt(drop * drop + flat * flat).alias("total_len"), drop.alias("total_drop"))
    inside = lambda x: F.when(F.col("counted"), F.col(x)).otherwise(0.0)
    return d.select("node", "next", "total_len", "total_drop", inside("total_len").alias("band_len"), inside("total_drop").alias("band_drop"))


def fall_line(cells: DataFrame) -> DataFrame:
    """(r, c) and the sums of steps along each cell's fall line."""
    out = graph.accumulate(steps(cells), ["total_len", "total_drop", "band_len", "band_drop"])
    return out.select(row("node").alias("r"), column("node").alias("c"), *out.columns[1:])


def labelled(cells: DataFrame, key: str) -> DataFrame:
    """cells with component, the smallest key of the 8-connected cells they belong to."""
    found = connected_components(graph.neighbours(cells, [key]), key, f"to_{key}")
    return cells.join(found.withColumnRenamed("node", key).hint("merge"), key, "left").withColumn("component", F.coalesce("component", key))


def traced(cells: DataFrame, tops: DataFrame) -> DataFrame:
    """(top_r, top_c, seq) and cells' columns along the fall line from each top to its last counted cell."""
    return _run(cells, graph.follow(tops.select(node("r", "c").alias("node")), steps(cells).select("node", "next"), LONGEST))


def traced_best(cells: DataFrame, least: float, size: int) -> DataFrame:
    """traced() from the cell of each block of size x size with the longest band below it, if that has least metres; the first of equal ones.

    Doubling adds up a line's steps in another order than walking down it does, so lines that a walk makes equal may differ by
    a rounding. Those within SLACK of a block's longest are added up step by step, and that decides.
    """
    st = materialize(steps(cells).select("node", "next", "band_len"), "steps")
    block = [F.floor(row("node") / size).alias("_br"), F.floor(column("node") / size).alias("_bc")]
    lines = materialize(graph.accumulate(st, ["band_len"]).where(F.col("band_len") >= least - SLACK).select("node", "band_len", *block), "long-lines")
    most = lines.groupBy("_br", "_bc").agg(F.max("band_len").alias("most"))
    likely = lines.join(most, ["_br", "_bc"]).where(F.col("band_len") >= F.col("most") - SLACK)
    ways = graph.follow(likely.select("node"), st.select("node", "next"), 1 << 30)
    each = ways.join(st.select("node", "band_len"), "node").groupBy(F.col("start").alias("node")).agg(F.array_sort(F.collect_list(F.struct("seq", "band_len"))).alias("s"))
    each = each.withColumn("band_len", F.aggregate("s", F.lit(0.0), lambda total, x: total + x.band_len)).where(F.col("band_len") >= least)
    first = F.row_number().over(Window.partitionBy(*block).orderBy(F.desc("band_len"), "node"))
    tops = each.withColumn("i", first).where("i = 1").select(F.col("node").alias("start"))
    return _run(cells, ways.where(F.col("seq") <= LONGEST).join(tops, "start", "left_semi"))


def _run(cells: DataFrame, way: DataFrame) -> DataFrame:
    """traced() by its ways (start, seq, node)."""
    way = way.select(row("start").alias("top_r"), column("start").alias("top_c"), "seq", row("node").alias("r"), column("node").alias("c"))
    all_ = materialize(way.join(cells, ["r", "c"]), "traced")
    last = all_.where("counted").groupBy("top_r", "top_c").agg(F.max("seq").alias("last"))
    return all_.join(last, ["top_r", "top_c"]).where("seq <= last").drop("last")


def described(runs: DataFrame, lower: float, upper: float, share: float = 0.6) -> DataFrame:
    """One row a run: its cells, slopes, mean aspect, bottom and share of the band, if these are in bounds."""
    inside = F.avg(F.col("counted").cast("double"))
    g = runs.groupBy("top_r", "top_c").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("slope").alias("mean_slope"), inside.alias("band_share"), F.max("slope").alias("max_slope"),
        F.avg((F.col("slope") >= 30).cast("double")).alias("steep_share"), terrain.circular_mean(F.col("aspect")).alias("aspect"), F.max_by(F.struct("r", "c"), "seq").alias("bottom"),
    )
    g = g.where(F.col("mean_slope").between(lower - 1, upper) & (F.col("band_share") >= share))
    return g.select("*", F.col("bottom.r").alias("bottom_r"), F.col("bottom.c").alias("bottom_c")).drop("bottom")


def faces(cells: DataFrame, least: float, lower: float, upper: float, top_cells: int = 5) -> DataFrame:
    """Components of counted cells with least metres of band below them, each with its best run, if that is in bounds."""
    lines = materialize(fall_line(cells), "fall-lines")
    tops = lines.where(F.col("band_len") >= least).join(cells.where("counted").select("r", "c"), ["r", "c"]).withColumn("id", node("r", "c"))
    labels = labelled(tops.select("r", "c", "band_len", "id"), "id")
    best = F.max(F.struct("band_len", (-F.col("id")).alias("back"))).alias("best")
    each = labels.groupBy("component").agg(F.count(F.lit(1)).alias("top_cells"), best).where(F.col("top_cells") >= top_cells)
    each = each.withColumn("id", -F.col("best.back")).select(F.col("component").alias("face"), "top_cells", "best.band_len", row("id").alias("r"), column("id").alias("c"))
    each = materialize(each, "faces")
    g = described(traced(cells, each.select("r", "c")), lower, upper)
    return each.join(g, (each["r"] == g["top_r"]) & (each["c"] == g["top_c"])).drop("r", "c")


def profiled(runs: DataFrame, res: float = 10.0) -> DataFrame:
    """Of traced runs (top_r, top_c, seq, r, c, z, forest) one row each: ends and drop, length on the map, forest and the cell in the middle.

    forest_share is in whole percent, forest_type the code above 0 that most cells have (the smallest at ties).
    """
    own = ["top_r", "top_c"]
    w = Window.partitionBy(*own).orderBy("seq")
    flat = res * F.sqrt((F.pow(F.col("r") - F.lag("r").over(w), 2) + F.pow(F.col("c") - F.lag("c").over(w), 2)).cast("double"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*own))
    rows = runs.withColumns({"_flat": flat, "_n": n})
    out = rows.groupBy(*own).agg(
        F.min_by("z", "seq").alias("top_z"), F.max_by("z", "seq").alias("bottom_z"), F.coalesce(F.sum("_flat"), F.lit(0.0)).alias("length_m"),
        F.floor(100 * F.avg((F.col("forest") > 0).cast("double")) + 0.5).alias("forest_share"), F.max(F.when(F.col("seq") == F.floor(F.col("_n") / 2), F.struct("r", "c", "z"))).alias("middle"),
    )
    kinds = rows.where("forest > 0").groupBy(*own, "forest").count()
    kinds = kinds.groupBy(*own).agg(F.min(F.struct((-F.col("count")).alias("n"), "forest"))["forest"].alias("forest_type"))
    return out.join(kinds, own, "left").withColumn("drop", F.col("top_z") - F.col("bottom_z"))
