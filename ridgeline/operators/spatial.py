"""Distance joins of points (x, y) in metres by grid buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.scratch import Growing, discard, materialize

#: Rings that nearest() searches before points count as far.
RINGS = 4


def distance(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return F.sqrt(dx * dx + dy * dy)


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (l.*, r.*, d) at most radius apart. The right side is dealt into its bucket and the 8 around it."""
    bx, by = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    far = right.withColumn("_dx", around).withColumn("_dy", around).withColumns({"_bx": bx + F.col("_dx"), "_by": by + F.col("_dy")}).drop("_dx", "_dy")
    pairs = left.withColumns({"_bx": bx, "_by": by}).alias("l").join(far.alias("r"), ["_bx", "_by"]).withColumn("d", distance("l", "r"))
    return pairs.where(F.col("d") <= radius)


def nearest(left: DataFrame, right: DataFrame, key: str, order: str, step: float, limit: float = float("inf")) -> DataFrame:
    """left with nearest_<order> and distance: the closest right point, the smallest order at ties.

    Rings double until the left points that have a right one so near have found their own; limit leaves points without a
    close one null. Before a ring is searched in full, each open point meets one point of each bucket around it: points
    with none near wait for a wider ring, and of the others' pairs those beyond the closest of these go before they are
    grouped. Points that RINGS rings leave open are far from all: they look into ever smaller squares instead.
    """
    names = {f"nearest_{order}": F.lit(None).cast(right.schema[order].dataType), "distance": F.lit(None).cast("double")}
    both = left.select("x", "y").unionByName(right.select("x", "y"))
    box = both.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    if box[0] is None or right.isEmpty():
        return left.withColumns(names)
    most = min(limit, (box[0] ** 2 + box[1] ** 2) ** 0.5 + 1.0)
    points = right.select(order, "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    open_, found, radius = materialize(left.select(key, "x", "y").where("x IS NOT NULL AND y IS NOT NULL"), "open-points"), None, step
    for _ in range(RINGS):
        radius = min(radius, most)
        bucket = [F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)]
        some = points.groupBy(*[b.alias(n) for b, n in zip(bucket, ("_i", "_j"), strict=True)]).agg(F.min(F.struct("x", "y")).alias("p")).select("p.*")
        bound = within(open_, some, radius).groupBy(f"l.{key}").agg(F.min("d").alias("bound"))
        reached = materialize(open_.join(bound, key), "bounded-points")
        best = within(reached, points, radius).where(F.col("d") <= F.col("l.bound"))
        best = best.groupBy(f"l.{key}").agg(F.min(F.struct(F.col("d").alias("d"), F.col(f"r.{order}").alias("o"))).alias("best"))
        best = materialize(best, "nearest")
        discard(reached)
        found = found.add(best) if found else Growing(best, "nearest")
        last, open_ = open_, materialize(open_.join(best.select(key), key, "left_anti"), "open-points")
        discard(last)
        if open_.isEmpty():
            break
        radius *= 2
    else:
        found.add(_far(open_, points, key, order, step, most, max(box)))
    return left.join(found.read(), key, "left").withColumns({f"nearest_{order}": F.col("best.o"), "distance": F.col("best.d")}).drop("best")


def _far(open_: DataFrame, points: DataFrame, key: str, order: str, step: float, most: float, extent: float) -> DataFrame:
    """(key, best): each open point's closest of points within most, by a descent through squares that halve down to step.

    A square is known by one of its points; an open point follows the squares that may hold a closer one than
    the closest of these, which are a few on each level.
    """
    levels = max(0, math.ceil(math.log2(max(extent, step) / step)))
    place = lambda x, size: F.floor(F.col(x) / size)
    size = step * 2**levels
    top = points.select(place("x", size).alias("i"), place("y", size).alias("j")).distinct()  # four squares at most, as the size is at least the extent
    at = open_.select(key, "x", "y").crossJoin(F.broadcast(top))
    for level in range(levels, -1, -1):
        size = step * 2**level
        squares = points.groupBy(place("x", size).alias("i"), place("y", size).alias("j")).agg(F.min(F.struct("x", "y")).alias("p"))
        near = at.join(squares, ["i", "j"])
        reach = F.sqrt(F.pow(F.col("x") - F.col("p.x"), 2) + F.pow(F.col("y") - F.col("p.y"), 2))
        gap = lambda x, i: F.greatest(F.col(i) * size - F.col(x), F.col(x) - (F.col(i) + 1) * size, F.lit(0.0))
        least = F.sqrt(F.pow(gap("x", "i"), 2) + F.pow(gap("y", "j"), 2))
        near = materialize(near.select(key, "x", "y", "i", "j", reach.alias("reach"), least.alias("least")), "squares")
        bound = near.groupBy(key).agg(F.least(F.min("reach"), F.lit(most)).alias("bound"))
        kept = near.join(bound, key).where("least <= bound").select(key, "x", "y", "i", "j")
        if level:
            half = F.explode(F.sequence(F.lit(0), F.lit(1)))
            at = kept.withColumn("di", half).withColumn("dj", half).select(key, "x", "y", (2 * F.col("i") + F.col("di")).alias("i"), (2 * F.col("j") + F.col("dj")).alias("j"))
    own = points.select(order, F.col("x").alias("px"), F.col("y").alias("py"), place("x", step).alias("i"), place("y", step).alias("j"))
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))
    return kept.join(own, ["i", "j"]).withColumn("d", d).where(F.col("d") <= most).groupBy(key).agg(F.min(F.struct("d", F.col(order).alias("o"))).alias("best"))


def apart_from(left: DataFrame, right: DataFrame, key: str, radius: float) -> DataFrame:
    """left rows with no right point within radius."""
    near = within(left.select(key, "x", "y"), right.select("x", "y"), radius).select(f"l.{key}").distinct()
    return left.join(near, key, "left_anti")


def _turn(p: str, q: str, r: str) -> Column:
    x, y = lambda n: F.col(f"{n}x"), lambda n: F.col(f"{n}y")
    return F.signum((x(q) - x(p)) * (y(r) - y(p)) - (y(q) - y(p)) * (x(r) - x(p)))


def crossings(legs: DataFrame, lines: DataFrame, size: float) -> DataFrame:
    """(id, other) of legs and lines (id, lon, lat, lon2, lat2) that cross inside both."""
    from ridgeline.sources.readers import hashed

    one = hashed(legs, size).select("cx", "cy", "id", *[F.col(c).alias(n) for c, n in zip(("lon", "lat", "lon2", "lat2"), ("ax", "ay", "bx", "by"), strict=True)])
    two = hashed(lines, size).select("cx", "cy", F.col("id").alias("other"), *[F.col(c).alias(n) for c, n in zip(("lon", "lat", "lon2", "lat2"), ("px", "py", "qx", "qy"), strict=True)])
    cross = (_turn("a", "b", "p") * _turn("a", "b", "q") < 0) & (_turn("p", "q", "a") * _turn("p", "q", "b") < 0)
    return one.join(two, ["cx", "cy"]).where(cross).select("id", "other").distinct()


def greedy_apart(points: DataFrame, key: str, score: str, radius: float) -> DataFrame:
    """(node) that a pass from the highest score down keeps, each nearer than radius to no kept one; ties by key."""
    from ridgeline.operators.graph import largest_apart

    near = within(points, points, radius).where((F.col("d") < radius) & (F.col(f"l.{key}") != F.col(f"r.{key}")))
    first = (F.col(f"r.{score}") > F.col(f"l.{score}")) | ((F.col(f"r.{score}") == F.col(f"l.{score}")) & (F.col(f"r.{key}") < F.col(f"l.{key}")))
    pairs = near.where(first).select(F.col(f"l.{key}").alias("worse"), F.col(f"r.{key}").alias("better"))
    return largest_apart(pairs, points.select(F.col(key).alias("node")))


def distinct_by_end(runs: DataFrame, apart: float, most: int, considered: int = 400) -> DataFrame:
    """Of each summit's considered longest runs (summit, run, band, x, y), at most most whose ends are apart; the longer first.

    A summit's runs meet in one task; there are no more than considered of them.
    """
    import pandas as pd
    from pyspark.sql import Window

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        for i in frame.assign(_i=range(len(frame))).sort_values(["band", "run"], ascending=[False, True])["_i"]:
            if all((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 >= apart * apart for j in kept):
                kept.append(i)
            if len(kept) == most:
                break
        return frame.iloc[kept]

    rank = F.row_number().over(Window.partitionBy("summit").orderBy(F.desc("band"), "run"))
    top = runs.withColumn("_rank", rank).where(F.col("_rank") <= considered).drop("_rank")
    return top.groupBy("summit").applyInPandas(choose, top.schema)


def merge_twins(runs: DataFrame, end: float, top: float) -> DataFrame:
    """(run, summits): a run whose end and top are close to those of an earlier one that stands gives it its summit."""
    from ridgeline.operators.graph import largest_apart

    near = within(runs, runs, end).where("d < %r" % end)
    dx, dy = F.col("l.top_x") - F.col("r.top_x"), F.col("l.top_y") - F.col("r.top_y")
    near = near.where((F.sqrt(dx * dx + dy * dy) < top) & (F.col("r.run") < F.col("l.run")))
    pairs = materialize(near.select(F.col("l.run").alias("worse"), F.col("r.run").alias("better")), "twins")
    kept = largest_apart(pairs, runs.select(F.col("run").alias("node")))
    to = pairs.join(kept.select(F.col("node").alias("better")), "better", "left_semi").groupBy("worse").agg(F.min("better").alias("into"))
    own = runs.select("run", "summit").join(to.withColumnRenamed("worse", "run"), "run", "left")
    return own.groupBy(F.coalesce("into", "run").alias("run")).agg(F.array_join(F.sort_array(F.collect_set("summit")), ",").alias("summits"))
