"""Legs over the mesh beside searches of the fine grid."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import graph, legs


def _cost(slope, lower=20):
    return None if slope is None or slope >= 35 else 4.0 if slope >= 30 else 1.8 if slope >= 25 else 1.3 if slope >= lower else 1.0


def _grid(cost, start):
    """Least costs of all cells over single steps."""
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d > best[r, c]:
            continue
        for to in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]:
            if cost.get(to) is not None and (new := d + 10 * math.hypot(to[0] - r, to[1] - c) * (cost[r, c] + cost[to]) / 2) < best.get(to, math.inf) - 1e-12:
                best[to] = new
                heapq.heappush(heap, (new, to))
    return best


def _walked(cost, path):
    return sum(10 * math.dist(a, b) * (cost[a] + cost[b]) / 2 for a, b in zip(path, path[1:], strict=False))


def _legs(spark, slope, ends, tile, lower=20):
    """costs and paths by (source, target) for ends (source, (r, c), target, (r, c))."""
    cells = spark.createDataFrame([(r, c, s, _cost(s, lower)) for (r, c), s in slope.items()], "r int, c int, slope double, cost double")
    sources = spark.createDataFrame(sorted({(s, *a) for s, a, _, _ in ends}), "source long, r int, c int")
    targets = spark.createDataFrame([(s, t, *b) for s, _, t, b in ends], "source long, target long, r int, c int")
    costs, walks = legs.legs(cells, F.coalesce(F.col("slope") >= 15, F.lit(True)), sources, targets, tile)
    paths = {}
    for r in walks.orderBy("source", "target", "seq").collect():
        paths.setdefault((r["source"], r["target"]), []).append((r["r"], r["c"]))
    return {(r["source"], r["target"]): r["cost"] for r in costs.collect()}, paths


def _check(cost, ends, costs, paths):
    at = {(s, t): (a, b) for s, a, t, b in ends}
    assert set(costs) == set(paths)
    for k, path in paths.items():
        assert (path[0], path[-1]) == at[k]
        assert all(cost[x] is not None for x in path)
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:], strict=False))
        assert math.isclose(_walked(cost, path), costs[k], rel_tol=1e-9, abs_tol=1e-9)


def test_steep_band_within_three_percent_of_the_fine_grid(spark):
    pick = random.Random(0)
    slope = {(r, c): 40.0 if 75 <= r < 85 and 70 <= c < 90 else 24 + 8 * pick.random() if 60 <= r < 100 and 40 <= c < 120 else 8.0 for r in range(160) for c in range(160)}
    ends = [(1, (80, 5), 1, (80, 155)), (1, (80, 5), 2, (3, 120)), (2, (150, 150), 1, (5, 9)), (2, (150, 150), 3, (80, 60))]
    cost = {k: _cost(s) for k, s in slope.items()}
    costs, paths = _legs(spark, slope, ends, 96)
    assert len(costs) == 4
    _check(cost, ends, costs, paths)
    for source, start in ((1, (80, 5)), (2, (150, 150))):
        best = _grid(cost, start)
        for s, _, t, b in ends:
            assert s != source or best[b] - 1e-6 <= costs[s, t] < (1.03 if (s, t) == (1, 1) else 1.05) * best[b]


@pytest.mark.parametrize("tile", [16, 256])
def test_fine_mesh_is_the_grid_and_other_parts_are_out_of_reach(spark, tile):
    pick = random.Random(9)
    slope = {(r, c): 40.0 if c == 11 else pick.choice([16.0, 24.0, 27.0, 32.0]) for r in range(17) for c in range(23)}
    ends = [(1, (0, 0), t, b) for t, b in enumerate([(0, 0), (0, 10), (16, 10), (16, 22), (3, 11)])] + [(2, (5, 11), 0, (0, 0))]
    cost = {k: _cost(s) for k, s in slope.items()}
    costs, paths = _legs(spark, slope, ends, tile)
    assert set(costs) == {(1, 0), (1, 1), (1, 2)}
    _check(cost, ends, costs, paths)
    best = _grid(cost, (0, 0))
    assert all(math.isclose(costs[1, t], best[b], abs_tol=1e-9) for s, _, t, b in ends if (s, t) in costs)


def test_ends_of_one_leaf_are_pinned(spark):
    slope = {(r, c): 40.0 if c == 32 else 8.0 for r in range(32) for c in range(48)}
    ends = [(1, (0, 0), 1, (0, 0)), (1, (0, 0), 2, (0, 1)), (2, (0, 15), 3, (0, 16)), (2, (0, 15), 4, (0, 40)), (3, (15, 15), 5, (15, 16))]
    costs, paths = _legs(spark, slope, ends, 16)
    assert {k: round(v, 6) for k, v in costs.items()} == {(1, 1): 0, (1, 2): 10, (2, 3): 10, (3, 5): 10}
    _check({k: _cost(s) for k, s in slope.items()}, ends, costs, paths)


def test_leaves_of_all_sizes_and_their_edges(spark):
    pick = random.Random(10)
    slope = {(r, c): pick.choice([16.0, 24.0, 32.0, 40.0, None]) if 16 <= r < 27 and 9 <= c < 21 else 32.0 if 40 <= r < 45 and 45 <= c < 49 else 8.0 for r in range(65) for c in range(79)}
    cells = spark.createDataFrame([(*k, s, _cost(s)) for k, s in slope.items()], "r int, c int, slope double, cost double")
    fine = F.coalesce(F.col("slope") >= 15, F.lit(True))
    leaf = {(x["r"], x["c"]): (x["leaf_r"], x["leaf_c"], x["size"]) for x in graph.mesh(cells, fine).collect()}
    assert len(leaf) == len(slope) and {x[2] for x in leaf.values()} == {1, 2, 4, 8, 16}
    for (r, c), (a, b, n) in leaf.items():
        assert a <= r < a + n and b <= c < b + n and a % n == b % n == 0
        assert n == 1 or (slope[r, c] is not None and slope[r, c] < 15 and leaf[a, b] == (a, b, n))
    want = {(leaf[r, c][:2], leaf[to][:2]) for (r, c), s in slope.items() if _cost(s) is not None for to in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)] if to in leaf and leaf[to] != leaf[r, c] and _cost(slope[to]) is not None}
    edges = {((x["leaf_r"], x["leaf_c"]), (x["to_leaf_r"], x["to_leaf_c"])): x["w"] for x in graph.mesh_graph(cells, fine).collect()}
    assert set(edges) == want and all(math.isclose(w, edges[b, a]) for (a, b), w in edges.items())


def test_other_cost_classes_and_pins_part_leaves(spark):
    slope = {(r, c): 12.0 if r < 16 and c < 8 else 8.0 for r in range(33) for c in range(37)}
    cells = spark.createDataFrame([(*k, s, _cost(s, 10)) for k, s in slope.items()], "r int, c int, slope double, cost double")
    pins = [(0, 15), (0, 16), (32, 36)]
    leaf = {(x["r"], x["c"]): (x["leaf_r"], x["leaf_c"], x["size"]) for x in graph.mesh(cells, (F.col("slope") >= 15) | F.concat_ws(",", "r", "c").isin([f"{r},{c}" for r, c in pins])).collect()}
    assert all(leaf[p] == (*p, 1) for p in pins)
    assert all(len({_cost(slope[k], 10) for k, x in leaf.items() if x == one}) == 1 for one in set(leaf.values()))


def test_line_keeps_detours_and_heights(spark):
    way = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (1, 6), (1, 7), (0, 8)]
    cells = spark.createDataFrame([(1, i, r, c, 100.0 + i) for i, (r, c) in enumerate(way)] + [(2, 0, 5, 5, 1.0)], "leg int, seq int, r int, c int, z double")
    got = [(x["leg"], x["place"], x["r"], x["c"], x["z"]) for x in legs.cell_line(cells, ["leg"], 8).orderBy("leg", "place").collect()]
    assert got[-2:] == [(2, 0, 5, 5, 1.0), (2, 1, 5, 5, 1.0)]
    line = [(r, c) for leg, _, r, c, _ in got if leg == 1]
    assert line == [(0, 0), (0, 3), (1, 4), (1, 7), (0, 8)] and [x[4] for x in got[:5]] == [100.0, 103.0, 104.0, 107.0, 108.0]
    straight = spark.createDataFrame([(1, i, 0, i, 0.0) for i in range(21)], "leg int, seq int, r int, c int, z double")
    assert [x["c"] for x in legs.cell_line(straight, ["leg"], 8).orderBy("place").collect()] == [0, 8, 16, 20]


def test_leg_stats(spark):
    rows = [(1, 0, 0, 0, 100.0, 8.0), (1, 1, 0, 1, 110.0, 26.0), (1, 2, 1, 2, None, None), (1, 3, 1, 3, 90.0, 31.0), (2, 0, 4, 4, 5.0, 1.0)]
    cells = spark.createDataFrame(rows, "leg int, seq int, r int, c int, z double, slope double")
    got = {r["leg"]: r for r in legs.leg_stats(cells, ["leg"]).collect()}
    assert got[1]["gain_m"] == 10 and got[1]["loss_m"] == 0 and math.isclose(got[1]["length_m"], math.hypot(10, 10)) and got[1]["max_slope"] == 31
    assert got[2]["length_m"] == 0 and got[2]["hours"] == 0 and got[2]["n_cells"] == 1
