"""Operators without SQL beside brute force, and the cases that tables of the driver don't hold."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators import costs, flow, graph, paths, spatial, sun
from ridgeline.plans import catalog
from ridgeline.sources import readers, sinks
from ridgeline.sources.fixtures import side
from ridgeline.sources.tables import table


def _customers(spark, sf_dir):
    n = side(spark, sf_dir)
    return [(r[0], r[0] * 3571 % (10 * n), (r[0] * 6007 + 11) % (10 * n), r[1]) for r in table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").collect()]


def test_greedy_apart(spark, sf_dir):
    kept = []
    for i, x, y, _ in sorted(_customers(spark, sf_dir), key=lambda p: (-p[3], p[0])):
        if all(math.hypot(x - a, y - b) >= 25 for _, a, b in kept):
            kept.append((i, x, y))
    rows = catalog.QUERIES["greedy_apart"](spark, sf_dir).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [k[0] for k in kept]


def test_distinct_runs(spark):
    rows = [(i, f"s{i % 3}", float(i * 37 % 101), float(i * 53 % 400), float(i * 71 % 400), float(i * 13 % 300), float(i * 29 % 300)) for i in range(60)]
    runs = spark.createDataFrame(rows, "run long, summit string, band double, x double, y double, top_x double, top_y double")
    want = []
    for s in ("s0", "s1", "s2"):
        own = []
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[2], r[0])):
            if len(own) < 4 and all(math.hypot(r[3] - o[3], r[4] - o[4]) >= 60 for o in own):
                own.append(r)
        want += own
    found = spatial.distinct_by_end(runs, 60.0, 4)
    assert sorted(r["run"] for r in found.collect()) == sorted(r[0] for r in want)
    merged = []
    for r in sorted(want):
        for m in merged:
            if math.hypot(r[3] - m[0][3], r[4] - m[0][4]) < 100 and math.hypot(r[5] - m[0][5], r[6] - m[0][6]) < 200:
                m[1].add(r[1])
                break
        else:
            merged.append((r, {r[1]}))
    assert {(r["run"], r["summits"]) for r in spatial.merge_twins(found, 100.0, 200.0).collect()} == {(m[0][0], ",".join(sorted(m[1]))) for m in merged}


def _cheapest(cost, start):
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d > best[r, c]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                to = (r + a, c + b)
                if (a or b) and cost.get(to) is not None:
                    new = d + 10 * math.hypot(a, b) * (cost[r, c] + cost[to]) / 2
                    if new < best.get(to, math.inf):
                        best[to] = new
                        heapq.heappush(heap, (new, to))
    return best


def test_raster_costs_and_ways(spark):
    cost = {(r, c): None if c == 11 and r != 20 else 1.0 + (r * 7 + c * 3) % 5 for r in range(30) for c in range(23)}
    cells = spark.createDataFrame([(*k, v) for k, v in cost.items()], "r int, c int, cost double")
    start = spark.createDataFrame([(1, 0, 0), (2, 29, 22), (3, 4, 11)], "source long, r int, c int")
    found = graph.materialize(costs.raster_costs(cells, start, tile=8), "found")
    got = {(r["source"], r["r"], r["c"]): r["best"] for r in found.collect()}
    want = {(s, *k): v for s, at in ((1, (0, 0)), (2, (29, 22))) for k, v in _cheapest(cost, at).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    target = spark.createDataFrame([(1, 3, 20), (2, 3, 3)], "source long, r int, c int")
    for source, end, to in ((1, (0, 0), (3, 20)), (2, (29, 22), (3, 3))):
        way = [(r["r"], r["c"]) for r in costs.ways(found, target).where(F.col("source") == source).orderBy("seq").collect()]
        assert way[0] == to and way[-1] == end and all(max(abs(a - x), abs(b - y)) == 1 for (a, b), (x, y) in zip(way, way[1:], strict=False))
        length = sum(10 * math.hypot(a - x, b - y) * (cost[a, b] + cost[x, y]) / 2 for (a, b), (x, y) in zip(way, way[1:], strict=False))
        assert abs(length - want[(source, *to)]) < 1e-6


def test_faces_by_brute_force(spark):
    """A plane of 25 degrees with a steep block and a gap: faces above and below the block, between rows that are out of the band."""
    t = 10 * math.tan(math.radians(25))
    rows = [(r, c, 2000 - r * t + 0.001 * abs(c - 20), 25.0, 180.0, not 30 <= r < 34, not 30 <= r < 34 and r % 10 != 9) for r in range(60) for c in range(41)]
    cells = spark.createDataFrame(rows, "r int, c int, z double, slope double, aspect double, ok boolean, counted boolean")
    lines = {(r["r"], r["c"]): r for r in flow.fall_line(cells).collect()}
    step = 10 / math.cos(math.radians(25))
    assert abs(lines[0, 20]["total_len"] - 29 * step) < 1e-2 and abs(lines[0, 20]["band_len"] - 27 * step) < 1e-2
    assert (29, 20) not in lines and abs(lines[34, 20]["total_len"] - 25 * step) < 1e-2
    traced = flow.traced(cells, spark.createDataFrame([(0, 20), (34, 3)], "r int, c int"))
    seqs = {k: sorted(r["seq"] for r in traced.collect() if (r["top_r"], r["top_c"]) == k) for k in ((0, 20), (34, 3))}
    assert seqs == {(0, 20): list(range(29)), (34, 3): list(range(25))}
    found = flow.faces(cells, 100.0, 20.0, 30.0).orderBy("face").collect()
    assert [(r["top_r"], r["cells"]) for r in found] == [(0, 29), (10, 19), (34, 25), (40, 19)]  # rows out of the band part the tops
    assert flow.faces(cells.where("false"), 100.0, 20.0, 30.0).count() == 0


def test_profile_of_a_run(spark):
    run = [(0, 0, 100.0, 0), (1, 1, 90.0, 2), (2, 1, 85.0, 1), (3, 1, 80.0, 2), (3, 2, 70.0, 0)]
    rows = [(0, 0, i, r, c, z, f) for i, (r, c, z, f) in enumerate(run)] + [(9, 9, 0, 9, 9, 50.0, 0)]
    runs = spark.createDataFrame(rows, "top_r int, top_c int, seq int, r int, c int, z double, forest int")
    got = {(r["top_r"], r["top_c"]): r for r in flow.profiled(runs).collect()}
    one = got[0, 0]
    assert one["drop"] == 30 and math.isclose(one["length_m"], 30 + 10 * math.sqrt(2)) and one["forest_share"] == 60 and one["forest_type"] == 2 and tuple(one["middle"]) == (2, 1, 85.0)
    assert got[9, 9]["length_m"] == 0 and got[9, 9]["forest_type"] is None and tuple(got[9, 9]["middle"]) == (9, 9, 50.0)


def test_horizon_is_unknown_with_any_sample(spark):
    flat = [(r, c, 100.0 if r else None) for r in range(20) for c in range(20)]
    cells = spark.createDataFrame(flat, "r int, c int, z double")
    at = spark.createDataFrame([(1, 95.0, 105.0, 100.0)], "id int, x double, y double, z double")
    got = {r["bearing"]: r["angle"] for r in sun.horizons(at, cells, "id", [0, 90, 180], [20, 40, 90], 0.0, 200.0).collect()}
    assert got == {0.0: None, 90.0: 0.0, 180.0: 0.0}
    far = {r["bearing"]: r["angle"] for r in sun.horizons(at, cells, "id", [0, 90], [20, 120], 0.0, 200.0).collect()}
    assert far == {0.0: None, 90.0: None}


def test_civil_time_and_noon(spark):
    days = spark.createDataFrame([("2026-01-15",), ("2026-07-15",), ("2026-03-29",)], "day string")
    rows = days.select("day", F.date_format(geo.local_instant(F.to_date("day"), F.lit(12)), "HH:mm").alias("utc")).collect()
    assert {r["day"]: r["utc"] for r in rows} == {"2026-01-15": "11:00", "2026-07-15": "10:00", "2026-03-29": "10:00"}
    noon = days.select(*[x.alias(n) for x, n in zip(geo.solar(F.lit(62.5), F.lit(9.0), F.unix_seconds(geo.local_instant(F.to_date("day"), F.lit(12.4)))), ("az", "el"), strict=True)]).first()
    assert abs(noon["az"] - 180) < 6 and 0 < noon["el"] < 10


def test_projection_round_trip(spark):
    e, n = geo.utm33(F.lit(9.55151), F.lit(62.67671))
    lon, lat = geo.lonlat(F.col("e"), F.col("n"))
    row = spark.range(1).select(e.alias("e"), n.alias("n")).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(row["lon"] - 9.55151) < 1e-8 and abs(row["lat"] - 62.67671) < 1e-8


def test_scan_goes_on_where_it_stopped(spark, tmp_path):
    seen = []

    def work(open_):
        seen.append(sorted((r["block_x"], r["block_y"]) for r in open_.collect()))
        return open_.where("block_x <> 2").withColumn("legs", F.lit(5))

    blocks = lambda *x: spark.createDataFrame([(i, 0) for i in x], "block_x long, block_y long")
    path = str(tmp_path / "scan")
    assert sinks.scan_blocks(blocks(1, 2), work, path).count() == 1
    assert sorted(r["block_x"] for r in sinks.scan_blocks(blocks(1, 2, 3), work, path).collect()) == [1, 3]
    assert sinks.scan_blocks(blocks(1), work, path).count() == 1
    assert seen == [[(1, 0), (2, 0)], [(3, 0)]]


@pytest.mark.parametrize(
    ("xml", "points"),
    [
        ("<gpx><trk><trkseg><trkpt lat='1' lon='2'/><trkpt lat='3' lon='4'/></trkseg></trk></gpx>", 2),
        ("<gpx xmlns='u'><trk><name>Down</name><trkseg><trkpt lat='1' lon='2'/></trkseg></trk><trk><name>Up a</name><trkseg><trkpt lat='5' lon='6'/></trkseg></trk></gpx>", 1),
        ("<gpx><trk><trkseg><trkpt lat='1' lon='2'/></trkseg><trkseg><trkpt lat='1' lon='2'/></trkseg></trk></gpx>", 0),
        ("<gpx><rte><rtept lat='1' lon='2'/><rtept lat='1' lon='2'/><rtept lat='1' lon='2'/></rte></gpx>", 3),
        ("<gpx/>", 0),
    ],
)
def test_gpx_reader(spark, xml, points):
    assert readers.gpx_points(spark.createDataFrame([(1, xml)], "id int, xml string"), "xml").count() == points


def test_long_gpx_is_left_out(spark):
    docs = spark.createDataFrame([(1, "<gpx><trk><trkseg><trkpt lat='1' lon='2'/></trkseg></trk></gpx>")], "id int, xml string")
    assert readers.gpx_points(docs, "xml", most=10).count() == 0


def test_nearest_with_a_point_far_from_all(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 50_000.0, 50_000.0), (3, None, 1.0)], "id int, x double, y double")
    right = spark.createDataFrame([(i, float(i), 0.0) for i in range(50)], "road int, x double, y double")
    got = {r["id"]: r["nearest_road"] for r in spatial.nearest(left, right, "id", "road", 10.0).collect()}
    assert got == {1: 0, 2: 49, 3: None}
    assert [r["nearest_road"] for r in spatial.nearest(left, right.limit(0), "id", "road", 10.0).collect()] == [None] * 3


def test_far_points_descend_to_their_nearest(spark):
    pick = random.Random(4)
    right = [(i, pick.uniform(0, 900), pick.uniform(0, 700)) for i in range(300)] + [(300, 5000.0, -4000.0), (301, 5000.0, -4000.0)]
    left = [(i, pick.uniform(-9000, 9000), pick.uniform(-9000, 9000)) for i in range(80)] + [(80, 5000.0, -4000.0)]
    a = spark.createDataFrame(left, "id int, x double, y double")
    b = spark.createDataFrame(right, "road int, x double, y double")
    for limit in (math.inf, 3000.0):
        got = {r["id"]: (r["nearest_road"], r["distance"]) for r in spatial.nearest(a, b, "id", "road", 10.0, limit).collect()}
        for i, x, y in left:
            d, road = min((math.hypot(x - p, y - q), k) for k, p, q in right)
            assert got[i][0] == (road if d <= limit else None) and (d > limit or abs(got[i][1] - d) < 1e-6)


def test_graph_band_is_stricter(spark):
    s = spark.createDataFrame([(25.0, 25.0), (25.0, 36.0), (34.0, 30.0), (2.0, 10.0), (None, None)], "smooth double, slope double")
    rows = s.select(*flow.graph_flags(F.col("smooth"), F.col("slope"), 20.0, 32.0, 35.0)).collect()
    assert [(r["ok"], r["counted"]) for r in rows] == [(True, True), (False, False), (True, False), (False, False), (False, False)]


def test_paths_head(spark):
    p = spark.createDataFrame([(1, i, 100.0 * (i - 1)) for i in range(1, 8)], "path int, seq int, walked double")
    assert [r["seq"] for r in paths.without_head(p, 300.0).orderBy("seq").collect()] == [4, 5, 6, 7]
