"""Routes, warps, raster files and blocks on small made rasters."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import blocks, routes, terrain, warp
from ridgeline.sources import rasters, sinks


def _route(spark, vertices, height, slope, **limit):
    points = spark.createDataFrame([(p, i, x, y) for p, v in vertices.items() for i, (x, y) in enumerate(v)], "path int, seq int, x double, y double")
    s = routes.resampled(points, **limit).withColumns({"z": height, "slope": slope})
    return {r["path"]: r for r in routes.metrics(s).collect()}


def test_route_of_four_kilometres(spark):
    got = _route(spark, {1: [(0.0, 0.0), (4000.0, 0.0)]}, F.col("x") / 10, F.when((F.col("x") >= 500) & (F.col("x") < 600), 35.0).otherwise(10.0))[1]
    assert got["samples"] == 401 and got["steep_samples"] == 10 and got["max_slope"] == 35 and got["coverage"] == 100 and got["complete"]
    assert math.isclose(got["distance_km"], 4) and math.isclose(got["ascent_m"], 400) and math.isclose(got["hours"], 2) and got["in_target"] is False


def test_route_over_a_gap_has_no_estimate(spark):
    got = _route(spark, {1: [(0.0, 0.0), (1000.0, 0.0)]}, F.when(F.col("x") < 500, 1.0), F.lit(0.0))[1]
    assert got["hours"] is None and got["ascent_m"] is None and got["in_target"] is None and not got["complete"] and 40 < got["coverage"] < 60


def test_odd_routes(spark):
    got = _route(spark, {1: [(5.0, 5.0)], 2: [(1.0, 1.0), (1.0, 1.0), (1.0, 26.0)], 3: [(0.0, 0.0), (None, 1.0)], 4: [(0.0, 0.0), (1000.0, 0.0)]}, F.lit(1.0), F.lit(1.0), most=100)
    assert {k: r["samples"] for k, r in got.items()} == {1: 1, 2: 5}  # an unknown vertex, and a route that is too long, give nothing
    assert got[1]["distance_km"] == 0 and math.isclose(got[2]["distance_km"], 0.025)


def test_warp_of_a_plane_and_over_gaps(spark):
    source = [(0, i, j, 100.0 + 3 * i + 5 * j) for i in range(10) for j in range(6)] + [(1, i, j, None if j == 8 else 900.0) for i in range(10) for j in range(4, 10)]
    src = spark.createDataFrame(source, "tile int, i int, j int, z double")
    at = lambda i, j: (10.0 + (j + 0.5) * 0.1, 60.0 - (i + 0.5) * 0.05)
    places = {(0, 0): (2, 2), (0, 1): (2.25, 2.5), (0, 2): (0, 0), (0, 3): (-0.25, 1), (0, 4): (3, 4.5), (0, 5): (3, 5.5), (0, 6): (3, 7.25), (0, 7): (3, 8), (0, 8): (40, 40)}
    targets = spark.createDataFrame([(*k, *at(*v)) for k, v in places.items()], "r int, c int, lon double, lat double")
    got = {(r["r"], r["c"]): r["z"] for r in warp.warped(targets, src, 10.0, 60.0, 0.1, 0.05).collect()}
    plane = lambda i, j: 100 + 3 * i + 5 * j
    want = {(0, 0): plane(2, 2), (0, 1): plane(2.25, 2.5), (0, 2): 100, (0, 3): plane(0, 1), (0, 4): plane(3, 4.5), (0, 5): plane(3, 5), (0, 6): 900.0}
    assert set(got) - {(0, 7)} == set(want) and all(math.isclose(got[k], v, abs_tol=1e-6) for k, v in want.items())
    primary = spark.createDataFrame([(0, 0, 5.0), (0, 1, None), (0, 8, None)], "r int, c int, z double")
    filled = {(r["r"], r["c"]): (r["z"], r["coarse"]) for r in warp.filled(primary, spark.createDataFrame([(0, 0, 7.0), (0, 1, 8.0)], "r int, c int, z double")).collect()}
    assert filled == {(0, 0): (5.0, False), (0, 1): (8.0, True), (0, 8): (None, False)}


@pytest.mark.parametrize("size", [5, 16, 64])
def test_blocks_are_the_whole(spark, size):
    rows = [(r, c, None if (r * 7 + c) % 31 == 0 else 900.0 + (r * 13 + c * 29) % 50) for r in range(33) for c in range(21)]
    cells = spark.createDataFrame(rows, "r int, c int, z double")
    work = lambda df, tile: terrain.box_extremes(terrain.box_mean(terrain.derivatives(df, tile=tile), "slope", 90.0, tile), 3, 2, tile)
    columns = ["r", "c", "z", "slope", "aspect", "smooth", "high", "low"]
    whole = sorted(map(str, work(cells, []).select(columns).collect()))
    assert sorted(map(str, blocks.by_block(cells, size, 3, work).select(columns).collect())) == whole and len(whole) == len(rows)


def test_failed_blocks_stop_no_other(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, 0, i) for i in range(9)], "block_x long, block_y long, v long")
    seen = str(tmp_path / "seen")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        from pathlib import Path

        k = int(frame["block_x"].iloc[0])
        Path(seen).mkdir(exist_ok=True)
        with (Path(seen) / str(k)).open("a") as f:
            f.write("x")
        if k == 1 and len((Path(seen) / "1").read_text()) < 3:
            raise KeyError("lost")
        return pd.DataFrame({"total": [int(frame["v"].sum())]}) if k != 2 else pd.DataFrame({"total": pd.Series([], dtype="int64")})

    path = str(tmp_path / "out")
    for tries in (1, 2):
        assert {(r["block_x"], r["total"]) for r in sinks.work_blocks(rows, work, "total long", path).collect()} == {(0, 9)}
        assert [(r["block_x"], r["tries"], r["error"]) for r in sinks.failed_blocks(spark, path).collect()] == [(1, tries, "KeyError: 'lost'")]
    assert {(r["block_x"], r["total"]) for r in sinks.work_blocks(rows, work, "total long", path).collect()} == {(0, 9), (1, 12)}
    assert sinks.failed_blocks(spark, path).isEmpty()
    assert {k: len((tmp_path / "seen" / k).read_text()) for k in "012"} == {"0": 1, "1": 3, "2": 1}  # a block without results is done too


def test_grids_that_cannot_be_read_are_missing(spark, tmp_path):
    cells = spark.createDataFrame([(r // 4, c // 4, r, c, None if (r, c) == (1, 1) else 20000.0 if (r, c) == (2, 2) else r + c / 8) for r in range(6) for c in range(8)], "ti int, tj int, r int, c int, z double")
    path = str(tmp_path / "grids")
    rasters.write_grids(cells, path, 1000.0, 5000.0)
    files = {(i, j): next((tmp_path / "grids" / f"ti={i}" / f"tj={j}").glob("part-*")) for i in (0, 1) for j in (0, 1)}
    files[0, 1].write_text(files[0, 1].read_text().replace("cellsize 10.0", "cellsize 20.0"))
    files[1, 0].write_text(files[1, 0].read_text().replace("4.125", "four"))
    (tmp_path / "grids" / "ti=0" / "tj=1" / f".{files[0, 1].name}.crc").unlink()
    (tmp_path / "grids" / "ti=1" / "tj=0" / f".{files[1, 0].name}.crc").unlink()
    got = {(r["ti"], r["tj"], r["r"], r["c"]): r["z"] for r in rasters.read_grids(spark, path, 4, 1000.0, 5000.0, (6, 8)).collect()}
    want = {(r // 4, c // 4, r, c): None if (r, c) in ((1, 1), (2, 2)) else r + c / 8 for r in range(6) for c in range(8) if (r // 4, c // 4) in ((0, 0), (1, 1))}
    assert got == want | {(0, 1, None, None): None, (1, 0, None, None): None}
    only = rasters.read_grids(spark, path, 4, 1000.0, 5000.0, (6, 8), only=F.col("ti") == 1)
    assert {r["ti"] for r in only.collect()} == {1}
