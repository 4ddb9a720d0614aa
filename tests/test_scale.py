"""Plans and numbers that only large tables need."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from ridgeline.operators import components, flow, graph, legs
from ridgeline.plans import catalog, graph_queries
from ridgeline.sources.scratch import materialize


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_cells_of_discs_are_not_broadcast(spark, sf_dir):
    assert "Broadcast" not in _plan(catalog.QUERIES["inspected"](spark, sf_dir))


def test_signature_of_many_edges_stays_in_range(spark):
    edges = spark.range(20_000_000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    assert components._signature(edges)[0] == 20_000_000
    assert components._signature(edges.where("u < 7")) != components._signature(edges.where("u < 6 OR u = 7"))


def test_best_loops_meet_few_ways_back(spark):
    pick = random.Random(3)
    up = {(f"p{pick.randrange(4)}", f"s{pick.randrange(60)}"): pick.randrange(1, 9) / 10 for _ in range(150)}
    run = {f"s{i}": (f"r{i % 3}", 80.0 * pick.randrange(1, 4)) for i in range(60)}
    back = {(f"r{pick.randrange(3)}", f"p{pick.randrange(2, 12)}"): pick.randrange(1, 9) / 10 for _ in range(40)}
    loops = [(p, (p != e, u + band / 8000 + b, -band, s, r, e)) for (p, s), u in up.items() for r, band in [run[s]] for (q, e), b in back.items() if q == r]
    expected = {(p, i + 1, s, r, e, round(h, 4), not opens) for p in {x for x, _ in up} for i, (opens, h, _, s, r, e) in enumerate(sorted(k for q, k in loops if q == p)[:5])}
    found = graph_queries.best_loops(
        spark.createDataFrame([(*k, v) for k, v in up.items()], "parking string, summit string, up double"),
        spark.createDataFrame([(k, *v) for k, v in run.items()], "summit string, run string, band double"),
        spark.createDataFrame([(*k, v) for k, v in back.items()], "run string, end string, back double"),
    )
    assert {tuple(r) for r in found.collect()} == expected
    # two windows: ways up are cut before they meet the ways back
    assert len(re.findall(r"Window \[", _plan(found))) == 2


def test_blocks_that_end_five_kilometres_before_a_vertex(spark, tmp_path):
    # path 3 has a block that ends just 5 km before it; so has path 0, but the lattice begins above that one
    rows = [(0, 0, "view", 12.5), (1, 3, "view", 80.25), (2, 5, "view", 80.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = Counter(con.execute(catalog.ORACLE_SQL["corridor_blocks"]).fetchall())
    assert Counter(tuple(r) for r in catalog.QUERIES["corridor_blocks"](spark, str(tmp_path)).collect()) == expected


def test_first_of_lines_that_a_walk_makes_equal(spark):
    # column 0 goes down by the same steps as column 16, behind other ones that are not in the band
    drops = [2.7, 8.2, 1.8, 4.2, 2.5, 7.3, 6.7]
    cells = [(r, c, 5000.0, False, False, 25.0, 180.0) for r in range(10) for c in range(48) if c % 16 or r > 7 + c // 16]  # walls
    for c in range(0, 48, 16):
        z = 1000.0
        for r, drop in enumerate([9.0] * (c // 16) + drops + [0.0]):
            cells.append((r, c, z, True, r >= c // 16, 25.0, 180.0))
            z -= drop
    cells = spark.createDataFrame(cells, "r int, c int, z double, ok boolean, counted boolean, slope double, aspect double")
    found = flow.traced_best(cells, 40.0, 48)
    walked = {}
    for s in flow.steps(cells).orderBy("node").collect():  # down a column
        c = s["node"] & 0xFFFFFFFF
        walked.setdefault(c, []).append((s["node"] >> 32, s["band_len"]))
    sums = []
    for c, own in walked.items():
        for i, (r, _) in enumerate(own):
            total = 0.0
            for _, x in own[i:]:
                total += x
            sums.append((-total, r, c))
    assert {(x["top_r"], x["top_c"]) for x in found.collect()} == {min(sums)[1:]}
    # sums by doubling would choose another one
    doubled = flow.fall_line(cells).orderBy(F.desc("band_len"), "r", "c").first()
    assert (doubled["r"], doubled["c"]) != min(sums)[1:]


def test_cells_and_leaves_are_not_broadcast(spark):
    cells = materialize(spark.range(64).selectExpr("int(id / 8) AS r", "int(id % 8) AS c", "1.0D AS cost", "id % 5 = 0 AS fine"), "cells")
    assert "Broadcast" not in _plan(graph.mesh_graph(cells, F.col("fine")))
    assert "Broadcast" not in _plan(graph.neighbours(cells, ["cost"]))
    # pins are few; cells are not
    edges, leaves = legs.mesh_of(cells, F.col("fine"), cells.where("r = 1").select("r", "c"))
    assert "BuildLeft" not in _plan(leaves)
    ways = leaves.select(F.lit(1).alias("source"), F.lit(1).alias("target"), F.lit(0).alias("seq"), "node")
    assert "Broadcast" not in _plan(legs.walked(materialize(ways, "ways"), materialize(leaves, "leaves")))
    labels = flow.labelled(cells.withColumn("key", F.col("r") * 8 + F.col("c")), "key")
    assert "Broadcast" not in _plan(labels)
