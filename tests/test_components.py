from __future__ import annotations

from ridgeline.operators.components import connected_components


def test_chain_star_and_empty(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
