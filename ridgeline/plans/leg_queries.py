"""Queries over the mesh of the valley fixture: leaves of all sizes, pinned endpoints, legs between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators import graph, legs, terrain
from ridgeline.operators.components import connected_components
from ridgeline.plans.graph_queries import WEIGHTS, mesh_sql
from ridgeline.plans.registry import VALLEY, registry
from ridgeline.sources.fixtures import leg_ends, valley
from ridgeline.sources.scratch import materialize

QUERIES, ORACLE_SQL, query = registry()
#: West and north edge of the raster in metres.
WEST, NORTH = 200000.0, 7000000.0

PINNED = mesh_sql(
    f"""{VALLEY}, source AS MATERIALIZED (SELECT n_nationkey AS source, (n_nationkey*6007+11)%n AS r, (n_nationkey*3571+5)%n AS c FROM nation, n),
target AS MATERIALIZED (SELECT s_nationkey AS source, s_suppkey AS target, (s_suppkey*7919)%n AS r, (s_suppkey*104729+37)%n AS c FROM supplier, n),
pin AS MATERIALIZED (SELECT r, c FROM source UNION SELECT r, c FROM target)""",
    "EXISTS (SELECT 1 FROM pin WHERE pin.r = d.r AND pin.c = d.c)",
)


def _ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = terrain.derivatives(valley(spark, sf_dir))
    return materialize(d.select("r", "c", "z", "slope", terrain.ascent_cost(F.col("slope")).alias("cost")), "ground")


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, targets = leg_ends(spark, sf_dir)
    return sources.select("r", "c").unionByName(targets.select("r", "c")).distinct()


@query(f"WITH {PINNED} SELECT size::INT AS size, count(*) AS cells, count(DISTINCT leaf_r*100000+leaf_c) AS leaves FROM leaf GROUP BY ALL")
def mesh_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and leaves by size, where ends of legs are leaves of their own."""
    pins = _pins(spark, sf_dir).withColumn("pin", F.lit(True))
    cells = _ground(spark, sf_dir).join(pins, ["r", "c"], "left")
    leaves = graph.mesh(cells, (F.col("slope") >= 15) | F.coalesce("pin", F.lit(False)))
    return leaves.groupBy("size").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("leaf_r", "leaf_c").alias("leaves"))


@query(f"""WITH RECURSIVE {PINNED}, {WEIGHTS},
e AS MATERIALIZED (SELECT ar*100000 + ac AS u, br*100000 + bc AS v FROM w),
b AS (SELECT DISTINCT leaf_r*100000 + leaf_c AS id, size FROM leaf WHERE cost IS NOT NULL),
t(id, l) USING KEY (id) AS (SELECT id, id FROM b UNION SELECT e.v, min(t.l) FROM t JOIN e ON e.u = t.id JOIN recurring.t AS old ON old.id = e.v WHERE t.l < old.l GROUP BY e.v)
SELECT l AS component, count(*) AS leaves, sum(size*size)::BIGINT AS cells FROM t JOIN b USING (id) GROUP BY l""")
def mesh_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves and cells of each part of the mesh that hangs together, by its first leaf."""
    edges, leaves = legs.mesh_of(_ground(spark, sf_dir), F.col("slope") >= 15, _pins(spark, sf_dir))
    labels = connected_components(edges.where("src < dst"), "src", "dst")
    found = leaves.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.shiftright("component", 32) * 100000 + F.col("component").bitwiseAND(F.lit(legs.LOW))
    return found.groupBy(first.alias("component")).agg(F.count(F.lit(1)).alias("leaves"), F.sum((F.col("size") * F.col("size")).cast("long")).alias("cells"))


@query(f"""WITH RECURSIVE {PINNED}, {WEIGHTS},
e AS MATERIALIZED (SELECT ar*100000 + ac AS u, br*100000 + bc AS v, d1*acost + d2*(acost+bcost)/2 + d3*bcost AS w FROM w),
sp(source, node, cost) USING KEY (source, node) AS (SELECT source, source.r*100000 + source.c, 0e0 FROM source JOIN k ON k.r = source.r AND k.c = source.c AND k.cost IS NOT NULL
UNION SELECT sp.source, e.v, min(sp.cost + e.w) FROM sp JOIN e ON e.u = sp.node LEFT JOIN recurring.sp AS old ON old.source = sp.source AND old.node = e.v WHERE old.node IS NULL OR sp.cost + e.w < old.cost - 1e-9 GROUP BY sp.source, e.v)
SELECT source::BIGINT AS source, target::BIGINT AS target, round(cost, 3) AS cost FROM target LEFT JOIN sp USING (source) WHERE sp.node = target.r*100000 + target.c
UNION ALL SELECT source::BIGINT, target::BIGINT, NULL FROM target WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.source = target.source AND sp.node = target.r*100000 + target.c)""")
def router_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost from each source to each of its targets over the mesh; null where there is no way."""
    sources, targets = leg_ends(spark, sf_dir)
    costs, _ = legs.legs(_ground(spark, sf_dir), F.col("slope") >= 15, sources, targets)
    return targets.select("source", "target").join(costs, ["source", "target"], "left").withColumn("cost", F.round("cost", 3))


@query(None)
def router_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leg with its statistics and its line of longitude, latitude and height: ties make SQL ambiguous, tested by brute force."""
    ground = _ground(spark, sf_dir)
    sources, targets = leg_ends(spark, sf_dir)
    costs, walks = legs.legs(ground, F.col("slope") >= 15, sources, targets)
    cells = materialize(walks.join(ground.select("r", "c", "z", "slope").hint("merge"), ["r", "c"]), "leg-cells")
    keys = ["source", "target"]
    points = legs.cell_line(cells, keys, 8)
    lon, lat = geo.lonlat(WEST + F.col("c") * 10.0 + 5, NORTH - F.col("r") * 10.0 - 5)
    point = F.array(F.round(lon, 7), F.round(lat, 7), F.round("z", 1))
    lines = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", point.alias("p")))).alias("s")).select(*keys, F.col("s.p").alias("line"))
    return costs.join(legs.leg_stats(cells, keys), keys).join(lines.hint("merge"), keys)
