"""Queries over the tour graph, flow, meshes and documents of the app."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators import costs, flow, graph, terrain
from ridgeline.plans.registry import DERIVED, EDGE, PARKING, PATH, SIDE, cells_sql, registry
from ridgeline.plans.terrain_queries import DOWNHILL
from ridgeline.sources.fixtures import cells, edges, parkings
from ridgeline.sources.fixtures import paths as points
from ridgeline.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
GENTLE, ROUGH = cells_sql(0.9, 0.8), cells_sql()


@query(f"WITH {EDGE} SELECT src, dst, kind, min(hours) AS hours, count(*) AS times FROM edge GROUP BY ALL")
def edge_min_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("src", "dst", "kind").agg(F.min("hours").alias("hours"), F.count(F.lit(1)).alias("times"))


@query(f"""WITH {EDGE}, canon AS (SELECT 'p'||s_suppkey AS id, 'p'||min(s_suppkey) OVER (PARTITION BY s_nationkey) AS kept FROM supplier),
m AS (SELECT coalesce(a.kept, src) AS src, coalesce(b.kept, dst) AS dst, kind, hours FROM edge LEFT JOIN canon a ON src = a.id LEFT JOIN canon b ON dst = b.id)
SELECT src, dst, kind, min(hours) AS hours FROM m GROUP BY ALL""")
def remap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))
    canon = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("id"), F.concat(F.lit("p"), first).alias("kept"))
    out = edges(spark, sf_dir)
    for end in ("src", "dst"):
        out = out.join(canon.select(F.col("id").alias(end), F.col("kept").alias(f"{end}_kept")), end, "left").withColumn(end, F.coalesce(f"{end}_kept", end)).drop(f"{end}_kept")
    return out.groupBy("src", "dst", "kind").agg(F.min("hours").alias("hours"))


@query(f"WITH RECURSIVE {SIDE}, {PARKING}, {EDGE}, e AS (SELECT DISTINCT src, dst FROM edge), r(node) AS (SELECT 'p'||parking FROM parking WHERE drive_min <= 10 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = parkings(spark, sf_dir).where("drive_min <= 10").select(F.concat(F.lit("p"), "parking").alias("node"))
    return graph.reachable(start, edges(spark, sf_dir).select("src", "dst").distinct())


@query(f"""WITH {SIDE}, {PARKING}, {EDGE}, e AS (SELECT src, dst, kind, min(hours) AS hours FROM edge GROUP BY ALL), used AS (SELECT DISTINCT parking, drive_min FROM parking JOIN e ON src = 'p'||parking)
SELECT (SELECT count(*) FROM parking) AS parkings, (SELECT count(*) FROM used) AS used, (SELECT count(*) FROM used WHERE drive_min IS NULL) AS unknown_drive, (SELECT count(*) FROM e) AS edges, ((SELECT count(*) FROM parking) = (SELECT count(*) FROM used) AND (SELECT count(*) FROM used WHERE drive_min IS NULL) = 0) AS complete""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = parkings(spark, sf_dir), edges(spark, sf_dir).groupBy("src", "dst", "kind").agg(F.min("hours").alias("hours"))
    starts = e.select("src").distinct()
    used = p.join(starts, F.concat(F.lit("p"), "parking") == F.col("src"), "left").agg(
        F.count(F.lit(1)).alias("parkings"), F.count("src").alias("used"), F.count(F.when(F.col("src").isNotNull() & F.col("drive_min").isNull(), 1)).alias("unknown_drive")
    )
    out = used.crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    return out.withColumn("complete", (F.col("parkings") == F.col("used")) & (F.col("unknown_drive") == 0))


@query(f"""WITH RECURSIVE {ROUGH}, {DOWNHILL}, st AS MATERIALIZED (SELECT r, c, r+dr AS nr, c+dc AS nc, sqrt((gain*len)*(gain*len) + len*len) AS l3, gain*len AS drop FROM (SELECT dh.*, CASE WHEN dr<>0 AND dc<>0 THEN 10e0*sqrt(2e0) ELSE 10e0 END AS len FROM dh)),
w(r, c, at_r, at_c, total_len, total_drop) AS (SELECT r, c, nr, nc, l3, drop FROM st UNION ALL SELECT w.r, w.c, st.nr, st.nc, w.total_len + st.l3, w.total_drop + st.drop FROM w JOIN st ON st.r = w.at_r AND st.c = w.at_c)
SELECT r, c, round(max(total_len), 3) AS total_len, round(max(total_drop), 3) AS total_drop FROM w GROUP BY r, c""")
def fall_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = terrain.downhill(cells(spark, sf_dir)).where("dr IS NOT NULL")
    flat = F.when((F.col("dr") != 0) & (F.col("dc") != 0), 10.0 * 2**0.5).otherwise(10.0)
    drop = F.col("gain") * flat
    node = lambda r, c: (F.shiftleft(r.cast("long"), 32) + c)
    steps = d.select(node(F.col("r"), F.col("c")).alias("node"), node(F.col("r") + F.col("dr"), F.col("c") + F.col("dc")).alias("next"), F.sqrt(drop * drop + flat * flat).alias("total_len"), drop.alias("total_drop"))
    # a chain ends where its next cell does not flow
    out = graph.accumulate(steps, ["total_len", "total_drop"])
    return out.select(F.shiftright("node", 32).cast("int").alias("r"), F.col("node").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("c"), F.round("total_len", 3).alias("total_len"), F.round("total_drop", 3).alias("total_drop"))


@query(f"""WITH RECURSIVE {ROUGH}, {DERIVED}, b AS MATERIALIZED (SELECT r, c, r*100000 + c AS id FROM d WHERE slope > 20 AND slope < 30),
e AS MATERIALIZED (SELECT x.id AS u, y.id AS v FROM b x CROSS JOIN (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dr, dc) JOIN b y ON y.r = x.r + dr AND y.c = x.c + dc),
k(id, l) USING KEY (id) AS (SELECT id, id FROM b UNION SELECT e.v, min(k.l) FROM k JOIN e ON e.u = k.id JOIN recurring.k AS old ON old.id = e.v WHERE k.l < old.l GROUP BY e.v)
SELECT l AS component, count(*) AS cells, count(*)*100 AS area_m2 FROM k GROUP BY l""")
def components8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = terrain.derivatives(cells(spark, sf_dir)).where("slope > 20 AND slope < 30").select("r", "c", (F.col("r") * 100000 + F.col("c")).alias("id"))
    labels = flow.labelled(d, "id")
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * 100).alias("area_m2"))


def mesh_sql(cells: str, pinned: str = "false") -> str:
    """Cells k and their leaves; cells for which pinned holds are leaves of their own."""
    return f"""{cells}, {DERIVED}, k AS MATERIALIZED (SELECT r, c, CASE WHEN slope < 20 THEN 1e0 WHEN slope < 25 THEN 1.3e0 WHEN slope < 30 THEN 1.8e0 WHEN slope < 35 THEN 4e0 END AS cost, slope >= 15 OR {pinned} AS fine FROM d),
""" + _LEAVES


_LEAVES = ",\n".join(
    f"""w{s} AS MATERIALIZED (SELECT r//{s} AS br, c//{s} AS bc FROM k WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT br*{t} AS r0, bc*{t} AS c0, {t} AS t FROM w{t}' for t in (16, 8, 4, 2) if t > s) or 'SELECT 0 AS r0, 0 AS c0, 0 AS t WHERE false'}) u WHERE k.r >= r0 AND k.r < r0 + t AND k.c >= c0 AND k.c < c0 + t)
GROUP BY ALL HAVING count(*) = {s*s} AND NOT bool_or(fine) AND (count(cost) = 0 OR (count(cost) = count(*) AND min(cost) = max(cost))))"""
    for s in (16, 8, 4, 2)
) + """,
leaf AS MATERIALIZED (SELECT r, c, cost, coalesce(t, 1) AS size, coalesce(r0, r) AS leaf_r, coalesce(c0, c) AS leaf_c FROM k LEFT JOIN (SELECT br*16 AS r0, bc*16 AS c0, 16 AS t FROM w16 UNION ALL SELECT br*8, bc*8, 8 FROM w8 UNION ALL SELECT br*4, bc*4, 4 FROM w4 UNION ALL SELECT br*2, bc*2, 2 FROM w2) u
ON k.r >= r0 AND k.r < r0 + t AND k.c >= c0 AND k.c < c0 + t)"""
MESH = mesh_sql(GENTLE)
#: Edges of the mesh: both leaves, the portal between them and the lengths up to it, over it and behind it.
WEIGHTS = f"""p AS (SELECT DISTINCT a.leaf_r AS ar, a.leaf_c AS ac, a.size AS az, a.cost AS acost, b.leaf_r AS br, b.leaf_c AS bc, b.size AS bz, b.cost AS bcost FROM leaf a CROSS JOIN (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dr, dc) JOIN leaf b ON b.r = a.r + dr AND b.c = a.c + dc WHERE (a.leaf_r, a.leaf_c) <> (b.leaf_r, b.leaf_c) AND a.cost IS NOT NULL AND b.cost IS NOT NULL),
x AS (SELECT *, {', '.join(f"CASE WHEN a{k}+az-1 < b{k} THEN a{k}+az-1 WHEN b{k}+bz-1 < a{k} THEN a{k} ELSE (greatest(a{k}, b{k}) + least(a{k}+az-1, b{k}+bz-1)) // 2 END AS x{k}, CASE WHEN a{k}+az-1 < b{k} THEN b{k} WHEN b{k}+bz-1 < a{k} THEN b{k}+bz-1 ELSE (greatest(a{k}, b{k}) + least(a{k}+az-1, b{k}+bz-1)) // 2 END AS e{k}" for k in 'rc')} FROM p),
w AS (SELECT *, {', '.join(f"10e0*(greatest(abs({a}r-{b}r), abs({a}c-{b}c)) + (sqrt(2e0)-1)*least(abs({a}r-{b}r), abs({a}c-{b}c))) AS {n}" for a, b, n in (('x', 'm', 'd1'), ('e', 'x', 'd2'), ('q', 'e', 'd3')))} FROM (SELECT *, ar + (az-1)//2 AS mr, ac + (az-1)//2 AS mc, br + (bz-1)//2 AS qr, bc + (bz-1)//2 AS qc FROM x))"""


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = terrain.derivatives(cells(spark, sf_dir, "gentle"))
    return d.select("r", "c", "slope", terrain.ascent_cost(F.col("slope")).alias("cost"))


@query(f"WITH {MESH} SELECT size::INT AS size, count(*) AS cells, count(DISTINCT leaf_r*100000+leaf_c) AS leaves FROM leaf GROUP BY ALL")
def mesh_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = graph.mesh(_costed(spark, sf_dir), F.col("slope") >= 15)
    return leaves.groupBy("size").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("leaf_r", "leaf_c").alias("leaves"))


@query(f"""WITH {MESH}, p AS (SELECT DISTINCT a.leaf_r AS ar, a.leaf_c AS ac, a.size AS asz, b.leaf_r AS br, b.leaf_c AS bc, b.size AS bsz FROM leaf a JOIN leaf b ON b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1 WHERE (a.leaf_r, a.leaf_c) <> (b.leaf_r, b.leaf_c) AND a.cost IS NOT NULL AND b.cost IS NOT NULL)
SELECT asz::INT AS size, bsz::INT AS to_size, count(*) AS edges FROM p GROUP BY ALL""")
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    costed = _costed(spark, sf_dir)
    leaves = graph.mesh(costed, F.col("slope") >= 15).join(costed.select("r", "c", "cost"), ["r", "c"]).where("cost IS NOT NULL")
    near = graph.neighbours(leaves, ["size", "leaf_r", "leaf_c"]).where("leaf_r <> to_leaf_r OR leaf_c <> to_leaf_c")
    return near.select("leaf_r", "leaf_c", "size", "to_leaf_r", "to_leaf_c", "to_size").distinct().groupBy("size", "to_size").agg(F.count(F.lit(1)).alias("edges"))


@query(f"""WITH {MESH}, {WEIGHTS}
SELECT az::INT AS size, bz::INT AS to_size, count(*) AS edges, round(sum(d1*acost + d2*(acost+bcost)/2 + d3*bcost), 2) AS weight FROM w GROUP BY ALL""")
def mesh_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights between touching leaves: from the anchor to the portal, across, and on to the other anchor."""
    e = graph.mesh_graph(_costed(spark, sf_dir), F.col("slope") >= 15)
    return e.groupBy("size", "to_size").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("w"), 2).alias("weight"))


_COSTS = f"""{GENTLE}, {DERIVED}, k AS MATERIALIZED (SELECT r, c, r*100000+c AS id, CASE WHEN slope < 20 THEN 1e0 WHEN slope < 25 THEN 1.3e0 WHEN slope < 30 THEN 1.8e0 WHEN slope < 35 THEN 4e0 END AS cost FROM d),
e AS MATERIALIZED (SELECT a.id AS u, b.id AS v, (CASE WHEN a.r<>b.r AND a.c<>b.c THEN 10e0*sqrt(2e0) ELSE 10e0 END)*(a.cost+b.cost)/2 AS w FROM k a CROSS JOIN (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dr, dc) JOIN k b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.cost IS NOT NULL AND b.cost IS NOT NULL),
sp(node, cost) USING KEY (node) AS (SELECT id, 0e0 FROM k WHERE id = 0 AND cost IS NOT NULL UNION SELECT e.v, min(sp.cost + e.w) FROM sp JOIN e ON e.u = sp.node LEFT JOIN recurring.sp AS old ON old.node = e.v WHERE old.node IS NULL OR sp.cost + e.w < old.cost - 1e-9 GROUP BY e.v)"""


@query(f"WITH RECURSIVE {_COSTS} SELECT node, round(cost, 4) AS cost FROM sp")
def shortest_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost from the first cell to every cell of the raster."""
    start = spark.createDataFrame([(0, 0, 0)], "source long, r int, c int")
    found = costs.raster_costs(_costed(spark, sf_dir).select("r", "c", "cost"), start)
    return found.select((F.col("r") * 100000 + F.col("c")).cast("long").alias("node"), F.round("best", 4).alias("cost"))


@query(None)
def cheapest_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways from three starts to every 40th cell, as cells in order; costs of a search from several sources at once. Tested by brute force."""
    k = _costed(spark, sf_dir).select("r", "c", "cost")
    start = spark.createDataFrame([(1, 0, 0), (2, 20, 25), (3, 30, 5)], "source long, r int, c int")
    found = graph.materialize(costs.raster_costs(k, start), "ways-costs")
    return costs.ways(found, found.where("r % 40 = 10 AND c % 40 = 10").select("source", "r", "c"))


@query(f"""WITH {EDGE}, e AS (SELECT src, dst, kind, min(hours) AS hours FROM edge GROUP BY ALL), up AS (SELECT * FROM e WHERE kind = 'skin'), run AS (SELECT 's'||p_partkey AS summit, 'r'||(p_partkey%500) AS run, p_size*10e0 AS band FROM part), back AS (SELECT * FROM e WHERE kind = 'walk'),
k AS (SELECT up.src AS parking, up.dst AS summit, run.run, back.dst AS end_, band, up.hours + run.band/8000 + back.hours AS hours, (up.src = back.dst) AS closes FROM up JOIN run ON run.summit = up.dst JOIN back ON back.src = run.run)
SELECT parking, i::INT AS rank, summit, run, end_ AS "end", round(hours, 4) AS hours, closes FROM (SELECT *, row_number() OVER (PARTITION BY parking ORDER BY closes DESC, hours, band DESC, summit, run, end_) AS i FROM k) WHERE i <= 5""")
def tour_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best loops of each parking: those that end where they started first, then the shortest day, then the longest run."""
    e = edges(spark, sf_dir).groupBy("src", "dst", "kind").agg(F.min("hours").alias("hours"))
    up = e.where("kind = 'skin'").select(F.col("src").alias("parking"), F.col("dst").alias("summit"), F.col("hours").alias("up"))
    run = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), "p_partkey").alias("summit"), F.concat(F.lit("r"), F.col("p_partkey") % 500).alias("run"), (F.col("p_size") * 10.0).alias("band"))
    back = e.where("kind = 'walk'").select(F.col("src").alias("run"), F.col("dst").alias("end"), F.col("hours").alias("back"))
    return best_loops(up, run, back)


def best_loops(up: DataFrame, run: DataFrame, back: DataFrame, most: int = 5) -> DataFrame:
    """The most best loops of each parking out of ways up (parking, summit, up), runs (summit, run, band) and ways back (run, end, back).

    The best loop of a way up and its run closes, if one does, and else takes the least hours back. A way up that most
    others beat by their best loops has none among the parking's best, so only the others meet all ways back of their runs.
    """
    hours = lambda way: F.col("up") + F.col("band") / 8000 + F.col(way)
    place = lambda *order: F.row_number().over(Window.partitionBy("parking").orderBy(*order))
    least = back.groupBy("run").agg(F.min("back").alias("least"))
    closing = back.groupBy("run", F.col("end").alias("parking")).agg(F.min("back").alias("closing"))
    ways = up.join(run, "summit").join(least, "run").join(closing, ["run", "parking"], "left")
    ways = ways.withColumns({"_closes": F.col("closing").isNotNull(), "_hours": F.coalesce(hours("closing"), hours("least"))})
    ways = ways.withColumn("_place", place(F.desc("_closes"), "_hours", F.desc("band"), "summit", "run")).where(F.col("_place") <= most)
    out = ways.select("parking", "summit", "run", "band", "up").join(back, "run").withColumns({"hours": hours("back"), "closes": F.col("parking") == F.col("end")})
    out = out.withColumn("rank", place(F.desc("closes"), "hours", F.desc("band"), "summit", "run", "end")).where(F.col("rank") <= most)
    return out.select("parking", "rank", "summit", "run", "end", F.round("hours", 4).alias("hours"), "closes")


@query(f"""WITH {PATH}, g AS (SELECT path, min(seq)::INT AS seq, string_agg('<trkpt lat="'||(62+seq/1000e0)::DECIMAL(8,3)||'" lon="'||(9+path/1000e0)::DECIMAL(8,3)||'"/>', '' ORDER BY seq) AS xml FROM path GROUP BY path)
SELECT path, length(xml) AS xml_length, (SELECT count(*) FROM path q WHERE q.path = g.path) AS points, round(62.001e0, 3) AS first_lat FROM g""")
def gpx_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as GPX and read back by XPath, whatever the namespace."""
    p = points(spark, sf_dir).select("path", "seq", F.concat(F.lit('<trkpt lat="'), F.format_string("%.3f", 62 + F.col("seq") / 1000), F.lit('" lon="'), F.format_string("%.3f", 9 + F.col("path") / 1000), F.lit('"/>')).alias("x"))
    doc = p.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda s: s.x), "").alias("xml"))
    lat = F.xpath(F.concat(F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>'), "xml", F.lit("</trkseg></trk></gpx>")), F.lit('//*[local-name()="trkpt"]/@lat'))
    return doc.select("path", F.length("xml").cast("long").alias("xml_length"), F.size(lat).cast("long").alias("points"), F.round(F.get(lat, F.lit(0)).cast("double"), 3).alias("first_lat"))


@query("""SELECT o_orderkey AS tour, CASE WHEN o_orderkey % 13 = 0 THEN 'unavailable' WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'range' WHEN o_orderpriority = '5-LOW' THEN 'stale' WHEN o_totalprice < 50000 THEN 'missing' ELSE 'ok' END AS state FROM orders""")
def forecast_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = (
        F.when(F.col("o_orderkey") % 13 == 0, "unavailable").when(F.col("o_orderstatus") == "P", "missing").when(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1994-01-01 00:00:00")), "range")
        .when(F.col("o_orderpriority") == "5-LOW", "stale").when(F.col("o_totalprice") < 50000, "missing").otherwise("ok")
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tour"), state.alias("state"))


@query("""SELECT event_id, (['N','NE','E','SE','S','SW','W','NW'])[(floor(value/45+0.5)::BIGINT % 8) + 1] AS sector, printf('%02d:%02d', (floor(value/10*60+0.5)::BIGINT // 60), floor(value/10*60+0.5)::BIGINT % 60) AS clock, regexp_replace(regexp_replace(lower(event_type || ' #' || user_id || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, (floor((value*977 - 30000)/4000)*4000)::BIGINT AS tile FROM events""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.concat("event_type", F.lit(" #"), "user_id", F.lit("!"))
    return e.select("event_id", geo.compass(F.col("value")).alias("sector"), geo.clock(F.col("value") / 10).alias("clock"), geo.slug(name).alias("slug"), (F.floor((F.col("value") * 977 - 30000) / 4000) * 4000).alias("tile"))


def _utm_sql() -> str:
    terms = lambda f, g: " + ".join(f"{c!r}*{f}({2 * j}*xi)*{g}({2 * j}*eta)" for j, c in enumerate(geo.FORWARD, 1))
    return f"""WITH p AS (SELECT o_orderkey AS id, 7e0 + (o_orderkey % 600)/100e0 AS lon, 62e0 + (o_orderkey % 250)/100e0 AS lat FROM orders),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {geo.ECC!r}*atanh({geo.ECC!r}*sin(radians(lat)))) AS t, radians(lon-15) AS lam FROM p),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM t)
SELECT id, round(500000e0 + {geo.K0 * geo.RADIUS!r}*(eta + {terms('cos', 'sinh')}), 2) AS easting, round({geo.K0 * geo.RADIUS!r}*(xi + {terms('sin', 'cosh')}), 2) AS northing FROM x"""


@query(_utm_sql())
def utm33(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    east, north = geo.utm33(7.0 + (k % 600) / 100.0, 62.0 + (k % 250) / 100.0)
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.round(east, 2).alias("easting"), F.round(north, 2).alias("northing"))
