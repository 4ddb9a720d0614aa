"""Queries of whole tours, scored loops, tables kept by version and stored answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators import costs, flow, spatial, terrain
from ridgeline.plans import sun_queries
from ridgeline.plans.flow_queries import _STEPS, _SUMS, flags
from ridgeline.plans.registry import DERIVED, EDGE, ROAD, cells_sql, registry
from ridgeline.plans.terrain_queries import DOWNHILL, SMOOTH
from ridgeline.sources import readers, sinks
from ridgeline.sources.fixtures import edges, parkings, roads, side
from ridgeline.sources.scratch import materialize, shared_folder
from ridgeline.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
#: A run starts so near its summit and so little below it, and has so much of the band.
NEAR, BELOW, BAND = 800.0, 200.0, 40.0


@query(f"""WITH RECURSIVE {cells_sql()}, {DERIVED}, {SMOOTH}, {DOWNHILL}, {_STEPS}, {ROAD},
k AS MATERIALIZED (SELECT r, c, r*100000+c AS id, CASE WHEN slope < 20 THEN 1e0 WHEN slope < 25 THEN 1.3e0 WHEN slope < 30 THEN 1.8e0 WHEN slope < 35 THEN 4e0 END AS cost FROM d),
e AS MATERIALIZED (SELECT a.id AS u, b.id AS v, (CASE WHEN a.r<>b.r AND a.c<>b.c THEN 10e0*sqrt(2e0) ELSE 10e0 END)*(a.cost+b.cost)/2 AS w FROM k a CROSS JOIN (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) t(dr, dc) JOIN k b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.cost IS NOT NULL AND b.cost IS NOT NULL),
sp(node, cost) USING KEY (node) AS (SELECT DISTINCT id, 0e0 FROM k JOIN road ON k.r = floor((10*(SELECT n FROM n) - road.y)/10) AND k.c = floor(road.x/10) WHERE k.cost IS NOT NULL UNION SELECT e.v, min(sp.cost + e.w) FROM sp JOIN e ON e.u = sp.node LEFT JOIN recurring.sp AS old ON old.node = e.v WHERE old.node IS NULL OR sp.cost + e.w < old.cost - 1e-9 GROUP BY e.v),
{_SUMS},
px AS (SELECT *, max(z) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS h, min(z) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS l FROM cell),
py AS (SELECT r, c, z, max(h) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS high, min(l) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS low FROM px),
pk AS MATERIALIZED (SELECT r, c, z FROM py WHERE z = high AND z >= 900 AND z - low >= 60),
cand AS (SELECT pk.r AS pr, pk.c AS pc, pk.z AS pz, f.r, f.c, f.bl, row_number() OVER (PARTITION BY pk.r, pk.c ORDER BY round(f.bl, 6) DESC, f.r, f.c) AS i FROM pk JOIN ok ON ok.counted AND (ok.r - pk.r)**2 + (ok.c - pk.c)**2 <= 6400 JOIN f ON f.r = ok.r AND f.c = ok.c JOIN cell ON cell.r = f.r AND cell.c = f.c AND cell.z >= pk.z - {BELOW} WHERE f.bl >= {BAND}),
top AS MATERIALIZED (SELECT * FROM cand WHERE i = 1),
tr(r0, c0, seq, r, c) AS (SELECT DISTINCT r, c, 0, r, c FROM top UNION ALL SELECT r0, c0, seq + 1, st.nr, st.nc FROM tr JOIN st ON st.r = tr.r AND st.c = tr.c WHERE seq < 600),
m AS (SELECT tr.*, ok.slope, cell.z, max(CASE WHEN ok.counted THEN seq END) OVER (PARTITION BY r0, c0) AS last FROM tr JOIN ok ON ok.r = tr.r AND ok.c = tr.c JOIN cell ON cell.r = tr.r AND cell.c = tr.c),
run AS (SELECT r0, c0, count(*) AS run_cells, max_by(z, -seq) - max_by(z, seq) AS run_drop, avg(slope) AS mean_slope, max_by(r, seq) AS end_r, max_by(c, seq) AS end_c FROM m WHERE seq <= last GROUP BY r0, c0)
SELECT pk.r::INT AS r, pk.c::INT AS c, pk.z AS elevation, round(sp.cost, 3) AS ascent_cost, top.r::INT AS top_r, top.c::INT AS top_c, round(top.bl, 3) AS band_len, round(10*sqrt(((top.r-pk.r)**2 + (top.c-pk.c)**2)::DOUBLE), 3) AS start_offset, run_cells, round(run_drop, 3) AS run_drop, round(mean_slope, 4) AS mean_slope, end_r::INT AS end_r, end_c::INT AS end_c
FROM pk LEFT JOIN sp ON sp.node = pk.r*100000 + pk.c LEFT JOIN top ON top.pr = pk.r AND top.pc = pk.c LEFT JOIN run ON run.r0 = top.r AND run.c0 = top.c""")
def summit_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each summit with the cost of its way up from the nearest road by cost, and the best run that starts near it."""
    d = materialize(flags(spark, sf_dir), "flags")
    n = side(spark, sf_dir)
    summits = materialize(terrain.peaks(d.select("r", "c", "z"), window=30, relief=60).select("r", "c", "z"), "summits")
    at_roads = roads(spark, sf_dir).select(F.lit(0).cast("long").alias("source"), F.floor((10 * n - F.col("y")) / 10).cast("int").alias("r"), F.floor(F.col("x") / 10).cast("int").alias("c"))
    up = costs.raster_costs(d.select("r", "c", terrain.ascent_cost(F.col("slope")).alias("cost")), at_roads.distinct()).select("r", "c", "best")
    at = {"x": F.col("c") * 10.0, "y": F.col("r") * 10.0}
    lines = flow.fall_line(d).where(F.col("band_len") >= BAND).join(d.where("counted").select("r", "c", "z"), ["r", "c"])
    near = spatial.within(lines.withColumns(at), summits.withColumns(at), NEAR).where(F.col("l.z") >= F.col("r.z") - BELOW)
    best = F.max(F.struct(F.round("l.band_len", 6).alias("band"), (-F.col("l.r")).alias("r"), (-F.col("l.c")).alias("c"), F.col("l.band_len").alias("band_len"))).alias("b")
    tops = near.groupBy(F.col("r.r").alias("r"), F.col("r.c").alias("c")).agg(best).select("r", "c", (-F.col("b.r")).alias("top_r"), (-F.col("b.c")).alias("top_c"), "b.band_len")
    tops = materialize(tops, "run-tops")
    traced = flow.traced(d, tops.select(F.col("top_r").alias("r"), F.col("top_c").alias("c")).distinct())
    run = traced.groupBy("top_r", "top_c").agg(F.count(F.lit(1)).alias("run_cells"), (F.min_by("z", "seq") - F.max_by("z", "seq")).alias("run_drop"), F.avg("slope").alias("mean_slope"), F.max_by("r", "seq").alias("end_r"), F.max_by("c", "seq").alias("end_c"))
    out = summits.join(up, ["r", "c"], "left").join(tops, ["r", "c"], "left").join(run, ["top_r", "top_c"], "left")
    offset = 10 * F.sqrt((F.pow(F.col("top_r") - F.col("r"), 2) + F.pow(F.col("top_c") - F.col("c"), 2)))
    rounded = [F.round(x, k).alias(name) for x, k, name in (("best", 3, "ascent_cost"), ("band_len", 3, "band_len"), (offset, 3, "start_offset"), ("run_drop", 3, "run_drop"), ("mean_slope", 4, "mean_slope"))]
    return out.select("r", "c", F.col("z").alias("elevation"), "top_r", "top_c", "run_cells", "end_r", "end_c", *rounded)


@query(f"""WITH {EDGE}, x AS (SELECT src, dst, kind, min(hours) AS hours FROM edge GROUP BY ALL), run AS (SELECT 's'||p_partkey AS summit, 'r'||(p_partkey%500) AS run, p_size*40e0 AS band, (p_partkey*13 % 80)*10e0 AS offset_ FROM part),
back AS (SELECT src AS run, dst AS parking, hours, hours*2500 AS length, (floor(hours*97)::BIGINT % 300)::DOUBLE AS gain FROM x WHERE kind = 'walk'),
k AS (SELECT summit, parking, run.run, band, offset_, back.hours AS back_hours, band - 0.3e0*length - 3*gain AS score FROM run JOIN back ON back.run = run.run WHERE length <= 4000 AND gain <= 150),
b AS (SELECT *, row_number() OVER (PARTITION BY summit, parking ORDER BY round(score, 6) DESC, run) AS i FROM k),
t AS (SELECT b.*, up.hours + floor((band/8000 + offset_/4000)*100 + 0.5e0)/100 + back_hours AS hours FROM b JOIN x up ON up.kind = 'skin' AND up.src = b.parking AND up.dst = b.summit WHERE i = 1)
SELECT summit, parking, run, round(score, 6) AS score, floor(hours*60 + 0.5e0)::BIGINT AS minutes, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY summit ORDER BY round(score, 6) DESC, parking) AS rank FROM t) WHERE rank <= 4""")
def loop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best loops of each summit: from each parking the run with the best score of band against the walk back to it.

    The best run of a summit and parking is chosen before the way up is joined, so no triples are formed.
    """
    x = edges(spark, sf_dir).groupBy("src", "dst", "kind").agg(F.min("hours").alias("hours"))
    k = F.col("p_partkey")
    run = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), k).alias("summit"), F.concat(F.lit("r"), k % 500).alias("run"), (F.col("p_size") * 40.0).alias("band"), ((k * 13 % 80) * 10.0).alias("offset"))
    back = x.where("kind = 'walk'").select(F.col("src").alias("run"), F.col("dst").alias("parking"), F.col("hours").alias("back_hours"), (F.col("hours") * 2500).alias("length"), (F.floor(F.col("hours") * 97) % 300).cast("double").alias("gain"))
    fits = run.join(back.where("length <= 4000 AND gain <= 150"), "run").withColumn("score", F.col("band") - 0.3 * F.col("length") - 3 * F.col("gain"))
    best = fits.groupBy("summit", "parking").agg(F.min(F.struct((-F.round("score", 6)).alias("low"), "run", "score", "band", "offset", "back_hours")).alias("b")).select("summit", "parking", "b.*")
    up = x.where("kind = 'skin'").select(F.col("src").alias("parking"), F.col("dst").alias("summit"), F.col("hours").alias("up_hours"))
    hours = F.col("up_hours") + F.floor((F.col("band") / 8000 + F.col("offset") / 4000) * 100 + 0.5) / 100 + F.col("back_hours")
    rank = F.row_number().over(Window.partitionBy("summit").orderBy("low", "parking"))
    out = best.join(up, ["summit", "parking"]).withColumns({"hours": hours, "rank": rank}).where("rank <= 4")
    return out.select("summit", "parking", "run", F.round("score", 6).alias("score"), F.floor(F.col("hours") * 60 + 0.5).alias("minutes"), "rank")


@query(f"WITH {sun_queries._POINT} SELECT parking, b::DOUBLE AS bearing, round(far, 4) AS angle, CASE WHEN parking % 3 = 0 THEN 2 ELSE 3 END::INT AS worked FROM hz")
def horizon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizons kept by parking and version: a new version replaces the old, and a call works what its version lacks."""
    path = f"{shared_folder(spark)}/horizons-{uuid.uuid4().hex}"
    keys = parkings(spark, sf_dir).select("parking")
    work = lambda call, far: lambda open_: sun_queries._rays(spark, sf_dir, sun_queries.NEAR + far).join(open_, "parking", "left_semi").withColumn("worked", F.lit(call))
    sinks.versioned(keys.where("parking % 2 = 0"), "parking", 1, work(1, []), path)
    sinks.versioned(keys.where("parking % 3 = 0"), "parking", 2, work(2, sun_queries.FAR), path)
    return sinks.versioned(keys, "parking", 2, work(3, sun_queries.FAR), path).select("parking", "bearing", F.round("angle", 4).alias("angle"), "worked")


AS_OF, BOX = "1996-01-01 00:00:00", (8.5, 62.4, 9.9, 63.1)
_ANSWERS = """a AS MATERIALIZED (SELECT o_orderkey AS answer, o_custkey % 9 AS source, o_orderdate AS asked, (o_orderpriority <> '1-URGENT' AND o_custkey % 9 <> 4) AS ok, CASE WHEN NOT (o_orderpriority <> '1-URGENT' AND o_custkey % 9 <> 4) THEN 'status ' || o_orderstatus END AS error FROM orders),
el AS MATERIALIZED (SELECT l_orderkey AS answer, l_returnflag AS type, l_partkey AS id, 62 + ((l_partkey*37 + l_orderkey % 5) % 2000)/1000e0 AS lat, 8 + (l_partkey*91 % 3000)/1000e0 AS lon FROM lineitem JOIN a ON a.answer = l_orderkey AND a.source <> 7),
nw AS MATERIALIZED (SELECT * FROM (SELECT el.*, source, asked, row_number() OVER (PARTITION BY type, id ORDER BY asked DESC, el.answer DESC) AS i FROM el JOIN a USING (answer) WHERE ok AND asked <= TIMESTAMP '{AS_OF}') WHERE i = 1 AND lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]})""".replace("{AS_OF}", AS_OF)
for _i, _x in enumerate(BOX):
    _ANSWERS = _ANSWERS.replace("{BOX[%d]}" % _i, repr(_x))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = F.col("o_custkey") % 9
    ok = (F.col("o_orderpriority") != "1-URGENT") & (source != 4)
    answers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer"), source.alias("source"), F.col("o_orderdate").alias("asked"), F.when(~ok, F.concat(F.lit("status "), "o_orderstatus")).alias("error"))
    k, a = F.col("l_partkey"), F.col("l_orderkey")
    found = table(spark, sf_dir, "lineitem").select(a.alias("answer"), F.col("l_returnflag").alias("type"), k.alias("id"), (62 + ((k * 37 + a % 5) % 2000) / 1000.0).alias("lat"), (8 + (k * 91 % 3000) / 1000.0).alias("lon"))
    return answers, found.join(answers.where("source <> 7").select("answer"), "answer", "left_semi")


@query(f"WITH {_ANSWERS} SELECT type, id, answer, source, round(lat, 4) AS lat, round(lon, 4) AS lon FROM nw")
def stored_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements in a box as of a day from all stored answers: of each the newest, from answers that didn't fail."""
    found = readers.stored_elements(*_answers(spark, sf_dir), BOX, AS_OF)
    return found.select("type", "id", "answer", "source", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query(f"""WITH {_ANSWERS}, s AS (SELECT source, count(*) FILTER (ok AND asked <= TIMESTAMP '{AS_OF}') AS answered, count(*) FILTER (NOT ok AND asked <= TIMESTAMP '{AS_OF}') AS failed, arg_max(error, (asked, answer)) FILTER (NOT ok AND asked <= TIMESTAMP '{AS_OF}') AS last_error FROM a GROUP BY source), c AS (SELECT source, count(*) AS elements FROM nw GROUP BY source)
SELECT s.source, answered, failed, last_error, coalesce(elements, 0) AS elements, CASE WHEN answered = 0 THEN 'unknown' WHEN coalesce(elements, 0) = 0 THEN 'empty' ELSE 'known' END AS state FROM s LEFT JOIN c ON c.source = s.source""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each source: nothing if none of its answers came, which is not the same as no element."""
    return readers.source_states(*_answers(spark, sf_dir), BOX, AS_OF)
