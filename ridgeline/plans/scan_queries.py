"""Queries that plan, complete and order scans: regions of both shapes, buckets of drive time, bounds of runs, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators import flow, graph, spatial, terrain
from ridgeline.operators.ranks import ranked
from ridgeline.plans.access_queries import _BLOCKS, D, SUMMIT, blocks_within, summits
from ridgeline.plans.flow_queries import _OK, _STEPS, _SUMS
from ridgeline.plans.registry import DERIVED, PARKING, ROAD, SIDE, cells_sql, registry
from ridgeline.plans.terrain_queries import DOWNHILL, SMOOTH
from ridgeline.sources.fixtures import cells, parkings, roads, side
from ridgeline.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
#: The band of the tour graph's runs, and what no cell of them reaches.
LOWER, UPPER, MOST = 20.0, 30.0, 35.0
_GRAPH_OK = f"ok AS MATERIALIZED (SELECT sm.r, sm.c, d.slope, d.aspect, coalesce(smooth > 3 AND smooth < {MOST} AND d.slope < {MOST}, false) AS go, coalesce(smooth > 3 AND smooth < {MOST} AND d.slope < {MOST} AND smooth > {LOWER} AND smooth < {UPPER}, false) AS counted FROM sm JOIN d ON d.r = sm.r AND d.c = sm.c)"


def graph_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = terrain.box_mean(terrain.derivatives(cells(spark, sf_dir, gaps=True)), "slope", 90.0)
    return d.select("r", "c", "z", "slope", "aspect", *flow.graph_flags(F.col("smooth"), F.col("slope"), LOWER, UPPER, MOST))


@query(f"WITH {cells_sql(gaps=True)}, {DERIVED}, {SMOOTH}, {_GRAPH_OK} SELECT r, c, go AS ok, counted FROM ok")
def graph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run of the tour graph goes on and where it counts: short steep parts may be crossed, never a cell of MOST degrees."""
    return graph_cells(spark, sf_dir).select("r", "c", "ok", "counted")


@query(f"""WITH RECURSIVE {cells_sql(gaps=True)}, {DERIVED}, {SMOOTH}, {DOWNHILL}, {_STEPS.replace(_OK, _GRAPH_OK)}, {_SUMS},
top AS MATERIALIZED (SELECT r, c, bl, row_number() OVER (PARTITION BY r//24, c//24 ORDER BY round(bl, 6) DESC, r, c) AS i FROM f WHERE bl >= 30), s AS MATERIALIZED (SELECT r, c, bl FROM top WHERE i = 1),
tr(r0, c0, seq, r, c) AS (SELECT r, c, 0, r, c FROM s UNION ALL SELECT r0, c0, seq + 1, st.nr, st.nc FROM tr JOIN st ON st.r = tr.r AND st.c = tr.c WHERE seq < 600),
m AS (SELECT tr.*, ok.counted, ok.slope, max(CASE WHEN ok.counted THEN seq END) OVER (PARTITION BY r0, c0) AS last FROM tr JOIN ok ON ok.r = tr.r AND ok.c = tr.c)
SELECT r0 AS top_r, c0 AS top_c, count(*) AS cells, round(avg(slope), 4) AS mean_slope, round(avg(counted::INT::DOUBLE), 4) AS band_share, 10*count(*) FILTER (slope >= 30) AS over30_m FROM m WHERE seq <= last GROUP BY r0, c0 HAVING avg(slope) BETWEEN 19 AND 32 AND avg(counted::INT::DOUBLE) >= 0.6""")
def graph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of each square of 24 cells that the tour graph takes: 19 to 32 degrees on average, six tenths in the band."""
    d = graph.materialize(graph_cells(spark, sf_dir), "graph-cells")
    best = F.row_number().over(Window.partitionBy(F.floor(F.col("r") / 24), F.floor(F.col("c") / 24)).orderBy(F.round("band_len", 6).desc(), "r", "c"))
    tops = flow.fall_line(d).where("band_len >= 30").withColumn("i", best).where("i = 1").select("r", "c")
    traced = graph.materialize(flow.traced(d, tops), "graph-runs")
    steep = traced.groupBy("top_r", "top_c").agg((10 * F.count_if(F.col("slope") >= 30)).alias("over30_m"))
    g = flow.described(traced, 20.0, 32.0).join(steep, ["top_r", "top_c"])
    return g.select("top_r", "top_c", "cells", F.round("mean_slope", 4).alias("mean_slope"), F.round("band_share", 4).alias("band_share"), "over30_m")


_REACH, _DRIVE = 60000.0, 120
_INSIDE = {"circle": "sqrt((x-60000)*(x-60000)+(y-60000)*(y-60000))", "square": "greatest(abs(x-60000), abs(y-60000))"}


@query(f"WITH {SIDE}, {PARKING}, far AS (SELECT parking, access, drive_min, x*100 AS x, y*100 AS y FROM parking), " + ", ".join(
    f"q_{k} AS (SELECT * FROM far WHERE access IS NULL AND {d} <= {_REACH} AND coalesce(drive_min, 0) <= {_DRIVE}), b_{k} AS (SELECT '{k}' AS shape, block_x, block_y, min(round({'sqrt(dx*dx+dy*dy)' if k == 'circle' else 'greatest(dx, dy)'}/1000, 3)) AS dist_km, count(*) AS parkings, count(*) FILTER (drive_min IS NULL) AS unknown FROM {_BLOCKS.format(r='12000', t=f'q_{k}')} WHERE {'sqrt(dx*dx+dy*dy)' if k == 'circle' else 'greatest(dx, dy)'} <= 12000 GROUP BY ALL)" for k, d in _INSIDE.items()
) + " SELECT *, row_number() OVER (PARTITION BY shape ORDER BY dist_km, block_x, block_y)::INT AS rank FROM (SELECT * FROM b_circle UNION ALL SELECT * FROM b_square)")
def scan_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks to scan for a region of either shape, in their order: those near public parkings within the drive limit.

    A parking whose drive is unknown may be within the limit, so its blocks are scanned too; unknown counts them.
    """
    far = parkings(spark, sf_dir).withColumns({"x": F.col("x") * 100, "y": F.col("y") * 100}).where(F.col("access").isNull() & (F.coalesce("drive_min", F.lit(0)) <= _DRIVE))
    dx, dy = F.abs(F.col("x") - 60000), F.abs(F.col("y") - 60000)
    parts = []
    for shape, away in (("circle", F.sqrt(dx * dx + dy * dy)), ("square", F.greatest(dx, dy))):
        each = blocks_within(far.where(away <= _REACH), 12000.0, shape == "square").groupBy("block_x", "block_y")
        parts.append(each.agg(F.min("dist_km").alias("dist_km"), F.count(F.lit(1)).alias("parkings"), F.count_if(F.col("drive_min").isNull()).alias("unknown")).withColumn("shape", F.lit(shape)))
    rank = F.row_number().over(Window.partitionBy("shape").orderBy("dist_km", "block_x", "block_y"))  # blocks, not rows of the tables
    return parts[0].unionByName(parts[1]).withColumn("rank", rank)


@query(f"""WITH {SUMMIT}, {PARKING}, {ROAD}, nr AS (SELECT a.parking, b.closed, row_number() OVER (PARTITION BY a.parking ORDER BY {D}, b.road) AS i FROM parking a, road b WHERE {D} <= 80),
op AS (SELECT * FROM parking p WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.parking = p.parking AND i = 1 AND closed)),
k AS (SELECT a.summit, b.parking, {D} AS d, row_number() OVER (PARTITION BY a.summit ORDER BY {D}, b.parking) AS i FROM summit a, op b WHERE {D} <= 700) SELECT summit, parking, i::INT AS rank, round(d, 4) AS distance FROM k WHERE i <= 4""")
def open_parkings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest parkings of each summit among those whose nearest road isn't closed."""
    p = parkings(spark, sf_dir)
    near = spatial.within(p, roads(spark, sf_dir), 80.0).groupBy("l.parking").agg(F.min(F.struct("d", "r.road", "r.closed")).alias("best"))
    open_ = p.join(near.where("best.closed").select("parking"), "parking", "left_anti")
    each = spatial.within(summits(spark, sf_dir), open_, 700.0).select("l.summit", "r.parking", "d")
    rank = F.row_number().over(Window.partitionBy("summit").orderBy("d", "parking"))
    return each.withColumn("rank", rank).where("rank <= 4").select("summit", "parking", "rank", F.round("d", 4).alias("distance"))


_REACHES = {"skin": ("parking", "summit", 400), "next": ("road", "summit", 250), "walk": ("road", "parking", 60)}


@query(f"WITH {SUMMIT}, {PARKING}, {ROAD} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, a.{s}::VARCHAR AS src, b.{t}::VARCHAR AS dst, round({D}, 4) AS distance FROM {s} a JOIN {t} b ON {D} <= {m}" for k, (s, t, m) in _REACHES.items()))
def reach_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that legs are searched for: parkings and summits, ends of runs and summits, ends of runs and parkings."""
    places = {"parking": parkings(spark, sf_dir), "summit": summits(spark, sf_dir), "road": roads(spark, sf_dir)}
    parts = [spatial.within(places[s], places[t], float(m)).select(F.lit(k).alias("kind"), F.col(f"l.{s}").cast("string").alias("src"), F.col(f"r.{t}").cast("string").alias("dst"), F.round("d", 4).alias("distance")) for k, (s, t, m) in _REACHES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {SIDE}, {PARKING}, {ROAD} SELECT 'p' || parking AS id, x, y, 'map' AS source FROM parking UNION ALL SELECT 'r' || road, x, y, 'official' FROM road a WHERE NOT EXISTS (SELECT 1 FROM parking b WHERE {D} <= 60)")
def all_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's places, and the official ones that none of those is near to."""
    p, r = parkings(spark, sf_dir), roads(spark, sf_dir)
    own = p.select(F.concat(F.lit("p"), "parking").alias("id"), "x", "y", F.lit("map").alias("source"))
    return own.unionByName(spatial.apart_from(r, p, "road", 60.0).select(F.concat(F.lit("r"), "road").alias("id"), "x", "y", F.lit("official").alias("source")))


@query(f"""WITH {cells_sql(gaps=True)}, {DERIVED}, {PARKING}, k AS (SELECT parking, d.slope, d.z FROM parking JOIN n ON true JOIN d ON (d.r - floor(y/10))**2 + (d.c - floor(x/10))**2 <= 100)
SELECT parking, count(*) AS cells, round(min(slope), 4) AS low, round(max(slope), 4) AS high, round(median(slope), 4) AS middle, round(avg(CASE WHEN slope IS NOT NULL THEN (slope > 20 AND slope < 30)::INT::DOUBLE END), 4) AS band_share, round(100e0*count(z)/count(*), 1) AS coverage FROM k GROUP BY parking""")
def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes within ten cells of each parking: least, most, median, share of the band and how much is known."""
    d = terrain.derivatives(cells(spark, sf_dir, gaps=True)).select("r", "c", "slope", "z")
    disc = [(a, b) for a in range(-10, 11) for b in range(-10, 11) if a * a + b * b <= 100]
    turn = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disc]))
    at = parkings(spark, sf_dir).select("parking", F.floor(F.col("y") / 10).alias("pr"), F.floor(F.col("x") / 10).alias("pc"), turn.alias("t"))
    # Spark takes a disc for as small as its parking and would broadcast the cells of all discs
    near = at.select("parking", (F.col("pr") + F.col("t.a")).cast("int").alias("r"), (F.col("pc") + F.col("t.b")).cast("int").alias("c")).join(d.hint("merge"), ["r", "c"])
    band = F.avg(F.when(F.col("slope").isNotNull(), ((F.col("slope") > 20) & (F.col("slope") < 30)).cast("double")))
    return near.groupBy("parking").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.min("slope"), 4).alias("low"), F.round(F.max("slope"), 4).alias("high"), F.round(F.percentile("slope", F.lit(0.5)), 4).alias("middle"),
        F.round(band, 4).alias("band_share"), F.round(100.0 * F.count("z") / F.count(F.lit(1)), 1).alias("coverage"),
    )


@query(f"""WITH {SIDE}, {PARKING}, far AS (SELECT parking, x*100 AS x, y*100 AS y, drive_min FROM parking), b AS (SELECT DISTINCT block_x, block_y FROM {_BLOCKS.format(r='12000', t='far')} WHERE sqrt(dx*dx+dy*dy) <= 12000),
m AS (SELECT (SELECT count(*) FROM b WHERE (block_x + block_y) // 4000 % 13 = 5) AS missing_blocks, (SELECT count(*) FROM supplier WHERE s_suppkey % 17 = 3 AND s_nationkey = 0) AS missing_parkings, (SELECT count(*) FROM (SELECT DISTINCT o_custkey % 400 AS t FROM orders) WHERE t % 40 = 7) AS missing_tiles, (SELECT count(*) FROM parking WHERE drive_min IS NULL) AS unknown_drive)
SELECT l::INT AS drive_limit, m.*, NOT (missing_blocks > 0 OR missing_parkings > 0 OR missing_tiles > 0 OR (l IS NOT NULL AND unknown_drive > 0)) AS complete FROM m, (SELECT unnest([NULL, 120]) AS l)""")
def scan_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a scan is complete with and without a drive limit: no block, parking or tile is missing, and under a limit no drive unknown."""
    p = parkings(spark, sf_dir)
    blocks = blocks_within(p.select("parking", (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y")), 12000.0).select("block_x", "block_y").distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = [
        n(blocks.where(F.floor((F.col("block_x") + F.col("block_y")) / 4000) % 13 == 5), "missing_blocks"), n(table(spark, sf_dir, "supplier").where("s_suppkey % 17 = 3 AND s_nationkey = 0"), "missing_parkings"),
        n(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("t")).distinct().where("t % 40 = 7"), "missing_tiles"), n(p.where("drive_min IS NULL"), "unknown_drive"),
    ]
    out = counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])  # one row each
    out = out.withColumn("drive_limit", F.explode(F.array(F.lit(None).cast("int"), F.lit(_DRIVE))))
    lacks = (F.col("missing_blocks") > 0) | (F.col("missing_parkings") > 0) | (F.col("missing_tiles") > 0) | (F.col("drive_limit").isNotNull() & (F.col("unknown_drive") > 0))
    return out.withColumn("complete", ~lacks)


_TOURS = "t AS (SELECT o_orderkey AS tour, o_custkey % 7 AS block, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS descent_m FROM orders), o AS (SELECT *, row_number() OVER (ORDER BY coalesce(descent_m, 0) DESC, tour) AS rank FROM t)"


def _ordered_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(k.alias("tour"), F.when(k % 9 > 0, F.col("o_totalprice")).alias("descent_m"))
    return ranked(t, [F.coalesce("descent_m", F.lit(0.0)).desc(), F.col("tour")]).withColumn("rank", F.col("rank") + 1)


@query(f"WITH {_TOURS} SELECT tour, rank FROM o")
def tours_by_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tours from the longest descent on; those without one come last."""
    return _ordered_tours(spark, sf_dir).select("tour", "rank")


@query(f"WITH {_TOURS}, f AS (SELECT 'run-' || lpad(p_partkey::VARCHAR, 9, '0') || '.gpx' AS file, row_number() OVER (ORDER BY p_partkey) AS rank FROM part) SELECT tour, file FROM o LEFT JOIN f USING (rank)")
def tour_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tour with the file of its place; tours beyond the last file have none."""
    name = F.concat(F.lit("run-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".gpx"))
    files = ranked(table(spark, sf_dir, "part").select(name.alias("file")), [F.col("file")]).withColumn("rank", F.col("rank") + 1)
    return _ordered_tours(spark, sf_dir).join(files, "rank", "left").select("tour", "file")


@query("""WITH t AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS off FROM events), l AS (SELECT event_id, timezone('Europe/Oslo', timezone('UTC', date_trunc('second', ts) - to_hours(off))) AS at_ FROM t) SELECT event_id, strftime(at_, '%Y-%m-%d') AS day, strftime(at_, '%H:%M') AS clock FROM l""")
def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and clock in Oslo of times as text: with Z, with an offset, or without either, which counts as summer time there."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+01:00").otherwise(""))
    t = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    whole = F.when(F.col("text").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.col("text")).otherwise(F.concat("text", F.lit("+02:00")))
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Oslo"), F.to_timestamp_ntz(F.date_format(F.to_timestamp(whole), "yyyy-MM-dd HH:mm:ss")))
    return t.select("event_id", F.date_format(local, "yyyy-MM-dd").alias("day"), F.date_format(local, "HH:mm").alias("clock"))


_LEGS = """v AS MATERIALIZED (SELECT user_id AS leg, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, 400000e0 + user_id*700 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)*90 AS x, 6900000e0 + user_id*450 + value*400 AS y FROM events),
own AS (SELECT leg // 4 AS route, leg, leg % 4 AS place FROM (SELECT DISTINCT leg FROM v)),
w AS MATERIALIZED (SELECT route, x, y, row_number() OVER (PARTITION BY route ORDER BY place, seq) - 1 AS ord FROM own JOIN v USING (leg))"""


@query(f"""WITH {_LEGS}, b AS (SELECT DISTINCT route, block_x, block_y FROM {_BLOCKS.format(r='5000', t='(SELECT * FROM w WHERE ord % 5 = 0)')} WHERE greatest(dx, dy) <= 5000),
k AS (SELECT b.route, block_x, block_y, min(sqrt(pow(greatest(block_x - x, 0e0, x - block_x - 28000), 2) + pow(greatest(block_y - y, 0e0, y - block_y - 28000), 2))) AS d, min_by(x, ord) AS x0, min_by(y, ord) AS y0 FROM b JOIN w USING (route) GROUP BY ALL)
SELECT route, block_x, block_y, round(sqrt(pow(block_x + 14000 - x0, 2) + pow(block_y + 14000 - y0, 2))/1000, 3) AS dist_km FROM k WHERE d <= 5000""")
def corridor_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks within five kilometres of a route of several legs, whose stored lines follow one another, with their distance from its start.

    Blocks are looked for around every fifth vertex of the whole route, and kept by their least distance to any.
    """
    from ridgeline.sources.fixtures import paths as points

    v = points(spark, sf_dir).select(F.col("path").alias("leg"), "seq", (400000.0 + F.col("path") * 700 + F.col("seq") * 90).alias("x"), (6900000.0 + F.col("path") * 450 + F.col("z") * 400).alias("y"))
    along = Window.partitionBy("route").orderBy("place", "seq")
    w = v.select(F.floor(F.col("leg") / 4).alias("route"), (F.col("leg") % 4).alias("place"), "seq", "x", "y").withColumn("i", F.row_number().over(along) - 1)
    w = graph.materialize(w, "route-points")
    found = blocks_within(w.where("i % 5 = 0").select("route", "x", "y"), 5000.0, True).select("route", "block_x", "block_y").distinct()
    near = blocks_within(w.select("route", "x", "y"), 5000.0).select("route", "block_x", "block_y").distinct()
    start = w.where("i = 0").select("route", F.col("x").alias("x0"), F.col("y").alias("y0"))
    dx, dy = F.col("block_x") + 14000 - F.col("x0"), F.col("block_y") + 14000 - F.col("y0")
    return found.join(near, ["route", "block_x", "block_y"]).join(start, "route").select("route", "block_x", "block_y", F.round(F.sqrt(dx * dx + dy * dy) / 1000, 3).alias("dist_km"))
