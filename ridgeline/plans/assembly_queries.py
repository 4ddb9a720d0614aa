"""Queries that put the tour graph together, and that choose, rank and thin what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators import graph, spatial, terrain
from ridgeline.operators.ranks import ranked
from ridgeline.plans.access_queries import D
from ridgeline.plans.registry import EDGE, PARKING, PATH, ROAD, SIDE, cells_sql, registry
from ridgeline.sources.fixtures import cells, edges, parkings, roads, side
from ridgeline.sources.fixtures import paths as points
from ridgeline.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()


def assembled(found: DataFrame, eligible: DataFrame, summits: DataFrame, runs: DataFrame, legs: DataFrame) -> dict[str, DataFrame]:
    """The tour graph of several blocks.

    found: id, key, ord; of parkings at one key the first is kept. eligible: key, drive_min, access. summits: id,
    elevation, ord and runs: id, summits, ord; the last of an id counts. legs: src, dst, kind, hours. Legs are led
    to the kept parkings, need both ends, and the shortest of each kind stays; then all that no kept parking
    reaches along legs, or from a summit to its runs, goes.
    """
    first = found.groupBy("key").agg(F.min_by("id", "ord").alias("kept"))
    renamed = found.join(first, "key").where("id <> kept").select("id", "kept")
    kept = first.join(eligible, "key").select(F.col("kept").alias("id"), "drive_min", "access")
    last = lambda df: df.groupBy("id").agg(*[F.max_by(c, "ord").alias(c) for c in df.columns if c not in ("id", "ord")])
    summits, runs = last(summits), last(runs)
    nodes = graph.materialize(kept.select("id").unionByName(summits.select("id")).unionByName(runs.select("id")), "nodes")
    for end in ("src", "dst"):
        own = renamed.select(F.col("id").alias(end), "kept")
        legs = legs.join(own, end, "left").withColumn(end, F.coalesce("kept", end)).drop("kept").join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    legs = graph.materialize(legs.groupBy("src", "dst", "kind").agg(F.min("hours").alias("hours")), "legs")
    down = runs.select(F.explode("summits").alias("src"), F.col("id").alias("dst"))
    ways = graph.materialize(legs.select("src", "dst").unionByName(down).distinct(), "ways")
    reached = graph.reachable(kept.select(F.col("id").alias("node")), ways)
    both = legs.join(reached.select(F.col("node").alias("src")), "src", "left_semi").join(reached.select(F.col("node").alias("dst")), "dst", "left_semi")
    ids = reached.select(F.col("node").alias("id"))
    own = runs.join(ids, "id", "left_semi").select("id", F.explode_outer("summits").alias("summit")).join(ids.select(F.col("id").alias("summit"), F.lit(1).alias("_in")), "summit", "left")
    runs = own.groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("_in") == 1, F.col("summit")))).alias("summits"))
    return {"parkings": kept, "summits": summits.join(ids, "id", "left_semi"), "runs": runs, "edges": both}


@query(f"""WITH RECURSIVE {EDGE}, pk AS (SELECT 'p'||s_suppkey AS id, s_suppkey % 37 AS key, (s_suppkey % 4)*100000 + s_suppkey AS ord FROM supplier),
canon AS (SELECT id, key, first(id) OVER (PARTITION BY key ORDER BY ord) AS kept FROM pk),
parking AS MATERIALIZED (SELECT DISTINCT kept AS id, (key*37) % 180 AS drive_min FROM canon WHERE key % 5 <> 0),
summit AS MATERIALIZED (SELECT 's'||p_partkey AS id, p_size + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END AS elevation FROM part), own AS MATERIALIZED (SELECT 'r'||(p_partkey % 500) AS id, 's'||p_partkey AS summit FROM part),
node AS MATERIALIZED (SELECT id FROM parking UNION SELECT id FROM summit UNION SELECT id FROM own),
leg AS MATERIALIZED (SELECT coalesce(a.kept, src) AS src, coalesce(b.kept, dst) AS dst, kind, min(hours) AS hours FROM edge LEFT JOIN canon a ON a.id = src LEFT JOIN canon b ON b.id = dst WHERE coalesce(a.kept, src) IN (SELECT id FROM node) AND coalesce(b.kept, dst) IN (SELECT id FROM node) GROUP BY ALL),
way AS MATERIALIZED (SELECT src, dst FROM leg UNION SELECT summit, id FROM own), reach(node) AS (SELECT id FROM parking UNION SELECT way.dst FROM reach JOIN way ON way.src = reach.node)
SELECT 'parking' AS part, id, drive_min::DOUBLE AS value FROM parking UNION ALL SELECT 'summit', id, elevation::DOUBLE FROM summit WHERE id IN (SELECT node FROM reach) UNION ALL SELECT 'run', id, count(*) FILTER (summit IN (SELECT node FROM reach))::DOUBLE FROM own WHERE id IN (SELECT node FROM reach) GROUP BY id
UNION ALL SELECT 'edge', src||'>'||dst||'>'||kind, round(hours, 4) FROM leg WHERE src IN (SELECT node FROM reach) AND dst IN (SELECT node FROM reach)""")
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("s_suppkey"), F.col("p_partkey")
    found = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), s).alias("id"), (s % 37).alias("key"), ((s % 4) * 100000 + s).alias("ord"))
    eligible = found.select("key").distinct().where(F.col("key") % 5 != 0).select("key", ((F.col("key") * 37) % 180).alias("drive_min"), F.lit("plowed").alias("access"))
    part = table(spark, sf_dir, "part").select(k, "p_size")
    sid = F.concat(F.lit("s"), k).alias("id")
    summits = part.select(sid, F.col("p_size").alias("elevation"), F.lit(0).alias("ord")).unionByName(part.where(k % 3 == 0).select(sid, (F.col("p_size") + 100).alias("elevation"), F.lit(1).alias("ord")))
    runs = part.groupBy(F.concat(F.lit("r"), k % 500).alias("id")).agg(F.collect_list(F.concat(F.lit("s"), k)).alias("summits"), F.lit(0).alias("ord"))
    g = assembled(found, eligible, summits, runs, edges(spark, sf_dir))
    rows = [
        g["parkings"].select(F.lit("parking").alias("part"), "id", F.col("drive_min").cast("double").alias("value")), g["summits"].select(F.lit("summit"), "id", F.col("elevation").cast("double")),
        g["runs"].select(F.lit("run"), "id", F.size("summits").cast("double")), g["edges"].select(F.lit("edge"), F.concat_ws(">", "src", "dst", "kind"), F.round("hours", 4)),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("""WITH want AS (SELECT i AS block FROM range(0, 12) t(i)), have AS (SELECT DISTINCT o_custkey % 16 AS block FROM orders WHERE o_custkey % 16 NOT IN (3, 7))
SELECT block, CASE WHEN block IN (SELECT block FROM have) THEN 'scanned' ELSE 'missing' END AS state, (SELECT count(*) FROM want WHERE block NOT IN (SELECT block FROM have)) AS missing FROM want""")
def scan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected blocks, of which those with a result are read and the others counted as missing."""
    have = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 16).alias("block")).where(~F.col("block").isin(3, 7)).distinct()
    want = spark.range(12).withColumnRenamed("id", "block")
    missing = want.subtract(have)
    both = want.intersect(have).withColumn("state", F.lit("scanned")).unionByName(missing.withColumn("state", F.lit("missing")))
    return both.crossJoin(F.broadcast(missing.agg(F.count(F.lit(1)).alias("missing"))))  # one row


@query(f"""WITH {PATH}, p AS (SELECT path, seq, z, path % 4 AS forest, (seq + path) % 9 = 0 AS lake, (seq + path) % 13 = 0 AS runout, CASE WHEN path % 4 > 0 THEN (seq % 3 > 0)::INT END AS trees FROM path)
SELECT path, CASE WHEN path % 4 > 0 THEN round(100e0*sum(CASE WHEN trees > 0 THEN 1 ELSE 0 END)/count(*), 4) END AS forest_share, CASE WHEN path % 4 > 0 THEN CASE WHEN 100e0*sum(trees)/count(*) >= 60 THEN 'trees' WHEN 100e0*sum(trees)/count(*) <= 20 THEN 'open' ELSE 'mixed' END END AS terrain, sum(lake::INT)*10 AS lake_m, CASE WHEN path % 5 > 0 THEN sum(runout::INT)*10 END AS runout_m FROM p GROUP BY path""")
def path_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of forest and lengths on lakes and in runout zones; without a mask they are unknown, not zero."""
    from ridgeline.operators import paths

    p = points(spark, sf_dir).select("path", "seq", F.when(F.col("path") % 4 > 0, (F.col("seq") % 3 > 0).cast("int")).alias("forest"), ((F.col("seq") + F.col("path")) % 9 == 0).cast("int").alias("water"), F.when(F.col("path") % 5 > 0, ((F.col("seq") + F.col("path")) % 13 == 0).cast("int")).alias("runout"))
    s = paths.surfaces(p)
    return s.select("path", F.round("forest_share", 4).alias("forest_share"), paths.terrain_class(F.col("forest_share")).alias("terrain"), "lake_m", "runout_m")


@query(f"""WITH {PATH}, e AS (SELECT path, seq, 10e0*(seq-1) AS walked, max(seq) OVER (PARTITION BY path) AS last FROM path), k AS (SELECT path, max(CASE WHEN walked <= 300 THEN seq END) AS cut FROM e GROUP BY path)
SELECT e.path, count(*) AS points, min(seq)::INT AS first, round(max(walked) - min(walked), 4) AS length FROM e JOIN k USING (path) WHERE seq >= cut GROUP BY e.path""")
def trimmed_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes without their first 300 m, from the last point before that on."""
    from ridgeline.operators import paths

    walked = F.sum(F.when(F.col("seq") > 1, 10.0).otherwise(0.0)).over(paths.so_far())
    kept = paths.without_head(points(spark, sf_dir).withColumn("walked", walked), 300.0)
    return kept.groupBy("path").agg(F.count(F.lit(1)).alias("points"), F.min("seq").alias("first"), F.round(F.max("walked") - F.min("walked"), 4).alias("length"))


_LINE = "(SELECT c_custkey AS id, (c_custkey*37 % (10*n))*1e0 + 0.3 AS ax, (c_custkey*91 % (10*n))*1e0 + 0.1 AS ay, (c_custkey*37 % (10*n)) + 0.3 + (c_custkey % 7 - 3)*11e0 AS bx, (c_custkey*91 % (10*n)) + 0.1 + (c_custkey % 5 - 2)*13e0 AS by_ FROM customer, n WHERE c_custkey % 3 {})"
_SIDE_OF = "sign(({q}x - {p}x)*({r}y - {p}y) - ({q}y - {p}y)*({r}x - {p}x))"


@query(f"""WITH {SIDE}, w AS (SELECT id, ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS ex, by_::DOUBLE AS ey FROM {_LINE.format('= 0')}), v AS (SELECT id, ax::DOUBLE AS cx, ay::DOUBLE AS cy, bx::DOUBLE AS dx, by_::DOUBLE AS dy FROM {_LINE.format('> 0')})
SELECT w.id, count(v.id) AS crossings FROM w LEFT JOIN v ON {_SIDE_OF.format(p='a', q='e', r='c')} * {_SIDE_OF.format(p='a', q='e', r='d')} < 0 AND {_SIDE_OF.format(p='c', q='d', r='a')} * {_SIDE_OF.format(p='c', q='d', r='e')} < 0 GROUP BY w.id""")
def road_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many road segments a leg properly crosses, found by the cells that both touch."""
    k, extent = F.col("c_custkey"), 10 * side(spark, sf_dir)
    ax, ay = (k * 37 % extent) + 0.3, (k * 91 % extent) + 0.1
    line = table(spark, sf_dir, "customer").select(k.alias("id"), ax.alias("lon"), ay.alias("lat"), (ax + (k % 7 - 3) * 11.0).alias("lon2"), (ay + (k % 5 - 2) * 13.0).alias("lat2"))
    legs, roads_ = line.where(k % 3 == 0), line.where(k % 3 > 0)
    hits = spatial.crossings(legs, roads_, 20.0).groupBy("id").agg(F.count(F.lit(1)).alias("crossings"))
    return legs.select("id").join(hits, "id", "left").select("id", F.coalesce("crossings", F.lit(0)).alias("crossings"))


@query("""WITH t AS (SELECT o_orderkey AS tour, o_orderkey % 40 AS max_slope, o_totalprice/1e5 AS hours, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 150 END AS drive_min, (o_orderkey*7) % 360 AS aspect, CASE WHEN o_orderkey % 5 > 0 THEN ['trees', 'mixed', 'open'][1 + o_orderkey % 3] END AS terrain, o_custkey AS bottom FROM orders)
SELECT tour, row_number() OVER (ORDER BY coalesce(drive_min, 999), hours DESC, tour) AS rank FROM t WHERE max_slope <= 32 AND hours BETWEEN 0.5 AND 4 AND coalesce(drive_min, 999) <= 120 AND (aspect >= 315 OR aspect < 135) AND bottom >= 10 AND terrain IN ('trees', 'mixed') ORDER BY rank LIMIT 100""")
def tour_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred first tours of a page's filters and order; an unknown drive counts as very long, an unknown terrain fits no class."""
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(
        k.alias("tour"), (k % 40).alias("max_slope"), (F.col("o_totalprice") / 1e5).alias("hours"), F.when(k % 11 > 0, F.col("o_custkey") % 150).alias("drive_min"), (k * 7 % 360).alias("aspect"),
        F.when(k % 5 > 0, F.element_at(F.array(*map(F.lit, ("trees", "mixed", "open"))), (1 + k % 3).cast("int"))).alias("terrain"), F.col("o_custkey").alias("bottom"),
    )
    drive = F.coalesce("drive_min", F.lit(999))
    fits = (F.col("max_slope") <= 32) & F.col("hours").between(0.5, 4) & (drive <= 120) & ((F.col("aspect") >= 315) | (F.col("aspect") < 135)) & (F.col("bottom") >= 10) & F.col("terrain").isin("trees", "mixed")
    top = t.where(fits).withColumn("drive", drive).orderBy("drive", F.desc("hours"), "tour").limit(100)
    return top.select("tour", F.row_number().over(Window.orderBy("drive", F.desc("hours"), "tour")).cast("long").alias("rank"))  # a hundred rows


@query("""WITH b AS (SELECT o_orderkey AS run, 's'||(o_custkey % 97) AS summit, o_totalprice AS band, o_orderkey % 7 AS below FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY summit ORDER BY band DESC, run) AS i FROM b WHERE below < 6 AND band >= 300) SELECT summit, run, i::INT AS rank FROM k WHERE i <= 4""")
def top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four longest runs near each summit."""
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("s"), F.col("o_custkey") % 97).alias("summit"), F.col("o_totalprice").alias("band"), (F.col("o_orderkey") % 7).alias("below"))
    rank = F.row_number().over(Window.partitionBy("summit").orderBy(F.desc("band"), "run"))
    return b.where("below < 6 AND band >= 300").select("summit", "run", rank.alias("rank")).where("rank <= 4")


@query(f"""WITH {cells_sql(gaps=True)}, {PATH}, s AS (SELECT path, seq, path % n AS c, (seq*3) % (n + 5) AS r FROM path, n), j AS (SELECT s.path, s.seq, z, s.seq*30e0 AS walked FROM s LEFT JOIN cell ON cell.r = s.r AND cell.c = s.c)
SELECT path, count(*) AS samples, round(100e0*count(z)/count(*), 1) AS coverage, CASE WHEN count(z) = count(*) THEN round(max(z) - min(z), 4) END AS relief, round(max(walked), 1) AS distance FROM j GROUP BY path""")
def route_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route samples with the heights of their cells; off the raster or in a gap they are unknown, and so is what needs all."""
    n = side(spark, sf_dir)
    s = points(spark, sf_dir).select("path", "seq", (F.col("path") % n).cast("int").alias("c"), ((F.col("seq") * 3) % (n + 5)).cast("int").alias("r"))
    j = s.join(cells(spark, sf_dir, gaps=True), ["r", "c"], "left").groupBy("path")
    known = F.count("z") == F.count(F.lit(1))
    return j.agg(F.count(F.lit(1)).alias("samples"), F.round(100.0 * F.count("z") / F.count(F.lit(1)), 1).alias("coverage"), F.when(known, F.round(F.max("z") - F.min("z"), 4)).alias("relief"), F.round(F.max(F.col("seq") * 30.0), 1).alias("distance"))


@query(f"""WITH {SIDE}, {PARKING}, {ROAD}, w AS (SELECT a.parking, b.road, {D} AS d, (a.parking + b.road) % 50 AS gain FROM parking a JOIN road b ON {D} <= 120), k AS (SELECT parking, road, d, gain FROM w WHERE gain <= 30 AND d <= 110)
SELECT parking, count(*) AS walks, round(min(d), 4) AS shortest, max(gain)::INT AS most_gain FROM k GROUP BY parking""")
def return_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways back from a run's end to a parking, not too far and without much climbing."""
    w = spatial.within(parkings(spark, sf_dir), roads(spark, sf_dir), 120.0).select("l.parking", "r.road", "d").withColumn("gain", (F.col("parking") + F.col("road")) % 50)
    return w.where("gain <= 30 AND d <= 110").groupBy("parking").agg(F.count(F.lit(1)).alias("walks"), F.round(F.min("d"), 4).alias("shortest"), F.max("gain").cast("int").alias("most_gain"))


@query(None)
def greedy_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces in order of their score, each kept that is 25 m or more from every better kept one: no SQL, tested by brute force."""
    n, k = side(spark, sf_dir), F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 3571) % (10 * n)).cast("double").alias("x"), ((k * 6007 + 11) % (10 * n)).cast("double").alias("y"), F.col("c_acctbal").alias("score"))
    kept = spatial.greedy_apart(p, "id", "score", 25.0)
    first = ranked(p.join(kept.select(F.col("node").alias("id")), "id", "left_semi"), [F.desc("score"), F.col("id")])
    return first.select("id", (F.col("rank") + 1).cast("int").alias("rank"))


@query(None)
def distinct_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four runs a summit, of which none ends within 60 m of a better one's end; runs of several summits that are one become one."""
    n, k = side(spark, sf_dir), F.col("o_orderkey")
    at = lambda a, b: ((k * a + b) % (10 * n)).cast("double")
    runs = table(spark, sf_dir, "orders").select(k.alias("run"), F.concat(F.lit("s"), F.col("o_custkey") % 97).alias("summit"), F.col("o_totalprice").alias("band"), at(3571, 0).alias("x"), at(6007, 11).alias("y"), at(7919, 3).alias("top_x"), at(104729, 5).alias("top_y"))
    return spatial.merge_twins(spatial.distinct_by_end(runs, 60.0, 4), 100.0, 200.0)
