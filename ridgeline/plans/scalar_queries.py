"""Queries of projection, time, sun and formats, one row per input row and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.plans.registry import PARKING, SIDE, registry
from ridgeline.sources.fixtures import parkings, side
from ridgeline.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
LON, LAT = "(7e0 + (o_orderkey % 600)/100e0)", "(62e0 + (o_orderkey % 250)/100e0)"


def _lonlat() -> tuple[F.Column, F.Column]:
    k = F.col("o_orderkey")
    return 7.0 + (k % 600) / 100.0, 62.0 + (k % 250) / 100.0


def inverse_sql(source: str, east: str, north: str) -> str:
    """SELECT of source with lon and lat of its eastings and northings."""
    terms = lambda k, f, g: " + ".join(f"{c!r}*{f}({2 * j}*xi)*{g}({2 * j}*eta)" for j, c in enumerate(k, 1))
    back = " + ".join(f"{c!r}*sin({2 * j}*chi)" for j, c in enumerate(geo.GEODETIC, 1))
    return f"""SELECT *, {geo.LON0!r} + degrees(atan2(sinh(y_), cos(x_))) AS lon, degrees(chi + {back}) AS lat FROM (SELECT *, asin(sin(x_)/cosh(y_)) AS chi FROM
(SELECT *, xi - ({terms(geo.INVERSE, 'sin', 'cosh')}) AS x_, eta - ({terms(geo.INVERSE, 'cos', 'sinh')}) AS y_ FROM (SELECT *, {north}/{geo.K0 * geo.RADIUS!r} AS xi, ({east}-500000e0)/{geo.K0 * geo.RADIUS!r} AS eta FROM {source})))"""


@query(f"""WITH t AS (SELECT o_orderkey AS id, 200000e0 + (o_orderkey % 50)*4000 AS w, 6900000e0 + (o_orderkey % 30)*4000 AS s FROM orders),
q AS (SELECT id, w + dx AS e, s + dy AS n FROM t, (VALUES (0, 0), (4000, 0), (0, 4000), (4000, 4000)) v(dx, dy)), l AS ({inverse_sql('q', 'e', 'n')})
SELECT id, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM l GROUP BY id""")
def lonlat_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    west, south = 200000.0 + (k % 50) * 4000, 6900000.0 + (k % 30) * 4000
    box = geo.envelope(west, south, west + 4000, south + 4000)
    return table(spark, sf_dir, "orders").select(k.alias("id"), *[F.round(b, 6).alias(n) for b, n in zip(box, ("west", "south", "east", "north"), strict=True)])


@query(f"WITH {SIDE}, {PARKING}, m AS (SELECT parking, floor((10*n - 300 - y)/10)::INT AS r, floor((x - 200)/10)::INT AS c, n - 40 AS m FROM parking, n), k AS (SELECT parking, CASE WHEN r >= 0 AND r < m AND c >= 0 AND c < m THEN r END AS r, CASE WHEN r >= 0 AND r < m AND c >= 0 AND c < m THEN c END AS c FROM m) SELECT parking, r, c, c*10 + 205e0 AS x, (SELECT 10*n - 300 FROM n) - r*10 - 5e0 AS y, coalesce(r >= 4 AND r < 20 AND c >= 4 AND c < 20, false) AS core FROM k")
def cell_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = side(spark, sf_dir)
    north = 10 * n - 300
    r, c = geo.cell_of(F.col("x"), F.col("y"), 200.0, float(north), F.lit(n - 40), F.lit(n - 40))
    out = parkings(spark, sf_dir).select("parking", r.alias("r"), c.alias("c"))
    core = F.col("r").between(4, 19) & F.col("c").between(4, 19)
    return out.select("parking", "r", "c", (F.col("c") * 10 + 205.0).alias("x"), (north - F.col("r") * 10 - 5.0).alias("y"), F.coalesce(core, F.lit(False)).alias("core"))


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, ((o_orderkey % 40) / 2e0 + 4)::DOUBLE AS hour FROM orders), u AS (SELECT *, timezone('UTC', timezone('Europe/Oslo', day::TIMESTAMP + to_seconds((hour*3600)::BIGINT))) AS at_ FROM t)
SELECT id, strftime(at_, '%Y-%m-%d %H:%M') AS utc, (epoch(day::TIMESTAMP) + hour*3600 - epoch(at_))::BIGINT // 3600 AS offset_h, strftime(timezone('Europe/Oslo', timezone('UTC', at_ + INTERVAL 9 HOUR)), '%Y-%m-%d') AS later_day FROM u""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, hour = F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 40) / 2.0 + 4
    at = geo.local_instant(day, hour)
    offset = (F.unix_seconds(day.cast("timestamp")) + hour * 3600 - F.unix_seconds(at)).cast("long") / 3600
    later = F.from_utc_timestamp(F.timestamp_seconds(F.unix_seconds(at) + 9 * 3600), "Europe/Oslo")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("utc"), offset.cast("long").alias("offset_h"), F.date_format(later, "yyyy-MM-dd").alias("later_day"))


def solar_sql(source: str, lat: str, lon: str, seconds: str) -> str:
    """SELECT of source with azimuth and elevation."""
    return f"""SELECT *, ((degrees(atan2(sin(hour), cos(hour)*sin(radians({lat})) - tan(dec)*cos(radians({lat})))) + 180) % 360 + 360) % 360 AS azimuth, degrees(asin(sin(radians({lat}))*sin(dec) + cos(radians({lat}))*cos(dec)*cos(hour))) AS elevation FROM
(SELECT *, asin(sin(tilt)*sin(ecl)) AS dec, radians(280.46061837e0 + 360.98564736629e0*d_ + {lon}) - atan2(cos(tilt)*sin(ecl), cos(ecl)) AS hour FROM
(SELECT *, radians(280.459e0 + 0.98564736e0*d_ + 1.915e0*sin(g_) + 0.020e0*sin(2*g_)) AS ecl, radians(23.439e0 - 0.00000036e0*d_) AS tilt FROM (SELECT *, radians(357.529e0 + 0.98560028e0*d_) AS g_ FROM (SELECT *, {seconds}/86400e0 - 10957.5e0 AS d_ FROM {source}))))"""


@query(f"""WITH t AS (SELECT o_orderkey AS id, {LON} AS lon, {LAT} AS lat, epoch(o_orderdate) + (o_orderkey % 24)*3600 AS sec, (o_orderkey % 40)*1e0 AS slope, (o_orderkey*7 % 360)*1e0 AS aspect FROM orders), p AS ({solar_sql('t', 'lat', 'lon', 'sec')})
SELECT id, round(azimuth, 4) AS azimuth, round(elevation, 4) AS elevation, round(CASE WHEN slope < 0.001 THEN sin(radians(elevation)) ELSE sin(radians(elevation))*cos(radians(slope)) + cos(radians(elevation))*sin(radians(slope))*cos(radians(azimuth) - radians(aspect)) END, 4) AS incidence, round(degrees(atan(tan(radians(lon - 15))*sin(radians(lat)))), 5) AS convergence FROM p""")
def solar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, (lon, lat) = F.col("o_orderkey"), _lonlat()
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (k % 24) * 3600
    azimuth, elevation = geo.solar(lat, lon, seconds.cast("double"))
    d = table(spark, sf_dir, "orders").select(k.alias("id"), azimuth.alias("azimuth"), elevation.alias("elevation"), (k % 40).cast("double").alias("slope"), (k * 7 % 360).cast("double").alias("aspect"), geo.convergence(lon, lat).alias("convergence"))
    lit = geo.incidence(F.col("slope"), F.col("aspect"), F.col("azimuth"), F.col("elevation"))
    return d.select("id", F.round("azimuth", 4).alias("azimuth"), F.round("elevation", 4).alias("elevation"), F.round(lit, 4).alias("incidence"), F.round("convergence", 5).alias("convergence"))


_SECTORS = "['N','NE','E','SE','S','SW','W','NW']"


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 360 >= 315 OR o_orderkey % 360 < 45 THEN 'N' WHEN o_orderkey % 360 < 135 THEN 'E' WHEN o_orderkey % 360 < 225 THEN 'S' ELSE 'W' END AS quadrant,
printf('%d h %02d min', floor(o_totalprice/1e5*60+0.5)::BIGINT // 60, floor(o_totalprice/1e5*60+0.5)::BIGINT % 60) AS duration,
coalesce(nullif(array_to_string(list_filter([CASE WHEN (o_orderkey >> (i-1)) & 1 = 1 THEN {_SECTORS}[i] END for i in range(1, 9)], lambda x: x IS NOT NULL), ', '), ''), 'none') AS expositions,
CASE o_orderkey % 5 WHEN 1 THEN printf('above %d m', o_custkey) WHEN 2 THEN printf('below %d m', o_custkey) WHEN 3 THEN printf('above %d m and below %d m', o_custkey + 300, o_custkey) WHEN 4 THEN printf('%d-%d m', o_custkey, o_custkey + 300) ELSE 'all heights' END AS heights,
lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '-' || regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-' || o_custkey AS file_name,
round(o_totalprice/(1 + o_orderkey % 7), 0) AS score, round(o_totalprice - 0.3e0*o_custkey - 3e0*(o_orderkey % 50), 2) AS loop_score, round(o_totalprice/8000e0 + o_custkey/4000e0, 8) AS down_hours,
CASE WHEN o_orderkey % 9 > 0 THEN round(1e0*o_custkey/(o_orderkey % 9), 2) END AS finite FROM orders""")
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.pmod(F.floor(k / F.pow(F.lit(2.0), i)), F.lit(2)) == 1, "1").otherwise("0")), "")
    ratio = F.try_divide(c.cast("double"), (k % 9).cast("double"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), geo.quadrant((k % 360).cast("double")).alias("quadrant"), geo.duration(price / 1e5).alias("duration"), geo.expositions(bits).alias("expositions"),
        geo.height_text(k % 5, c, c + 300).alias("heights"), F.concat_ws("-", F.lpad((k % 1000).cast("string"), 3, "0"), geo.slug(F.col("o_orderpriority")), c).alias("file_name"),
        F.round(price / (1 + k % 7), 0).alias("score"), F.round(price - 0.3 * c - 3.0 * (k % 50), 2).alias("loop_score"), F.round(price / 8000 + c / 4000.0, 8).alias("down_hours"), geo.finite(ratio).alias("finite"),
    )


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN (o_custkey*1000)::VARCHAR || '_' || (o_orderkey % 77) || '_s' || (o_orderkey % 9) WHEN 1 THEN 'n' || o_custkey ELSE o_custkey || '_x' END AS node FROM orders)
SELECT id, node, CASE WHEN len(string_split(node, '_')) >= 3 THEN regexp_replace(node, '_[^_]*$', '') ELSE 'x' END AS block, round(7e0 + (id % 600)/7e0, 5) AS lon_key FROM t""")
def node_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    node = F.when(k % 3 == 0, F.concat_ws("_", F.col("o_custkey") * 1000, k % 77, F.concat(F.lit("s"), k % 9))).when(k % 3 == 1, F.concat(F.lit("n"), c)).otherwise(F.concat(c, F.lit("_x")))
    out = table(spark, sf_dir, "orders").select(k.alias("id"), node.alias("node"), F.round(7.0 + (k % 600) / 7.0, 5).alias("lon_key"))
    return out.withColumn("block", geo.block_of(F.col("node")))
