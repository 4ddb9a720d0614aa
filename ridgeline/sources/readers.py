"""Readers of raster tiles, road elements, shapes and documents. Null is unknown throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.sources.scratch import materialize

#: Fixed tag values by which a road is closed in winter.
CLOSED = [("winter_service", ("no",)), ("snowplowing", ("no",)), ("seasonal", ("summer", "yes"))]
POINT = "struct<lat:double,lon:double>"
ELEMENT = f"type string, id long, lat double, lon double, center {POINT}, geometry array<{POINT}>, tags map<string,string>"
PLAN = "version int, name string, points array<array<double>>"
FORECAST = "timeseries array<struct<id:long,data:struct<time:string,instant:struct<temperature:double>>>>"


def plausible(z: Column, low: float = -500.0, high: float = 9000.0) -> Column:
    """Heights out of range are unknown."""
    return F.when(z.between(low, high), z)


def mosaic(spark: SparkSession, cells: DataFrame, i0: int, i1: int, j0: int, j1: int, size: int, border: int) -> DataFrame:
    """cells (r, c, ti, tj, …) of the tiles in a window, without each tile's border; a tile without cells keeps one null row."""
    want = spark.range(i0, i1).withColumnRenamed("id", "ti").withColumn("tj", F.explode(F.sequence(F.lit(j0), F.lit(j1 - 1)).cast("array<bigint>")))
    window = cells.where(F.col("ti").between(i0, i1 - 1) & F.col("tj").between(j0, j1 - 1))
    inner = window.where((F.col("r") % size).between(border, size - 1 - border) & (F.col("c") % size).between(border, size - 1 - border))
    return want.join(inner, ["ti", "tj"], "left")


def elements(lines: DataFrame, column: str = "value") -> DataFrame:
    """Map elements from one JSON document a row; what can't be read goes."""
    return lines.select(F.from_json(column, ELEMENT).alias("e")).select("e.*").where("id IS NOT NULL")


def road_points(e: DataFrame) -> DataFrame:
    """(id, seq, lat, lon, highway, closed): the vertices of every element that is a road."""
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    closed = reduce(lambda a, b: a | b, (tag(k).isin(*v) for k, v in CLOSED))
    roads = e.where(tag("highway") != "").select("id", tag("highway").alias("highway"), closed.alias("closed"), F.posexplode("geometry").alias("seq", "p"))
    return roads.select("id", "seq", "p.lat", "p.lon", "highway", "closed")


def latitude_index(points: DataFrame) -> DataFrame:
    """points written in latitude order, so that a box reads the row groups of its latitudes alone."""
    return materialize(points.repartitionByRange("lat").sortWithinPartitions("lat", "lon"), "road-index")


def segments(points: DataFrame) -> DataFrame:
    """(id, lon, lat, lon2, lat2) of neighbouring vertices."""
    w = Window.partitionBy("id").orderBy("seq")
    return points.withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w)}).where("lon2 IS NOT NULL").select("id", "lon", "lat", "lon2", "lat2")


def hashed(s: DataFrame, size: float = 0.02) -> DataFrame:
    """Segments once for each cell (cx, cy) that their box touches."""
    cell = lambda f, a, b: F.floor(f(a, b) / size)
    s = s.withColumn("cx", F.explode(F.sequence(cell(F.least, "lon", "lon2"), cell(F.greatest, "lon", "lon2"))))
    return s.withColumn("cy", F.explode(F.sequence(cell(F.least, "lat", "lat2"), cell(F.greatest, "lat", "lat2"))))


def merged(chunks: list[DataFrame]) -> DataFrame:
    """Elements of overlapping answers, each once, with lat and lon of their centre, point or first vertex."""
    e = reduce(DataFrame.unionByName, chunks).dropDuplicates(["type", "id"])
    at = lambda f: F.coalesce(f"center.{f}", f, F.get("geometry", F.lit(0))[f])
    return e.withColumns({"lat": at("lat"), "lon": at("lon")})


def stored_elements(answers: DataFrame, found: DataFrame, box: tuple[float, float, float, float], as_of: str) -> DataFrame:
    """found (answer, type, id, lat, lon, ...) of the answers (answer, source, asked, error) up to a time that didn't fail, with their source.

    Of each type and id the newest counts, wherever it lies, and then only if its point is in the box (west, south,
    east, north). Among answers of one time the greatest answer is the newest.
    """
    known = answers.where(F.col("error").isNull() & (F.col("asked") <= F.lit(as_of).cast(answers.schema["asked"].dataType))).select("answer", "source", "asked")
    each = found.join(known, "answer")
    newest = each.groupBy("type", "id").agg(F.max_by(F.struct(*[c for c in each.columns if c not in ("type", "id")]), F.struct("asked", "answer")).alias("n")).select("type", "id", "n.*").drop("asked")
    return newest.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def source_states(answers: DataFrame, found: DataFrame, box: tuple[float, float, float, float], as_of: str) -> DataFrame:
    """(source, answered, failed, last_error, elements, state): unknown without any answer, empty without elements in the box, else known."""
    at = answers.where(F.col("asked") <= F.lit(as_of).cast(answers.schema["asked"].dataType))
    n = at.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("answered"), F.count("error").alias("failed"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("asked", "answer"))).alias("last_error"))
    inside = stored_elements(answers, found, box, as_of).groupBy("source").agg(F.count(F.lit(1)).alias("elements"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = answers.select("source").distinct().join(n, "source", "left").join(inside, "source", "left").select("source", zero("answered"), zero("failed"), "last_error", zero("elements"))
    return out.withColumn("state", F.when(F.col("answered") == 0, "unknown").when(F.col("elements") == 0, "empty").otherwise("known"))


def wkt_points(wkt: Column) -> Column:
    """The (lon, lat) pairs of a shape as WKT; pairs that are no numbers go."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?\d+(?:\.\d+)?) (-?\d+(?:\.\d+)?)"), F.lit(0))
    point = lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("lon"), F.split(p, " ")[1].cast("double").alias("lat"))
    return F.transform(F.coalesce(pairs, F.array().cast("array<string>")), point)


def properties(props: Column) -> Column:
    """A list of (name, value) as a map, without values that are unknown."""
    known = F.filter(props, lambda p: p["value"].isNotNull())
    return F.map_from_entries(F.transform(known, lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value"))))


def with_minutes(points: DataFrame, times: DataFrame, lon: str) -> DataFrame:
    """points with drive_min, from times (key, seconds) by their coordinate to four places."""
    at = times.select("key", F.round(F.col("seconds") / 60).cast("int").alias("drive_min"))
    return points.withColumn("key", F.round(lon, 4)).join(at, "key", "left").drop("key")


def forecast_hours(docs: DataFrame, start: int, end: int, zone: str = "Europe/Oslo") -> DataFrame:
    """docs exploded to the hours whose local clock is in [start, end), with local day and temperature."""
    each = docs.withColumn("h", F.explode(F.from_json("doc", FORECAST)["timeseries"])).drop("doc")
    local = F.from_utc_timestamp(F.to_timestamp("h.data.time"), zone)
    out = each.withColumn("local", local).where((F.hour("local") >= start) & (F.hour("local") < end))
    return out.select(*[c for c in docs.columns if c != "doc"], F.col("h.id").alias("id"), F.date_format("local", "yyyy-MM-dd").alias("day"), F.col("h.data.instant.temperature").alias("temperature"))


def plans(docs: DataFrame, column: str) -> DataFrame:
    """docs whose plan is of version 1 and has two points or more, with its fields."""
    out = docs.withColumn("_p", F.from_json(column, PLAN)).where((F.col("_p.version") == 1) & (F.size("_p.points") >= 2))
    return out.select(*[c for c in docs.columns if c != column], "_p.*")


def gpx_points(docs: DataFrame, column: str, most: int = 2_000_000) -> DataFrame:
    """docs' other columns with seq, lat, lon and z of the points of each GPX document, whatever its namespace.

    Of several tracks that named Up counts; without it, documents with more than one track or segment give no
    points, nor do those longer than most characters. Without a track, the points of the one route count.
    """
    node = lambda x: f'*[local-name()="{x}"]'
    number = lambda path: F.xpath_int(column, F.lit(f"count({path})"))
    up = f'//{node("trk")}[starts-with({node("name")}, "Up")]'
    d = docs.where(F.length(column) <= most).withColumns({"_up": number(up), "_trk": number(f'//{node("trk")}'), "_seg": number(f'//{node("trkseg")}'), "_rte": number(f'//{node("rte")}')})
    kinds = [(F.col("_up") == 1, f'{up}//{node("trkpt")}'), ((F.col("_trk") == 1) & (F.col("_seg") == 1), f'//{node("trkpt")}'), ((F.col("_trk") == 0) & (F.col("_rte") == 1), f'//{node("rtept")}')]
    pick = lambda tail: F.coalesce(*[F.when(c, F.xpath(column, F.lit(path + tail))) for c, path in kinds])
    # heights are aligned only if every point has one
    d = d.withColumns({"_lat": pick("/@lat"), "_lon": pick("/@lon"), "_ele": pick(f'/{node("ele")}/text()')})
    z = F.when(F.size("_ele") == F.size("_lat"), F.get("_ele", F.col("seq")))
    each = d.select(*[c for c in docs.columns if c != column], "_lon", "_ele", "_lat", F.posexplode("_lat").alias("seq", "lat"))
    names = [c for c in docs.columns if c != column]
    return each.select(*names, "seq", F.col("lat").cast("double").alias("lat"), F.get("_lon", F.col("seq")).cast("double").alias("lon"), z.cast("double").alias("z"))
