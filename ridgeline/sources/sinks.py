"""Sinks: results by block that a later scan goes on with, geometry shards, GPX and GeoJSON documents, saved plans."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.sources.scratch import delete, discard, materialize

BLOCK = ["block_x", "block_y"]


def done_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block_x, block_y) that have a result under path. A block without rows has one as well: its marker."""
    try:
        done = spark.read.parquet(f"{path}/_blocks")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "block_x long, block_y long")
    return done.distinct()


def scan_blocks(blocks: DataFrame, work: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Results of work for blocks (block_x, block_y), written by block under path; finished blocks are read, not worked again.

    work takes the open blocks and returns rows with block_x and block_y. Only partitions that it returns are
    overwritten, and the markers follow the rows, so that a scan that was cut off starts again where it stopped.
    """
    spark = blocks.sparkSession
    wanted = blocks.select(*[F.col(b).cast("long") for b in BLOCK]).distinct()
    open_ = wanted.join(done_blocks(spark, path), BLOCK, "left_anti")
    if not open_.isEmpty():
        rows = work(open_)
        rows.hint("rebalance", *BLOCK).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BLOCK).parquet(f"{path}/rows")
        # the markers don't depend on the rows just written
        open_.join(done_blocks(spark, path), BLOCK, "left_anti").write.mode("append").parquet(f"{path}/_blocks")
    out = spark.read.parquet(f"{path}/rows").withColumns({b: F.col(b).cast("long") for b in BLOCK})
    return out.join(wanted, BLOCK, "left_semi")


def work_blocks(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, path: str) -> DataFrame:
    """Results of work for each block of rows (block_x, block_y, ...), written by block under path; a block that fails stops no other.

    work takes a block's rows, which one task holds, and returns rows of schema without block columns. Where it raises, the block has no results; its
    error and the number of its tries are in failed_blocks(), and the next call takes it again. Finished blocks aren't
    worked again. Returns the results of all finished blocks of rows.
    """
    spark = rows.sparkSession

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            out = work(frame).assign(_error=None, _row=True)
            if out.empty:
                out = pd.DataFrame({"_row": [False]})
        except Exception as failed:  # noqa: BLE001 - reported, not raised: whatever a block's work raises is that block's alone
            out = pd.DataFrame({"_error": [f"{type(failed).__name__}: {failed}"], "_row": [False]})
        return out.assign(block_x=key[0], block_y=key[1])

    names = [f.name for f in StructType.fromDDL(schema)]
    wanted = rows.withColumns({b: F.col(b).cast("long") for b in BLOCK})
    open_ = wanted.join(done_blocks(spark, path), BLOCK, "left_anti")
    full = StructType.fromDDL(f"{schema}, _error string, _row boolean, block_x long, block_y long")
    columns = full.names
    done = materialize(open_.groupBy(*BLOCK).applyInPandas(lambda key, frame: run(key, frame).reindex(columns=columns).astype({"_error": object}), full), "worked-blocks")
    good = done.where("_error IS NULL")
    good.where("_row").select(*names, *BLOCK).hint("rebalance", *BLOCK).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BLOCK).parquet(f"{path}/rows")
    done.where("_error IS NOT NULL").select(*BLOCK, F.col("_error").alias("error")).write.mode("append").parquet(f"{path}/_errors")
    good.select(*BLOCK).distinct().write.mode("append").parquet(f"{path}/_blocks")
    discard(done)
    out = spark.read.schema(f"{schema}, block_x long, block_y long").parquet(f"{path}/rows")
    return out.join(wanted.select(*BLOCK).distinct(), BLOCK, "left_semi")


def failed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block_x, block_y, tries, error): blocks under path that failed and have no result yet, with the first of their errors by name."""
    errors = spark.read.schema("block_x long, block_y long, error string").parquet(f"{path}/_errors")
    return errors.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("tries"), F.min("error").alias("error")).join(done_blocks(spark, path), BLOCK, "left_anti")


def versioned(wanted: DataFrame, key: str, version: int, work: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Rows of wanted keys from the table under path at a version: work is given the keys that it lacks, and returns their rows.

    Once the rows of a version are written, those of lower ones are out of date and go. A key without rows is asked for again.
    """
    spark = wanted.sparkSession
    wanted, own = wanted.select(key).distinct(), f"{path}/version={version}"
    try:
        known = spark.read.parquet(own)
        open_ = wanted.join(known.select(key).distinct(), key, "left_anti")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        open_ = wanted
    work(open_).write.mode("append").parquet(own)
    for old in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"/version=(\d+)/", 1).cast("int").alias("v")).where(F.col("v") < version).distinct().collect():  # a row a version
        delete(spark, f"{path}/version={old['v']}")
    return spark.read.parquet(own).join(wanted, key, "left_semi")


def thin(line: Column, places: int = 5) -> Column:
    """Every second vertex and the last, coordinates to so many places and heights to one; short lines stay whole."""
    kept = F.when(F.size(line) > 3, F.filter(line, lambda p, i: (i % 2 == 0) | (i == F.size(line) - 1))).otherwise(line)
    return rounded(kept, places)


def rounded(line: Column, places: int = 5) -> Column:
    return F.transform(line, lambda p: F.struct(F.round(p["lon"], places).alias("lon"), F.round(p["lat"], places).alias("lat"), F.round(p["z"], 1).alias("z")))


def save_geometry(lines: DataFrame, path: str) -> None:
    """lines (key, block, kind, line) as shards by block; legs are thinned, runs are not."""
    out = lines.withColumn("line", F.when(F.col("kind") == "run", rounded(F.col("line"))).otherwise(thin(F.col("line"))))
    out.hint("rebalance", "block").write.mode("overwrite").partitionBy("block").parquet(path)


def with_geometry(rows: DataFrame, path: str) -> DataFrame:
    """rows with the line of their key; without one, an empty line."""
    lines = rows.sparkSession.read.parquet(path).select("key", "line")
    return rows.join(lines, "key", "left").withColumn("line", F.coalesce("line", F.array().cast(lines.schema["line"].dataType)))


def summit_shards(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """(summit, lines) with a map from each key that the summit needs to its line; keys without a line are left out."""
    own = keys.select("summit", "key").distinct().join(lines.select("key", "line"), "key")
    return own.groupBy("summit").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "line")))).alias("lines"))


def gpx(points: DataFrame) -> DataFrame:
    """(path, xml): tracks Up and Down of points (path, track, seq, lon, lat, z), and the way points at their ends."""
    at = lambda tag: F.format_string(f'<{tag} lat="%.5f" lon="%.5f">', "lat", "lon")
    point = F.concat(at("trkpt"), F.when(F.col("z").isNotNull(), F.format_string("<ele>%.1f</ele>", "z")).otherwise(""), F.lit("</trkpt>"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda s: s["x"]), "")
    tracks = points.withColumn("x", point).groupBy("path", "track").agg(join("x").alias("body"), F.min_by(F.concat(at("wpt"), F.lit("<name>"), "track", F.lit("</name></wpt>")), "seq").alias("mark"))
    tracks = tracks.withColumn("body", F.concat(F.lit("<trk><name>"), "track", F.lit("</name><trkseg>"), "body", F.lit("</trkseg></trk>")))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("track") != "Up").alias("down"), "track", F.col(c).alias("x")))), lambda s: s["x"]), "")
    head, tail = '<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1">', "</gpx>"
    return tracks.groupBy("path").agg(F.concat(F.lit(head), ordered("mark"), ordered("body"), F.lit(tail)).alias("xml"))


def geojson(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows as GeoJSON features: their other columns are properties, null ones left out."""
    flat = F.transform(F.col(line), lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("LineString").alias("type"), flat.alias("coordinates"))
    properties = F.struct(*[c for c in rows.columns if c != line])
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def saved_plans(old: DataFrame, new: DataFrame, most: int = 50) -> DataFrame:
    """Plans (name, saved, doc): the latest of each name, newest first, at most most of them."""
    own = Window.partitionBy("name").orderBy(F.desc("saved"))
    latest = old.unionByName(new).withColumn("_i", F.row_number().over(own)).where("_i = 1").drop("_i")
    return latest.orderBy(F.desc("saved"), "name").limit(most)
