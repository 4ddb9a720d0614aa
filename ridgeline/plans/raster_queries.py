"""Queries over raster files, a second height source, routes over terrain and work by block."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators import blocks, routes, terrain, warp
from ridgeline.plans.leg_queries import NORTH, WEST
from ridgeline.plans.registry import DERIVED, SIDE, cells_sql, registry
from ridgeline.plans.scalar_queries import inverse_sql
from ridgeline.plans.terrain_queries import SMOOTH
from ridgeline.sources import rasters, sinks
from ridgeline.sources.fixtures import cells, side
from ridgeline.sources.fixtures import paths as points
from ridgeline.sources.scratch import shared_folder
from ridgeline.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
GAPS = cells_sql(gaps=True)
TILE, BLOCK, MARGIN = 16, 48, 15


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _tiles(df: DataFrame) -> DataFrame:
    return df.withColumns({"ti": F.floor(F.col("r") / TILE).cast("int"), "tj": F.floor(F.col("c") / TILE).cast("int")})


@query(f"""WITH {GAPS}, px AS (SELECT r, c, z, r//{TILE} AS ti, c//{TILE} AS tj FROM cell), t AS (SELECT ti, tj, count(*) AS cells, count(z) AS known, max(z) AS top, min(r) AS first_r, max(c) AS last_c FROM px WHERE (ti + 2*tj) % 5 <> 3 AND ti < 1000 GROUP BY ALL)
SELECT ti::INT AS ti, tj::INT AS tj, bad AS unreadable, CASE WHEN bad THEN 0 ELSE cells END AS cells, CASE WHEN bad THEN 0 ELSE known END AS known, CASE WHEN NOT bad THEN round(top, 4) END AS top, CASE WHEN NOT bad THEN first_r END::INT AS first_r, CASE WHEN NOT bad THEN last_c END::INT AS last_c FROM (SELECT *, (3*ti + tj) % 7 = 2 OR (ti + 3*tj) % 11 = 5 AS bad FROM t)""")
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles written as files and read back: some didn't arrive, some lack their last row, some lie elsewhere than their name says."""
    z = _tiles(cells(spark, sf_dir, gaps=True)).where((F.col("ti") + 2 * F.col("tj")) % 5 != 3)
    n, path = side(spark, sf_dir), _folder(spark, "grids")
    last_row = F.least(F.lit(n), (F.col("ti") + 1) * TILE) - 1
    short = ((3 * F.col("ti") + F.col("tj")) % 7 == 2) & (F.col("r") == last_row) & (last_row > F.col("ti") * TILE)
    moved = F.when((F.col("ti") + 3 * F.col("tj")) % 11 == 5, F.col("c") + 1).otherwise(F.col("c"))
    # a tile of a single row is moved instead of shortened
    moved = F.when(((3 * F.col("ti") + F.col("tj")) % 7 == 2) & (last_row == F.col("ti") * TILE), F.col("c") + 1).otherwise(moved)
    rasters.write_grids(z.where(~short).withColumn("c", moved), path, WEST, NORTH)
    found = rasters.read_grids(spark, path, TILE, WEST, NORTH, (n, n), only=F.col("ti") < 1000)
    each = found.groupBy("ti", "tj").agg(F.count("r").alias("cells"), F.count("z").alias("known"), F.round(F.max("z"), 4).alias("top"), F.min("r").alias("first_r"), F.max("c").alias("last_c"))
    return each.select("ti", "tj", (F.col("cells") == 0).alias("unreadable"), "cells", "known", "top", "first_r", "last_c")


#: The second source's corner and cell size in degrees; its first tile ends at column 24, its second begins at 20.
LON0, LAT0, DLON, DLAT, SEAM, OVERLAP = 9.06, 63.006, 0.0006, 0.0003, 24, 20


@query(f"""WITH {GAPS}, t AS (SELECT r, c, {WEST!r} + c*10 + 5 AS e, {NORTH!r} - r*10 - 5 AS n_ FROM cell WHERE z IS NULL), l AS ({inverse_sql('t', 'e', 'n_')}),
g AS (SELECT (o_orderkey // n)::INT AS i, (o_orderkey % n)::INT AS j, CASE WHEN o_orderpriority <> '2-HIGH' THEN 650e0 + (o_orderkey // n * 7 + o_orderkey % n * 3) % 40 END AS z FROM orders, n WHERE o_orderkey < n*n),
src AS (SELECT 0 AS tile, i, j, z FROM g WHERE j < {SEAM} UNION ALL SELECT 1, i, j, z + 5 FROM g WHERE j >= {OVERLAP}),
f AS (SELECT r, c, ({LAT0!r} - lat)/{DLAT!r} - 0.5e0 AS i_, (lon - {LON0!r})/{DLON!r} - 0.5e0 AS j_ FROM l),
k AS (SELECT r, c, floor(i_)::BIGINT + p AS i, floor(j_)::BIGINT + q AS j, (CASE WHEN p = 1 THEN i_ - floor(i_) ELSE 1 - (i_ - floor(i_)) END)*(CASE WHEN q = 1 THEN j_ - floor(j_) ELSE 1 - (j_ - floor(j_)) END) AS w FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(p, q)),
m AS (SELECT r, c, tile, sum(w*z)/sum(w) AS z FROM k JOIN src USING (i, j) WHERE z IS NOT NULL GROUP BY ALL HAVING sum(w) > 1e-6),
b AS (SELECT r, c, min_by(z, tile) AS z FROM m GROUP BY ALL)
SELECT r, c, round(coalesce(cell.z, b.z), 4) AS z, (cell.z IS NULL AND b.z IS NOT NULL) AS coarse FROM cell LEFT JOIN b USING (r, c)""")
def warped_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown cells filled from a source in longitude and latitude that comes in two overlapping tiles with gaps."""
    primary = cells(spark, sf_dir, gaps=True)
    lon, lat = geo.lonlat(WEST + F.col("c") * 10 + 5, NORTH - F.col("r") * 10 - 5)
    n, k = side(spark, sf_dir), F.col("o_orderkey")
    i, j = F.floor(k / F.lit(n)).cast("int"), (k % n).cast("int")
    z = F.when(F.col("o_orderpriority") != "2-HIGH", F.lit(650.0) + (F.col("i") * 7 + F.col("j") * 3) % 40)
    grid = table(spark, sf_dir, "orders").where(k < n * n).select(i.alias("i"), j.alias("j"), "o_orderpriority").select("i", "j", z.alias("z"))
    source = grid.where(F.col("j") < SEAM).withColumn("tile", F.lit(0)).unionByName(grid.where(F.col("j") >= OVERLAP).withColumns({"tile": F.lit(1), "z": F.col("z") + 5}))
    targets = primary.where("z IS NULL").select("r", "c", lon.alias("lon"), lat.alias("lat"))
    out = warp.filled(primary, warp.warped(targets, source, LON0, LAT0, DLON, DLAT))
    return out.select("r", "c", F.round("z", 4).alias("z"), "coarse")


_ROUTE = """v AS (SELECT user_id AS path, seq, ((user_id*37 + seq*23) % (10*n + 60))::DOUBLE AS x, ((user_id*53 + seq*31) % (10*n))::DOUBLE AS y FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), n),
e AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY path ORDER BY seq)),
l AS (SELECT *, sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y)) AS len FROM e), m AS (SELECT *, CASE WHEN nx IS NULL THEN 1 ELSE greatest(1, ceil(len/10)) END::BIGINT AS m FROM l),
s AS (SELECT path, seq, k, CASE WHEN nx IS NULL THEN x ELSE x + (nx-x)*k/m END AS x, CASE WHEN nx IS NULL THEN y ELSE y + (ny-y)*k/m END AS y, len/m AS d FROM (SELECT *, unnest(range(0, m)) AS k FROM m)),
h AS (SELECT s.path, s.seq, s.k, CASE WHEN s.k > 0 THEN s.d ELSE lag(s.d) OVER w END AS step, d.z, d.slope FROM s LEFT JOIN n ON true LEFT JOIN d ON d.r = floor((10*n - s.y)/10) AND d.c = floor(s.x/10) WINDOW w AS (PARTITION BY s.path ORDER BY s.seq, s.k)),
q AS (SELECT *, z - lag(z) OVER (PARTITION BY path ORDER BY seq, k) AS dz FROM h),
gr AS (SELECT path, count(*) AS samples, coalesce(sum(step), 0)/1000 AS km, CASE WHEN count(z) = count(*) THEN coalesce(sum(greatest(dz, 0e0)) FILTER (dz IS NOT NULL), 0) END AS up, CASE WHEN count(z) = count(*) THEN coalesce(sum(greatest(-dz, 0e0)) FILTER (dz IS NOT NULL), 0) END AS down, max(slope) AS top, count(*) FILTER (slope >= 30) AS steep, 100e0*count(z)/count(*) AS cover, count(z) = count(*) AND count(slope) = count(*) AS complete FROM q GROUP BY path)"""


@query(f"""WITH {cells_sql()}, {DERIVED}, {_ROUTE}
SELECT path, samples, round(km, 4) AS distance_km, round(up, 3) AS ascent_m, round(down, 3) AS descent_m, round(top, 4) AS max_slope, steep AS steep_samples, round(cover, 1) AS coverage, complete, round(CASE WHEN complete THEN km/4 + up/400 END, 5) AS hours, (CASE WHEN complete THEN km/4 + up/400 END) BETWEEN 3 AND 4 AS in_target FROM gr""")
def route_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes along true vertices, sampled every ten metres at most on the raster's heights and slopes; some leave the raster."""
    n = side(spark, sf_dir)
    at = lambda a, b, m: ((F.col("path") * a + F.col("seq") * b) % m).cast("double")
    vertices = points(spark, sf_dir).select("path", "seq", at(37, 23, 10 * n + 60).alias("x"), at(53, 31, 10 * n).alias("y"))
    d = terrain.derivatives(cells(spark, sf_dir)).select("r", "c", "z", "slope")
    s = routes.resampled(vertices).withColumns({"r": F.floor((10 * n - F.col("y")) / 10).cast("int"), "c": F.floor(F.col("x") / 10).cast("int")})
    out = routes.metrics(s.join(d, ["r", "c"], "left"))
    rounded = [F.round(c, k).alias(c) for c, k in (("distance_km", 4), ("ascent_m", 3), ("descent_m", 3), ("max_slope", 4), ("coverage", 1), ("hours", 5))]
    return out.select("path", "samples", "steep_samples", "complete", "in_target", *rounded)


@query(f"""WITH {GAPS}, {DERIVED}, {SMOOTH}, x AS (SELECT r, c, max(z) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS h, min(z) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS l FROM cell),
y AS (SELECT r, c, max(h) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS high, min(l) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS low FROM x)
SELECT r, c, round(sm.slope, 4) AS slope, round(sm.aspect, 4) AS aspect, round(smooth, 4) AS smooth, coalesce(sm.z = high AND sm.z - low >= 100, false) AS peak FROM sm JOIN y USING (r, c)""")
def block_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope, aspect, mean slope and peaks done block by block with a margin: the same as over the whole raster."""

    def work(halo: DataFrame, tile: list[str]) -> DataFrame:
        return terrain.box_extremes(terrain.box_mean(terrain.derivatives(halo, tile=tile), "slope", 90.0, tile), 15, 14, tile)

    out = blocks.by_block(cells(spark, sf_dir, gaps=True), BLOCK, MARGIN, work)
    peak = F.coalesce((F.col("z") == F.col("high")) & (F.col("z") - F.col("low") >= 100), F.lit(False))
    return out.select("r", "c", *[F.round(x, 4).alias(x) for x in ("slope", "aspect", "smooth")], peak.alias("peak"))


@query(f"""WITH {GAPS}, b AS (SELECT r//{BLOCK} AS block_x, c//{BLOCK} AS block_y, count(*) AS cells, count(z) AS known, round(sum(z), 3) AS total FROM cell GROUP BY ALL)
SELECT block_x, block_y, cells, known, total, CASE WHEN (block_x + block_y) % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS failed_before FROM b""")
def block_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work by block of which some fails: the others are written, and a second scan works the failed ones alone."""
    rows = cells(spark, sf_dir, gaps=True).withColumns({"block_x": F.floor(F.col("r") / BLOCK), "block_y": F.floor(F.col("c") / BLOCK)})
    path = _folder(spark, "blocks")

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cells": [len(frame)], "known": [int(frame["z"].notna().sum())], "total": [float(frame["z"].sum())]})

    def broken(frame: pd.DataFrame) -> pd.DataFrame:
        if (int(frame["block_x"].iloc[0]) + int(frame["block_y"].iloc[0])) % 3 == 1:
            raise ValueError("no heights")
        return total(frame)

    schema = "cells long, known long, total double"
    sinks.work_blocks(rows, broken, schema, path)
    failed = sinks.materialize(sinks.failed_blocks(spark, path), "failed-blocks")
    out = sinks.work_blocks(rows, total, schema, path).join(failed, sinks.BLOCK, "left")
    return out.select(*sinks.BLOCK, "cells", "known", F.round("total", 3).alias("total"), F.coalesce("tries", F.lit(0)).alias("failed_before"))
