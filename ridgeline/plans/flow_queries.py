"""Queries of fall lines with bands, and of the ski faces and runs along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators import flow, graph, paths, spatial, sun, terrain
from ridgeline.plans import sun_queries
from ridgeline.plans.registry import DERIVED, cells_sql, registry
from ridgeline.plans.terrain_queries import DOWNHILL, SMOOTH
from ridgeline.sources.fixtures import cells, roads, side

QUERIES, ORACLE_SQL, query = registry()
LOWER, UPPER = 24.0, 33.0

_OK = f"ok AS MATERIALIZED (SELECT sm.r, sm.c, d.slope, d.aspect, (smooth > 3 AND smooth < {UPPER} AND d.slope IS NOT NULL) AS go, (smooth > {LOWER} AND smooth < {UPPER} AND d.slope IS NOT NULL) AS counted FROM sm JOIN d ON d.r = sm.r AND d.c = sm.c)"
_STEPS = f"""{_OK}, st AS MATERIALIZED (SELECT dh.r, dh.c, dh.r + dr AS nr, dh.c + dc AS nc, sqrt(drop_*drop_ + len*len) AS l3, drop_ AS drop, CASE WHEN a.counted THEN sqrt(drop_*drop_ + len*len) ELSE 0e0 END AS bl, CASE WHEN a.counted THEN drop_ ELSE 0e0 END AS bd
FROM (SELECT *, gain*len AS drop_ FROM (SELECT *, CASE WHEN dr<>0 AND dc<>0 THEN 10e0*sqrt(2e0) ELSE 10e0 END AS len FROM dh)) dh JOIN ok a ON a.r = dh.r AND a.c = dh.c AND a.go JOIN ok b ON b.r = dh.r + dr AND b.c = dh.c + dc AND b.go)"""
_SUMS = """w(r, c, at_r, at_c, tl, td, bl, bd) AS (SELECT r, c, nr, nc, l3, drop, bl, bd FROM st UNION ALL SELECT w.r, w.c, st.nr, st.nc, w.tl + st.l3, w.td + st.drop, w.bl + st.bl, w.bd + st.bd FROM w JOIN st ON st.r = w.at_r AND st.c = w.at_c),
f AS MATERIALIZED (SELECT r, c, max(tl) AS tl, max(td) AS td, max(bl) AS bl, max(bd) AS bd FROM w GROUP BY r, c)"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with slope, aspect, ok (a run goes on) and counted (in the band), by the mean slope of 3 x 3 cells."""
    d = terrain.box_mean(terrain.derivatives(cells(spark, sf_dir)), "slope", 90.0)
    return d.select("r", "c", "z", "slope", "aspect", *flow.face_flags(F.col("smooth"), F.col("slope"), LOWER, UPPER))


@query(f"WITH RECURSIVE {cells_sql()}, {DERIVED}, {SMOOTH}, {DOWNHILL}, {_STEPS}, {_SUMS} SELECT r, c, round(tl, 3) AS total_len, round(td, 3) AS total_drop, round(bl, 3) AS band_len, round(bd, 3) AS band_drop FROM f")
def fall_line_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and drop of each cell's fall line while it may go on, in all and within the band."""
    out = flow.fall_line(flags(spark, sf_dir))
    return out.select("r", "c", *[F.round(c, 3).alias(c) for c in ("total_len", "total_drop", "band_len", "band_drop")])


@query(f"""WITH RECURSIVE {cells_sql()}, {DERIVED}, {SMOOTH}, {DOWNHILL}, {_STEPS}, {_SUMS},
top AS MATERIALIZED (SELECT r, c, bl, row_number() OVER (PARTITION BY r//16, c//16 ORDER BY bl DESC, r, c) AS i FROM f WHERE bl >= 40), s AS MATERIALIZED (SELECT r, c, bl FROM top WHERE i = 1),
tr(r0, c0, seq, r, c) AS (SELECT r, c, 0, r, c FROM s UNION ALL SELECT r0, c0, seq + 1, st.nr, st.nc FROM tr JOIN st ON st.r = tr.r AND st.c = tr.c WHERE seq < 600),
m AS (SELECT tr.*, ok.counted, ok.slope, ok.aspect, max(CASE WHEN counted THEN seq END) OVER (PARTITION BY r0, c0) AS last FROM tr JOIN ok ON ok.r = tr.r AND ok.c = tr.c),
run AS (SELECT r0, c0, count(*) AS cells, avg(slope) AS mean_slope, avg(counted::INT::DOUBLE) AS share, max(slope) AS max_slope, avg((slope >= 30)::INT::DOUBLE) AS steep, ((degrees(atan2(avg(sin(radians(aspect))), avg(cos(radians(aspect))))) % 360) + 360) % 360 AS aspect FROM m WHERE seq <= last GROUP BY r0, c0)
SELECT r0 AS top_r, c0 AS top_c, cells, round(mean_slope, 4) AS mean_slope, round(share, 4) AS band_share, round(max_slope, 4) AS max_slope, round(steep, 4) AS steep_share, round(aspect, 2) AS aspect FROM run WHERE mean_slope BETWEEN {LOWER - 1} AND {UPPER} AND share >= 0.6""")
def traced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fall line of each block of 16 x 16 cells, traced to its last cell in the band, if it is steep and even enough."""
    d = graph.materialize(flags(spark, sf_dir), "flags")
    g = flow.described(flow.traced_best(d, 40.0, 16), LOWER, UPPER)
    return g.select("top_r", "top_c", "cells", *[F.round(c, 4).alias(c) for c in ("mean_slope", "band_share", "max_slope", "steep_share")], F.round("aspect", 2).alias("aspect"))


@query(None)
def ski_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces in order of their approach: components of tops, the best line of each, its ground and the nearest road.

    No SQL: labels, traces and nearest roads together; tested by brute force on a small raster.
    """
    n = side(spark, sf_dir)
    d = graph.materialize(flags(spark, sf_dir), "flags")
    faces = flow.faces(d, 40.0, LOWER, UPPER, 3)
    at = faces.withColumns({"x": F.col("bottom_c") * 10.0 + 5, "y": 10.0 * n - F.col("bottom_r") * 10 - 5})
    near = spatial.nearest(at.select("face", "x", "y"), roads(spark, sf_dir), "face", "road", 80.0)
    out = faces.join(near.select("face", F.col("nearest_road").alias("road"), (F.col("distance") / 1000 / 4).alias("hours")), "face")
    order = Window.orderBy(F.col("hours").isNull(), "hours", F.desc("band_len"), "face")
    first = out.orderBy(F.col("hours").isNull(), "hours", F.desc("band_len"), "face").limit(60)
    return first.select("face", "top_cells", "cells", F.round("band_len", 2).alias("band_len"), F.round("mean_slope", 4).alias("mean_slope"), "road", F.round("hours", 4).alias("hours"), F.row_number().over(order).alias("rank"))  # sixty rows


@query(None)
def face_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with the profile of their run, its forest, and the hours of sun at its middle below the horizons there.

    No SQL: traces, horizons and sun together; each is beside SQL in a query of its own, the profile beside brute force.
    """
    n = side(spark, sf_dir)
    d = flags(spark, sf_dir).withColumn("forest", F.greatest(F.lit(0), (F.col("r") * 3 + F.col("c")) % 7 - 3))
    d = graph.materialize(d, "flags")
    faces = graph.materialize(flow.faces(d, 40.0, LOWER, UPPER, 3), "faces")
    runs = flow.traced(d, faces.select(F.col("top_r").alias("r"), F.col("top_c").alias("c")))
    each = graph.materialize(faces.join(flow.profiled(runs), ["top_r", "top_c"]), "face-profiles")
    at = each.select("face", F.col("mean_slope").alias("slope"), "aspect", (F.col("middle.c") * 10.0 + 5).alias("x"), (10.0 * n - F.col("middle.r") * 10 - 5).alias("y"), F.col("middle.z").alias("z"))
    rays = sun.horizons(at, d, "face", sun_queries.BEARINGS, sun_queries.NEAR, 0.0, 10.0 * n)
    hours = sun.sun_hours(sun_queries.states(spark, at, rays, "face"), "face")
    out = each.join(hours, "face", "left")
    rounded = [F.round(c, k).alias(c) for c, k in (("band_len", 2), ("mean_slope", 4), ("drop", 2), ("length_m", 2), ("hours", 4))]
    return out.select("face", "top_cells", "cells", "forest_share", "forest_type", paths.terrain_class(F.col("forest_share")).alias("terrain"), *rounded).withColumnRenamed("hours", "sun_hours")
