"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from ridgeline.plans import access_queries, assembly_queries, flow_queries, graph_queries, leg_queries, path_queries, raster_queries, scalar_queries, scan_queries, sink_queries, source_queries, sun_queries, terrain_queries, tour_queries

_PARTS = (terrain_queries, access_queries, path_queries, graph_queries, leg_queries, raster_queries, scalar_queries, scan_queries, source_queries, assembly_queries, sun_queries, flow_queries, sink_queries, tour_queries)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
