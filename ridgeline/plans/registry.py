"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str | None], Callable[[Query], Query]]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(text: str | None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


#: The derived tables as common table expressions, for DuckDB.
SIDE = "n AS (SELECT floor(sqrt(count(*)))::BIGINT AS n FROM orders)"


def cells_sql(p: float = 1.2, q: float = 1.5, gaps: bool = False) -> str:
    z = f"900e0 + {p}e0*abs((2*r+3*c)%180-90) + {q}e0*abs((r-2*c+1400)%140-70) + floor(o_totalprice)%2"
    z = f"CASE WHEN o_orderpriority <> '1-URGENT' THEN {z} END" if gaps else z
    return f"{SIDE}, cell AS MATERIALIZED (SELECT r, c, ({z})::DOUBLE AS z FROM (SELECT (o_orderkey // n)::INT AS r, (o_orderkey % n)::INT AS c, o_totalprice, o_orderpriority FROM orders, n WHERE o_orderkey < n*n))"


#: Wide flats between ridges, with steep cones on them.
VALLEY = f"{SIDE}, cell AS MATERIALIZED (SELECT r, c, (900e0 + 2.2e0*greatest(0, abs((r+2*c)%192-96)-64) + 9e0*greatest(0, 5-greatest(abs(r%48-24), abs(c%48-24))) + floor(o_totalprice)%2)::DOUBLE AS z FROM (SELECT (o_orderkey // n)::INT AS r, (o_orderkey % n)::INT AS c, o_totalprice FROM orders, n WHERE o_orderkey < n*n))"


DERIVED = """
g AS (SELECT r, c, z,
  CASE WHEN lag(1) OVER v IS NULL AND lead(1) OVER v IS NULL THEN NULL WHEN lag(1) OVER v IS NULL THEN (lead(z) OVER v - z)/10e0 WHEN lead(1) OVER v IS NULL THEN (z - lag(z) OVER v)/10e0 ELSE (lead(z) OVER v - lag(z) OVER v)/20e0 END AS s,
  CASE WHEN lag(1) OVER h IS NULL AND lead(1) OVER h IS NULL THEN NULL WHEN lag(1) OVER h IS NULL THEN (lead(z) OVER h - z)/10e0 WHEN lead(1) OVER h IS NULL THEN (z - lag(z) OVER h)/10e0 ELSE (lead(z) OVER h - lag(z) OVER h)/20e0 END AS e
  FROM cell WINDOW v AS (PARTITION BY c ORDER BY r), h AS (PARTITION BY r ORDER BY c)),
d AS MATERIALIZED (SELECT r, c, z, slope, CASE WHEN slope >= 0.001 THEN ((degrees(atan2(-e, s)) % 360) + 360) % 360 END AS aspect
  FROM (SELECT *, CASE WHEN z IS NOT NULL THEN degrees(atan(sqrt(e*e+s*s))) END AS slope FROM g))"""
PARKING = "parking AS MATERIALIZED (SELECT s_suppkey AS parking, ((s_suppkey*7919)%(10*n))::DOUBLE AS x, ((s_suppkey*104729+37)%(10*n))::DOUBLE AS y, CASE WHEN s_suppkey%7=0 THEN 'private' END AS access, CASE WHEN s_suppkey%11<>0 THEN (s_suppkey*37)%180 END::INT AS drive_min FROM supplier, n)"
ROAD = "road AS MATERIALIZED (SELECT c_custkey AS road, ((c_custkey*3571)%(10*n))::DOUBLE AS x, ((c_custkey*6007+11)%(10*n))::DOUBLE AS y, c_mktsegment AS class, c_acctbal < 0 AS closed FROM customer, n WHERE c_custkey%10=0)"
EDGE = "edge AS MATERIALIZED (SELECT 'p'||l_suppkey AS src, 's'||l_partkey AS dst, 'skin' AS kind, l_quantity/10 AS hours FROM lineitem UNION ALL SELECT 'r'||(o_orderkey%500), 'p'||(o_custkey%100), 'walk', o_totalprice/1e5 FROM orders)"
PATH = "path AS MATERIALIZED (SELECT user_id AS path, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS seq, value AS z, ts, event_type FROM events)"
