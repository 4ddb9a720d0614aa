"""Spark results beside DuckDB's, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def _plain(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    if hasattr(x, "is_finite"):  # decimal
        return round(float(x), 4)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[c]) for c in names) for r in df.collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in out.fetchall())


def difference(df: DataFrame, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    (a, ours), (b, theirs) = spark_rows(df), duck_rows(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    only, other = ours - theirs, theirs - ours
    return f"{sum(only.values())} and {sum(other.values())} rows differ: {list(only)[:2]} and {list(other)[:2]}" if only or other else ""
