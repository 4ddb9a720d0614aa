"""Joins whose left side may have a key that holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the left side's rows on: fewer than 1 / SHARE keys can be.
SHARE = 1 / 1000
#: Keys with fewer rows than this are never hot.
FLOOR = 200


def split_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int, how: str = "inner", sort: bool = False) -> DataFrame:
    """left joined with right, which has one row a key and in column rows the number of left rows of that key.

    Hot keys by these numbers, fewer than 1 / SHARE of them whatever the size of the data, are broadcast; the
    others are joined by key, and none of them has more than SHARE of the rows. how is inner or left. Null keys
    match nothing. Both sides are read twice: they should be written tables, or cheap. Column rows goes. sort says that
    right is large however small its file is, so that the other keys are never broadcast.
    """
    limit = max(total * SHARE, FLOOR)
    hot = F.broadcast(right.where(F.col(rows) > limit).drop(rows))
    cold = right.where(F.col(rows) <= limit).drop(rows)
    cold = cold.hint("merge") if sort else cold
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(cold, on, how))
