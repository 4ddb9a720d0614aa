"""Removal of multi-line chunks that the corpus repeats.

A document's lines are hashed; a chunk ends after a line when the hash over the last two line hashes
falls under a threshold, so that the boundaries depend on nearby lines only and survive insertions
elsewhere. A chunk of two lines or more that occurs more than once stays at its first place (smallest
document id, then place) and goes everywhere else, once its bytes were compared with those of the kept one.

Defined results: null text counts as empty and has one empty line; rows with the same id and text are one
document and keep the same chunks; null ids sort last. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.scratch import materialize

#: A boundary follows a line when the first hex digit over two line hashes is below this: 1 line in 4.
CUT_BELOW = "4"
LAST = (1 << 63) - 1


def _tail(x: Column) -> Column:
    return F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))


def _head(x: Column) -> Column:
    return F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))


def _ends_here(before: Column, here: Column) -> Column:
    return F.substring(F.md5(F.concat(before, here).cast("binary")), 1, 1) < CUT_BELOW


def _prepared(docs: DataFrame) -> DataFrame:
    """docs (with _text) with _lines and _chunks: its chunks as first line * 2^32 + number of lines.

    Arrays are walked side by side, never indexed inside a lambda: every one is computed once.
    """
    docs = docs.withColumn("_lines", F.split(F.coalesce("_text", F.lit("")), "\n", -1))
    docs = docs.withColumn("_hashes", F.transform("_lines", lambda x: F.md5(x.cast("binary"))))
    flags = F.zip_with(_head(F.col("_hashes")), _tail(F.col("_hashes")), _ends_here)
    inner = F.filter(F.transform(_head(flags), lambda f, i: F.when(f, i + 2)), lambda i: i.isNotNull())
    docs = docs.withColumn("_cuts", F.concat(F.array(F.lit(0)), inner, F.array(F.size("_lines"))))
    code = F.zip_with(_head(F.col("_cuts")), _tail(F.col("_cuts")), lambda a, b: F.shiftleft(a.cast("long") + 1, 32) + (b - a).cast("long"))
    return docs.select("*", code.alias("_chunks")).drop("_cuts", "_hashes")


def _body(code: Column) -> Column:
    return F.array_join(F.slice("_lines", F.shiftright(code, 32).cast("int"), code.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the remaining text in place of the old one, and n_lines, n_removed_lines, n_removed_chunks."""
    added = ["n_lines", "n_removed_lines", "n_removed_chunks"]
    kept = [c for c in docs.columns if c not in added]
    keyed = docs.select(
        F.struct(*[c for c in kept if c != text_col]).alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"),
        F.col(text_col).alias("_text"),
    )
    at = F.struct("_id", "_hash", "_code").alias("_at")
    # explode_outer: a plain explode has Catalyst filter on the array's size first, which computes it again
    chunks = (
        _prepared(keyed.drop("_row"))
        .select("_id", "_hash", "_lines", F.explode_outer("_chunks").alias("_code"))
        .where(F.col("_code").bitwiseAND(F.lit(0xFFFFFFFF)) >= 2)
        .select(_body(F.col("_code")).alias("_body"), at)
        .withColumn("_key", F.xxhash64("_body"))
    )
    repeated = chunks.groupBy("_key").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).where(F.col("_first") != F.col("_last")).select("_key", "_first")
    # written before each join: beside an aggregate, Spark cannot split the rows of a hot chunk
    repeated = materialize(repeated, "repeated-keys")
    found = materialize(chunks.join(repeated.hint("merge"), "_key"), "repeated-chunks")
    first = found.where(F.col("_at") == F.col("_first")).groupBy("_key").agg(F.first("_body").alias("_kept"))
    first = materialize(first, "kept-chunks")
    gone = (
        found.where(F.col("_at") != F.col("_first"))
        .join(first, "_key")
        .where(F.col("_body") == F.col("_kept"))
        .groupBy("_at._id", "_at._hash")
        .agg(F.collect_set("_at._code").alias("_gone"))
    )
    none = F.array().cast("array<bigint>")
    # texts alone cross the shuffle; lines and chunks are made again behind it
    out = _prepared(keyed.join(gone.hint("merge"), ["_id", "_hash"], "left").withColumn("_gone", F.coalesce("_gone", none)))
    lines_of = F.aggregate("_gone", F.lit(0).cast("long"), lambda a, c: a + c.bitwiseAND(F.lit(0xFFFFFFFF)))
    text = F.array_join(F.transform(F.array_except("_chunks", "_gone"), _body), "\n")
    return out.select(
        *[(F.when(F.size("_gone") == 0, F.col("_text")).otherwise(text).alias(c) if c == text_col else F.col("_row").getField(c).alias(c)) for c in kept],
        F.size("_lines").cast("long").alias("n_lines"),
        lines_of.alias("n_removed_lines"),
        F.size("_gone").cast("long").alias("n_removed_chunks"),
    )
