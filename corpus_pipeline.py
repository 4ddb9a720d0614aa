"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last
returns packed pieces. Stages handle nulls in every column, empty and very long texts, repeated rows and
empty tables as their operators state; columns beyond those of documents don't pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, line_dedup, near_dedup, packing
from ridgeline.llm.queries import SEQUENCE, graded_documents, tokenizer_path
from ridgeline.sources.scratch import materialize
from ridgeline.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The classifier is trained and line boundaries are hashes: DuckDB has neither, so the tests compare with brute force.
ORACLE_SQL = None


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than not."""
    return graded_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks that are kept elsewhere; documents of which nothing is left go."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("n_removed_lines") > 0
    out = out.where(~changed | (F.col("n_removed_lines") < F.col("n_lines")))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id (none last); of rows that share id and text, one.

    Rows that share an id alone are different documents: each id and text has its own node, by a hash.
    """
    docs = docs.select(*COLUMNS).withColumn("_text", F.coalesce("text", F.lit("")))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\0"), "_text")
    docs = docs.withColumn("_node", near_dedup.node_of(F.lit(None).cast("long"), named))
    found = materialize(near_dedup.components(docs.select(F.col("_node").alias("id"), F.col("_text").alias("text"))), "groups")
    ids = docs.select("_node", F.col("doc_id").isNull().alias("nameless"), "doc_id").distinct()
    labels = found.select(F.col("id").alias("_node"), "component_id").distinct()
    first = ids.join(labels, "_node").groupBy("component_id").agg(F.min(F.struct("nameless", "doc_id", "_node")).alias("_first"))
    out = docs.join(first.select("_first._node"), "_node", "left_semi")
    if not found.groupBy("id").count().where("count > 1").isEmpty():
        out = out.groupBy("_node").agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")
    return out.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    bad = materialize(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_key"))
    return docs.join(bad, same, "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place in it."""
    return packing.pack(packing.cut_pieces(docs, tokenizer_path(), SEQUENCE).drop("ids"), SEQUENCE)


STAGES = [
    ("quality_classifier", select_quality),
    ("line_dedup", remove_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass every stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
