"""Spelling variants: words at one edit, found by merging errata tries.

The words form a trie. At each node the child with most words below is heavy, the others are light (a word that
ends there counts as light too); a word has at most log2 of the number of words light edges on its way down. Only
light subtrees are merged, into the heavy one and into each other, with one character replaced, skipped or put
in at the node: the merged word of a light subtree coincides with a terminal of the trie, or with another merged one, exactly
if the two are one edit apart and part at that node. So each pair is found once:

* replaced, light beside heavy: the light word with the heavy character in place of its own is a word;
* replaced, both light: the words agree with that character left open (as many words as letters at most);
* skipped: a light word without its character is a word that parts from it there;
* put in: a light word with the heavy character before its own is a word.

Nodes and merged words are joined as strings; nodes near the root, which many words pass, are joined where the
words lie.

Defined results: null texts have no words, a null id counts as the empty string; an empty table gives an
empty result; ties between forms go to the smallest word in code-point order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.skew import split_join
from ridgeline.sources.scratch import discard, materialize

#: Code points of a word at least, occurrences at least, and how many times as frequent a form is at least.
SHORTEST, LEAST, RATIO = 7, 2, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a character left open; no letter.
OPEN = "*"


def typed_words(docs: DataFrame, misses: int = 31) -> DataFrame:
    """word: of each run of at least SHORTEST letters the lower-cased run, of every misses-th (document, run) without one character.

    The hash of document and run says which, and which character. Shorter runs can't become words.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8")))
    at = F.expr("int(h % char_length(run))")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % misses == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= SHORTEST)


def vocabulary(words: DataFrame, least: int = LEAST) -> DataFrame:
    """word, n: the words with at least that many occurrences."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _steps(words: DataFrame, *more: str) -> DataFrame:
    """A row for each node on a word's way: at, node (the first at characters), char (the next, empty at the end)."""
    at = words.select("word", *more, F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("at"))
    return at.withColumns({"node": F.substring("word", F.lit(1), F.col("at")), "char": F.substring("word", F.col("at") + 1, F.lit(1))})


def light_steps(words: DataFrame) -> DataFrame:
    """word, n, at, char, heavy: where a word leaves its heavy path, and the heavy character there."""
    children = _steps(words).groupBy("node", "char").agg(F.count(F.lit(1)).alias("size"))
    heavy = F.max(F.when(F.col("char") != "", F.struct("size", "char")))["char"]
    nodes = children.groupBy("node").agg(F.count(F.lit(1)).alias("children"), F.sum("size").alias("rows"), heavy.alias("heavy"))
    nodes = materialize(nodes.where("children > 1").drop("children"), "nodes")
    steps = split_join(_steps(words, "n"), nodes, ["node"], "rows", nodes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    out = materialize(steps.where("char != heavy").select("word", "n", "at", "char", "heavy"), "light")
    discard(nodes)
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words at one edit, each in both orders; words (word, n) is a written table, its words distinct."""
    light = light_steps(words)
    head, tail = F.substring("word", F.lit(1), F.col("at")), lambda k: F.substring("word", F.col("at") + k, F.char_length("word"))
    inner = F.col("char") != ""
    merged = F.array(
        F.when(inner, F.concat(head, F.col("heavy"), tail(2))),
        F.when(inner & (F.substring("word", F.col("at") + 2, F.lit(1)) != F.col("char")), F.concat(head, tail(2))),
        F.concat(head, F.col("heavy"), tail(1)),
    )
    merged = light.select("word", "n", F.explode(F.array_compact(merged)).alias("near"))
    found = merged.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # both light: the words of a place and its surroundings differ in that character, so they are no more than there are letters
    left_open = light.where(inner).groupBy(F.concat(head, F.lit(OPEN), tail(2)).alias("key")).agg(F.collect_list(F.struct("word", "n")).alias("a")).where(F.size("a") > 1)
    among = left_open.withColumn("b", F.explode("a")).withColumn("c", F.explode("a")).where("b.word < c.word").select("b.word", "b.n", F.col("c.word").alias("near"), F.col("c.n").alias("near_n"))
    pairs = materialize(found.select("word", "n", "near", "near_n").unionByName(among), "pairs")
    discard(light)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of each word's forms, from word, form (no cycles): the known way doubles each pass."""
    known = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = known.join(further, "root", "left")
        if step.where("next IS NOT NULL").isEmpty():
            return known
        before, known = known, materialize(step.select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(before)


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words (word, n): its near word of largest n if that is ratio times its own n, and the last such form."""
    words = materialize(words, "words")
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    known = materialize(known, "forms")
    out = known.join(roots(known.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
