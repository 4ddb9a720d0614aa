"""The prefix trie of conversations by partition refinement.

All conversations begin as one class, the root. A pass takes the next turns of the active classes' members and
splits each class turn by turn: members that go on with the same turns stay together. A class of one member is
retired; the rest of that conversation is a unary chain, which is emitted from its length alone. Passes
take 4, 8, 16 ... turns, so that their number grows with the logarithm of the longest shared prefix, and a
member is split over at most about twice the turns it shares. Members carry their classes' smallest members, so
that folding back is one sum by class: a member saves the words of the turns that a smaller member owns, and
counts as a child or a leaf where it owns the node.

Turns are compared by a 128-bit digest of role and text, classes by a digest over those of their turns.

Defined results: rows without conv_id belong to no conversation; a null role or text is empty; turns that tie
follow in the order of role, text (64 characters of each) and digest, and equal rows are turns of their own; an
empty table has no root and gives an empty result; further columns don't pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.ranks import ranked
from ridgeline.operators.skew import split_join
from ridgeline.sources.scratch import discard, materialize

#: Turns of the first pass, and of any pass at most: a row holds the digests of that many turns.
FIRST, MOST = 4, 1024
#: Ids of a list that are joined before lists are hashed; nodes of a chain that one row stands for.
CHUNK = 4096
HEAD = 64
#: As in \\s without the Unicode spaces.
WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, place from 0, digest, words) and convs (conv_id, n_turns)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8")))
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.left(role, F.lit(HEAD)).alias("role"), F.left(text, F.lit(HEAD)).alias("text"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("digest"), F.col("row")]
    placed = ranked(rows, order).select("conv_id", "rank", "digest", "words")
    convs = materialize(placed.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n_turns")), "conversations")
    turns = split_join(placed, convs.select("conv_id", "first", "n_turns"), ["conv_id"], "n_turns", placed.count())
    return turns.select("conv_id", (F.col("rank") - F.col("first")).alias("place"), "digest", "words"), convs.select("conv_id", "n_turns")


def grafted(turns: DataFrame, convs: DataFrame, base: Column, n_head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation's first n_head turns (fewer than most) replaced by those of conversation base.

    Returns turns (conv_id, depth from 1, digest, words) and convs (conv_id, length). Of a base with fewer turns
    all are taken, of one that doesn't exist none.
    """
    turns = materialize(turns, "turns")
    own = convs.withColumns({"base": base, "head": n_head})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    taken = F.least("head", F.coalesce("n_base", F.lit(0)))
    kept = F.greatest(F.col("n_turns") - F.col("head"), F.lit(0))
    own = materialize(own.join(bases, "base", "left").withColumns({"taken": taken, "length": taken + kept}), "grafts")
    rest = split_join(turns, own.select("conv_id", "head", "taken", "n_turns"), ["conv_id"], "n_turns", turns.count())
    rest = rest.where(F.col("place") >= F.col("head")).select("conv_id", (F.col("taken") + F.col("place") - F.col("head") + 1).alias("depth"), "digest", "words")
    heads = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base").join(own.select("conv_id", "base", "head"), "base")
    heads = heads.where(F.col("place") < F.col("head")).select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words")
    return materialize(rest.unionByName(heads), "rebuilt"), own.select("conv_id", "length")


def _split(turns: DataFrame, active: DataFrame, begin: int, width: int) -> DataFrame:
    """The active classes' members by class after each of the next turns: conv_id, length, depth, label, words."""
    block = turns.where((F.col("depth") > begin) & (F.col("depth") <= begin + width))
    paths = block.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("turns")).join(active, "conv_id")
    chain = F.aggregate("turns", F.array("label"), lambda seen, t: F.concat(seen, F.array(F.unhex(F.md5(F.concat(F.element_at(seen, -1), t["digest"]))))))
    steps = F.zip_with("turns", F.slice(chain, 2, width), lambda t, x: F.struct(t["depth"].alias("depth"), x.alias("label"), t["words"].alias("words")))
    return paths.select("conv_id", "length", F.explode(steps).alias("step")).select("conv_id", "length", "step.*")


def shared_classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Members by class that has several, root included: conv_id, length, depth, words, node, n, n_end.

    node: the class's smallest member; n: its members; n_end: those that end there.
    """
    whole = convs.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("length") == 0).alias("n_end")).first()
    at_root = convs.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *(F.lit(whole[c]).cast("long").alias(c) for c in ("node", "n", "n_end")))
    found, begin, width = [at_root], 0, FIRST
    active = convs.where("length > 0").withColumn("label", F.lit(b""))
    while not active.isEmpty():
        members = materialize(_split(turns, active, begin, width), "members")
        classes = members.groupBy("label").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") == F.col("length")).alias("n_end"))
        classes = materialize(classes.where("n > 1").withColumn("rows", F.col("n")), "classes")
        kept = materialize(split_join(members, classes, ["label"], "rows", members.count()), "shared")
        discard(members)
        discard(classes)
        found.append(kept.drop("label"))
        begin, width = begin + width, min(2 * width, MOST)
        active = kept.where((F.col("depth") == begin) & (F.col("length") > begin)).select("conv_id", "length", "label")
    return reduce(DataFrame.unionByName, found)


def _hash_lists(ends: DataFrame) -> DataFrame:
    """node, depth, ends_sha256: of the ascending ids of each list, which a task hashes as they come."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, hashlib.sha256()
        done: list[tuple[int, int, str]] = []
        for frame in frames:
            for node, depth, ids in frame.itertuples(index=False):
                if (node, depth) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (node, depth), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["node", "depth", "ends_sha256"])
            done = []
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["node", "depth", "ends_sha256"])

    part = F.floor(F.col("conv_id") / CHUNK)
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    lists = ends.groupBy("node", "depth", part.alias("part")).agg(ids.alias("ids")).repartition("node", "depth").sortWithinPartitions("node", "depth", "part")
    return lists.select("node", "depth", "ids").mapInPandas(run, "node long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes from turns (conv_id, depth, digest, words) and convs (conv_id, length), both written tables."""
    if convs.isEmpty():
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    shared = shared_classes(turns, convs)
    whole = Window.partitionBy("conv_id")
    along = whole.orderBy("depth")
    rows = shared.withColumns({
        "parent": F.lag("node").over(along),
        "before": F.coalesce(F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "deepest": F.max("depth").over(whole),
        "owned": F.min(F.when(F.col("node") == F.col("conv_id"), F.col("depth"))).over(whole),
    })
    rows = rows.withColumn("owned", F.coalesce("owned", F.col("deepest") + 1))
    last = F.col("depth") == F.col("deepest")
    alone = (F.col("node") == F.col("conv_id")) & (F.col("n_end") == F.col("n"))
    rows = rows.withColumns({
        "saved": F.coalesce(F.sum(F.when(F.col("depth") < F.col("owned"), F.col("words"))).over(whole), F.lit(0)),
        "leaf": F.max(F.when(last, ((F.col("length") > F.col("deepest")) | alone).cast("long"))).over(whole),
    })
    rows = materialize(rows, "members")
    child = (F.col("length") > F.col("depth")) & (F.col("owned") <= F.col("depth") + 1)
    nodes = rows.groupBy("node", "depth").agg(
        F.max("parent").alias("parent_conv_id"), F.max("n").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("saved") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    ends = _hash_lists(rows.where("length = depth").select("node", "depth", "conv_id"))
    empty = F.sha2(F.lit(""), 256)
    nodes = nodes.join(ends, ["node", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).withColumnRenamed("node", "conv_id")
    # the unary chains
    chains = rows.where((F.col("depth") == F.col("deepest")) & (F.col("length") > F.col("depth"))).select("conv_id", F.col("node").alias("above"), "deepest", "length")
    chains = chains.withColumn("start", F.explode(F.sequence(F.col("deepest") + 1, F.col("length"), F.lit(CHUNK).cast("long")))).repartition("conv_id", "start")
    chains = chains.withColumn("depth", F.explode(F.sequence("start", F.least(F.col("start") + CHUNK - 1, F.col("length")))))
    last = F.col("depth") == F.col("length")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("deepest") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty).alias("ends_sha256"),
    )
    return nodes.unionByName(chains)
