"""Near-duplicate groups by MinHash with tensored banding, each link confirmed on full shingle sets.

A document has two small collections of COLLECTION minhash tuples of ROWS values. A table's key joins one
tuple of the first with one of the second, so 2 * COLLECTION * ROWS minhashes serve COLLECTION**2 tables of
2 * ROWS rows each. Only tuples that two documents share can make a shared key, so single ones go before
the pairs are formed.

Documents with equal sets become one first. In each bucket, documents are then compared with a pivot
and joined into components: the document that has fewest rare shingles (those that at most three
documents have), which in a bucket of copies is the one nearest to all of them. Those
that share a rare shingle are compared at once. In the end a document that is apart from others of its bucket
is compared with each of those that it may link with: of another component, with enough shingles that are
not rare, and with enough equal minhashes. What is not apart is never paired, and no bucket is gathered in a task.

At similarity 0.75 a link is missed with a probability of about 4 in 100,000 by the tables, and of 3 in a
hundred million by the agreement of minhashes.

Defined results: null or blank texts have no shingles and link with nothing; texts without an id take part
behind all ids, and come back with null in place of theirs; rows that share an id are one document with all
their links. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shingles import Powers, shingle_sets
from ridgeline.operators.components import connected_components
from ridgeline.sources.scratch import discard, materialize

SHINGLE = 5
ROWS, COLLECTION = 3, 20
#: Least similarity in percent.
PERCENT = 75
#: Documents that share a bucket have MARKS more minhashes, as 4-bit digests; so many must agree before two sets are compared.
#: At similarity 0.75, 392 agree on average with a standard deviation of 9.6.
MARKS, AGREE = 512, 340
SEED = 11
#: From here on, numbers that stand for texts without an id.
NAMELESS = 1 << 62


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32), rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def minhashes(shingles: np.ndarray, xor: np.ndarray, factor: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(best, ((low[None, at : at + 1024] ^ xor[:, None]) * factor[:, None]).min(axis=1), out=best)
    return best


def tuples(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each tuple, with its place among the tuples."""
    parts = low.reshape(2 * COLLECTION, ROWS).astype(np.uint64)
    keys = np.arange(1, 2 * COLLECTION + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(ROWS):
        keys = (keys ^ parts[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def digest(low: np.ndarray) -> np.ndarray:
    """Four bits of each minhash, sixteen in a long."""
    nibbles = ((low * np.uint32(0x85EBCA6B)) >> np.uint32(28)).astype(np.uint64).reshape(-1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """docs (id, text) as id, n_shingles, set_a, set_b (a fingerprint of the set) and tuples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, (xor, factor) = Powers(), _functions(2 * COLLECTION * ROWS, SEED)
        for frame in frames:
            rows = []
            for own in shingle_sets(frame["text"].tolist(), SHINGLE, powers):
                if len(own) == 0:
                    rows.append((0, 0, 0, None))
                    continue
                a = own.sum(dtype=np.uint64).view(np.int64)
                b = (own * (own >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)
                rows.append((len(own), int(a), int(b), tuples(minhashes(own, xor, factor))))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_a", "set_b", "tuples"])
            out.insert(0, "id", frame["id"].to_numpy())
            yield out

    return docs.mapInPandas(run, "id long, n_shingles long, set_a long, set_b long, tuples array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """docs (id, text) as id, shingles and the digest of MARKS minhashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, (xor, factor) = Powers(), _functions(MARKS, SEED + 1)
        for frame in frames:
            own = list(shingle_sets(frame["text"].tolist(), SHINGLE, powers))
            yield pd.DataFrame({"id": frame["id"], "shingles": [x.view(np.int64) for x in own], "digest": [digest(minhashes(x, xor, factor)) for x in own]})

    return docs.mapInPandas(run, "id long, shingles array<long>, digest array<long>")


def buckets(classes: DataFrame) -> DataFrame:
    """(key, id) of the table keys: pairs of a tuple of the first collection and one of the second, both shared."""
    halves = classes.select("id", F.posexplode_outer("tuples").alias("place", "tuple"))
    # what a join needs by key is written first: beside an aggregate, Spark cannot split a hot key's rows
    shared = materialize(halves.groupBy("tuple").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tuple"), "shared-tuples")
    first = F.collect_list(F.when(F.col("place") < COLLECTION, F.col("tuple"))).alias("first")
    second = F.collect_list(F.when(F.col("place") >= COLLECTION, F.col("tuple"))).alias("second")
    own = halves.join(shared, "tuple").groupBy("id").agg(first, second)
    own = own.where((F.size("first") > 0) & (F.size("second") > 0)).select("id", F.explode("first").alias("one"), "second")
    keys = own.select("id", "one", F.explode("second").alias("two")).select("id", F.xxhash64("one", "two").alias("key"))
    keys = materialize(keys, "keys")
    full = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    full = materialize(full, "full-keys")
    out = materialize(keys.join(full, "key"), "buckets")
    for done in (shared, keys, full):
        discard(done)
    return out


def _differing(a: Column, b: Column) -> Column:
    """Places at which two longs of 4-bit digests differ."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def _may_link(also: Column | None = None) -> Column:
    """Whether a and b, of different components, share enough by size and by their digests."""
    most = F.least("a.shared", "b.shared")
    return (F.col("a.label") != F.col("b.label")) & (100 * most >= PERCENT * (F.col("a.n_shingles") + F.col("b.n_shingles") - most)) & (_alike() if also is None else also & _alike())


def _alike() -> Column:
    """Whether the digests of a and b agree in enough places."""
    # a lambda over the digest's longs: written out, the sum would be too long a method for the JIT to compile
    unlike = F.aggregate(F.zip_with("a.digest", "b.digest", _differing), F.lit(0), lambda n, x: n + x)
    return unlike <= MARKS - AGREE


def _apart(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Those pairs (id, pivot) that may link."""
    one = pairs.join(facts.alias("a"), "id").select("id", "pivot", F.struct("a.label", "a.shared", "a.n_shingles", "a.digest").alias("a"))
    return one.join(facts.select(F.col("id").alias("pivot"), F.struct("label", "shared", "n_shingles", "digest").alias("b")), "pivot").where(_may_link()).select("id", "pivot")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("src"), F.col("shingles").alias("a"))
    two = sets.select(F.col("id").alias("dst"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(one, "src").join(two, "dst").where(100 * both >= PERCENT * (F.size("a") + F.size("b") - both)).select("src", "dst")


def node_of(doc_id: Column, text: Column) -> Column:
    """The id, or for null a number that stands for the text."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS)))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    plain = docs.select(node_of(F.col(id_col), F.col(text_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = lambda c: F.when(F.col(c) < NAMELESS, F.col(c)).alias(c)
    return components(plain).select(named("id").alias("doc_id"), "n_shingles", named("component_id"), "kept")


def components(plain: DataFrame) -> DataFrame:
    """id, n_shingles, component_id and kept for each row of (id, text), without nulls."""
    signed = materialize(signatures(plain), "signatures")
    narrow = signed.select("id", "n_shingles", "set_a", "set_b")
    same = ["n_shingles", "set_a", "set_b"]
    classes = materialize(
        signed.where("n_shingles > 0").groupBy(*same).agg(F.min("id").alias("id"), F.min("tuples").alias("tuples")),
        "classes",
    )
    table = buckets(classes.select("id", "tuples"))
    members = materialize(table.select("id").distinct(), "members")
    chosen = plain.join(members, "id", "left_semi")
    sets = materialize(full_sets(chosen), "sets")
    facts, by_rare = _shareable(sets)
    own = F.floor(1000 * (F.col("n_shingles") - F.col("shared")) / F.col("n_shingles")).cast("int")
    label = _joined(members.select("id", F.col("id").alias("label")), confirmed(by_rare, sets))
    likely = materialize(table.join(facts.select("id", own.alias("own")), "id"), "open-buckets")
    discard(table)
    pivots = materialize(likely.groupBy("key").agg(F.min_by("id", F.struct("own", F.xxhash64("id"))).alias("pivot")), "pivots")
    found = _apart(likely.join(pivots, "key").select("id", "pivot").where("id != pivot").distinct(), label.join(facts, "id"))
    label = _joined(label, confirmed(found.select(F.greatest("id", "pivot").alias("src"), F.least("id", "pivot").alias("dst")).distinct(), sets))
    apart = likely.join(label, "id").groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    apart = materialize(apart, "apart")
    # equal tuples have equal 32 bits; that others have them too is as unlikely as that two hashes of shingles agree
    tuples = classes.select("id", F.transform("tuples", lambda x: F.shiftright(x, 32).cast("int")).alias("tuples"))
    open_ = likely.join(apart, "key").select("id").distinct().join(label, "id").join(facts, "id").join(tuples, "id")
    open_ = materialize(open_, "open")
    for done in (likely, pivots, apart):
        discard(done)
    label = _joined(label, confirmed(_left_apart(open_), sets))
    whole = classes.select(*same, "id").join(label, "id", "left").select(*same, F.coalesce("label", "id").alias("component_id"))
    component = F.coalesce("component_id", "id")
    return narrow.join(whole, same, "left").select("id", "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _left_apart(open_: DataFrame) -> DataFrame:
    """The pairs (src, dst) that share a table's key and may link, once each.

    Rows meet by the tuples of the first collection: they are a twentieth of the keys. Of two rows, one is not
    in the tuple's largest component; the tuple is the first that both have, and they have one of the second
    collection in common. A row stays only if some row of another component is small enough for it: at
    similarity p, n + n' <= s (1 + 1 / p) for the shingles s that it shares with anyone.
    """
    narrow = open_.select("id", "label", "n_shingles", "shared", F.posexplode(F.slice("tuples", 1, COLLECTION)).alias("one", "key"))
    bucket = ["one", "key"]
    each = materialize(narrow.groupBy(*bucket, "label").agg(F.count(F.lit(1)).alias("n"), F.min("n_shingles").alias("least")), "bucket-labels")
    largest, least = F.max(F.struct("n", "label")).getField("label"), F.min(F.struct("least", "label"))
    of_key = each.groupBy(*bucket).agg(largest.alias("main"), least.getField("label").alias("least_label"), least.getField("least").alias("least"))
    others = each.join(of_key.select(*bucket, F.col("least_label").alias("label")), [*bucket, "label"], "left_anti")
    of_key = materialize(of_key.join(others.groupBy(*bucket).agg(F.min("least").alias("next_least")), bucket), "bucket-sizes")
    other = F.when(F.col("label") == F.col("least_label"), F.col("next_least")).otherwise(F.col("least"))
    rows = narrow.join(of_key, bucket).where(PERCENT * (F.col("n_shingles") + other) <= (100 + PERCENT) * F.col("shared"))
    rows = rows.select(*bucket, "id", (F.col("label") == F.col("main")).alias("inner")).join(open_, "id")
    rows = materialize(rows, "left-apart")
    a, b = rows.where("NOT inner").alias("a"), rows.alias("b")
    equal = F.zip_with("a.tuples", "b.tuples", lambda x, y: x == y)
    here = (F.array_position(equal, True) == F.col("a.one") + 1) & F.array_contains(F.slice(equal, COLLECTION + 1, COLLECTION), True)
    same = (F.col("a.one") == F.col("b.one")) & (F.col("a.key") == F.col("b.key"))
    pairs = a.join(b, same & (F.col("b.inner") | (F.col("a.id") > F.col("b.id"))) & _may_link(here))
    return pairs.select(F.greatest("a.id", "b.id").alias("src"), F.least("a.id", "b.id").alias("dst"))


def _shareable(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, n_shingles, shared and digest of the documents that can link with any other at all; pairs by rare shingles.

    Two or three documents that alone have a shingle are paired at once, which makes at most three pairs a
    shingle. Any other two have only shingles in common that more documents have; shared, the number of those,
    bounds what two sets have in common, and a document with too few of them needs no further comparison.
    """
    each = sets.select("id", F.explode_outer("shingles").alias("shingle"))
    ends = [F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor("id").alias("all"), F.count(F.lit(1)).alias("n")]
    rare = each.groupBy("shingle").agg(*ends).where("n <= 3").select("low", "high", F.when(F.col("n") == 3, F.expr("all ^ low ^ high")).alias("middle"))
    rare = materialize(rare, "rare-shingles")
    alone = rare.select(F.explode(F.array_distinct(F.array("low", "high", "middle"))).alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("rare"))
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    pairs = rare.where("low < high").select(F.explode(F.array(pair("high", "low"), pair("middle", "low"), pair("high", "middle"))).alias("p"))
    pairs = pairs.select("p.*").where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("both"))
    known = sets.select("id", F.size("shingles").cast("long").alias("n_shingles"), "digest").join(alone, "id", "left")
    known = materialize(known.select("id", "n_shingles", (F.col("n_shingles") - F.coalesce("rare", F.lit(0))).alias("shared"), "digest"), "facts")
    a, b = known.alias("a"), known.select(F.col("id").alias("dst"), F.struct("n_shingles", "shared", "digest").alias("b"))
    pairs = pairs.join(a.select(F.col("id").alias("src"), F.struct("n_shingles", "shared", "digest").alias("a")), "src").join(b, "dst")
    most = F.least("a.shared", "b.shared") + F.col("both")
    likely = (100 * most >= PERCENT * (F.col("a.n_shingles") + F.col("b.n_shingles") - most)) & _alike()
    return known.where(100 * F.col("shared") >= PERCENT * F.col("n_shingles")), pairs.where(likely).select("src", "dst")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (id, label) once the links (src, dst) join components."""
    links = materialize(links, "links")
    if links.isEmpty():
        return label
    before = label.where("id != label").select(F.col("id").alias("src"), F.col("label").alias("dst"))
    found = connected_components(before.unionByName(links)).withColumnRenamed("node", "id").withColumnRenamed("component", "joined")
    return materialize(label.join(found, "id", "left").select("id", F.coalesce("joined", "label").alias("label")), "labels")
