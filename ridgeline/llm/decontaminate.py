"""Documents that hold benchmark items, by SimHash of item-sized windows and exact verification.

Words are runs of letters and digits, lower-cased. A window has as many words as the item it is compared
with. A window without any shingle of an item has similarity 0 to it, and moving a window right to its
first shared shingle loses none of them, so the windows that start at a shared shingle (or end with the
document) are all that matter. Their 64-bit SimHashes over words are matched with the items' by blocks: two
fingerprints within RADIUS bits agree in at least one of RADIUS + 1 blocks, so every such pair is found.
At similarity 0.75 that radius is more than four standard deviations away. Candidates are verified by the
sum of least over the sum of largest shingle counts.

Only DataFrame functions are used. The benchmark is broadcast if its words and blocks are few enough, and then
nothing but found pairs is shuffled; else it is joined.

Defined results: null or wordless texts and items match nothing; a document shorter than an item is one
window; an item shorter than a shingle is one shingle; repeated rows give one result; null ids come back null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 23
#: The benchmark is broadcast up to this number of words and blocks, of 16 to 32 bytes each.
BROADCAST_ROWS = 1_000_000
LANES = 3  # counters of 21 bits in a long


def words_of(text: Column) -> Column:
    """Words in order; null if there are none."""
    words = F.split(F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"[^\p{L}\p{N}]+", -1)
    return F.when(F.get(words, F.lit(0)) != "", words)


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def _votes(h: Column, at: int) -> Column:
    """LANES bits of a hash from bit at on, each the start of a counter."""
    bits = [F.shiftleft(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")), 21 * k) for k, b in enumerate(range(at, min(at + LANES, 64)))]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def simhash(rows: DataFrame, words: str = "words") -> DataFrame:
    """rows with their fingerprint: a bit is set where most words' hashes have it set."""
    hashed = rows.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    zero = F.lit(0).cast("long")
    lane = lambda at: F.aggregate("_hashes", zero, lambda total, h: total + _votes(h, at))
    sums = hashed.withColumns({f"_v{i}": lane(at) for i, at in enumerate(range(0, 64, LANES))})
    bits = []
    for b in range(64):
        count = F.shiftrightunsigned(F.col(f"_v{b // LANES}"), 21 * (b % LANES)).bitwiseAND(F.lit((1 << 21) - 1))
        bits.append(F.when(2 * count > F.size("_hashes"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(zero))
    return sums.select(*rows.columns, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def _parts(fingerprint: Column) -> list[Column]:
    """RADIUS + 1 parts of 2 or 3 bits."""
    wide = 64 - 2 * (RADIUS + 1)
    out, at = [], 0
    for k in range(RADIUS + 1):
        size = 3 if k < wide else 2
        out.append(F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
        at += size
    return out


def _blocks(fingerprint: Column) -> Column:
    """The parts, each with its number."""
    return F.array(*[part + F.lit(k * 8).cast("long") for k, part in enumerate(_parts(fingerprint))])


def _first_alike(x: Column) -> Column:
    """Number of the first part in which two fingerprints with this difference agree."""
    return F.coalesce(*[F.when(part == 0, F.lit(k)) for k, part in enumerate(_parts(x))])


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the shingles in order; one if there are fewer words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    return F.transform(at, lambda i: _shingle(words, i, size))


def _numbered(rows: DataFrame, size: int) -> DataFrame:
    """rows with numbered: each shingle hashed with how often it came before, so that sets of these hold counts."""
    sorted_ = rows.withColumn("_sorted", F.sort_array(_shingles(F.col("words"), size)))
    nth = F.transform("_sorted", lambda x, i: F.xxhash64(x, i - F.array_position("_sorted", x)))
    return sorted_.withColumn("numbered", nth).drop("_sorted")


def _windows(docs: DataFrame, items: DataFrame, size: int, small: bool) -> DataFrame:
    """(_id, _text, start, length, words): the windows of item lengths that start at a shared shingle, some repeatedly."""
    wanted = items.select("length", F.explode(_shingles(F.col("words"), size)).alias("shingle")).distinct()
    at = F.when(F.size("words") >= size, F.sequence(F.lit(0), F.size("words") - size))
    spots = docs.select("_id", "_text", "words", F.explode_outer(at).alias("_at")).where(F.col("_at").isNotNull())
    start = F.least(F.col("_at"), F.greatest(F.size("words") - F.col("length"), F.lit(0))).alias("start")
    cut = F.slice("words", F.col("start") + 1, F.col("length")).alias("words")
    key = ["_id", "_text", "start", "length"]
    if small:
        hits = spots.withColumn("shingle", _shingle(F.col("words"), F.col("_at"), size)).join(F.broadcast(wanted), "shingle")
        return hits.select("_id", "_text", "words", "length", start).select(*key, cut)
    narrow = spots.select("_id", "_text", F.size("words").alias("_n"), "_at", _shingle(F.col("words"), F.col("_at"), size).alias("shingle")).join(wanted, "shingle")
    places = narrow.select("_id", "_text", "length", F.least(F.col("_at"), F.greatest(F.col("_n") - F.col("length"), F.lit(0))).alias("start")).distinct()
    back = docs.dropDuplicates(["_id", "_text"]).alias("d").join(places.alias("p"), F.col("d._id").eqNullSafe(F.col("p._id")) & (F.col("d._text") == F.col("p._text")))
    return back.select("p._id", "p._text", "p.start", "p.length", "d.words").select(*key, cut)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, item_id, similarity, start, length: the best window of each document for each item it holds.

    text_key is the text's xxhash64, null counting as empty: with it rows without an id can be told apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_text"), words_of(text).alias("words"))
    items = benchmark.select("item_id", words_of(F.coalesce("text", F.lit(""))).alias("words")).where(F.col("words").isNotNull())
    items = items.withColumn("length", F.size("words"))
    sizes = [r[0] for r in items.select(F.least("length", F.lit(SHINGLE)).alias("size")).distinct().orderBy("size").collect()]
    cost = items.agg(F.sum(F.col("length") + RADIUS + 1)).first()[0]
    small = (cost or 0) <= BROADCAST_ROWS
    found = [_of_size(docs, items.where(F.least("length", F.lit(SHINGLE)) == k), k, similarity, small) for k in sizes or [SHINGLE]]
    return reduce(DataFrame.unionByName, found)


def _of_size(docs: DataFrame, items: DataFrame, size: int, similarity: float, small: bool) -> DataFrame:
    hint = F.broadcast if small else lambda df: df
    items = items.withColumn("_item", F.xxhash64("words"))
    own = simhash(items).select("item_id", "_item", "length", F.col("fingerprint").alias("item_fingerprint"))
    own = own.withColumn("_block", F.explode(_blocks(F.col("item_fingerprint"))))
    theirs = _numbered(items.dropDuplicates(["_item"]), size).select("_item", F.col("numbered").alias("item_numbered"))
    marks = _numbered(simhash(_windows(docs, items, size, small)), size).drop("words")
    marks = marks.withColumn("_block", F.explode(_blocks(F.col("fingerprint"))))
    x = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    # a pair that agrees in several blocks counts at the first of them
    near = (F.bit_count(x) <= RADIUS) & (_first_alike(x) == F.floor(F.col("_block") / 8))
    pairs = marks.join(hint(own), ["length", "_block"]).where(near).join(hint(theirs), "_item")
    shared = F.size(F.array_intersect("numbered", "item_numbered"))
    scored = pairs.select("_id", "_text", "item_id", "start", "length", (shared / (F.size("numbered") + F.size("item_numbered") - shared)).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "length")).alias("best")
    found = scored.where(F.col("similarity") >= similarity).groupBy("_id", "_text", "item_id").agg(best)
    return found.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text_key"), "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.back")).alias("start"), "best.length")
