"""Removal of byte strings of a given length that occur more than once, found by sampled suffixes.

Every window of LENGTH bytes has a sampled suffix: the one that starts at its smallest GRAM-byte hash, the
leftmost of equals. Equal windows sample at the same offset, so a repeated window is one whose sampled
suffix, and the bytes before it, occur again. Neighbouring windows share a sampled suffix; such a run is
known by its gram and by the hash of all bytes it covers, its context.

1. Runs whose context occurs twice are repeated as a whole: counts, combined before each shuffle.
2. For the other runs, the distinct contexts of a gram are sorted as suffixes (Spark's external sort, runs
   on disk merged by a priority queue), which gives the common prefix of any two. The windows that start
   before the sampled suffix are induced from that order: two of them are equal if the suffixes agree for
   the bytes that the window takes of them and the bytes before agree for the rest.
3. Grams with more contexts than a task should hold are resolved by counting window hashes instead.

Matches never cross documents. Defined results: null text is empty; a text below LENGTH bytes has no
window; equal rows are each other's repeats; null ids are allowed, as texts are known by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shingles import Powers, U, chunks, mix
from ridgeline.operators.skew import split_join
from ridgeline.sources.scratch import discard, materialize

LENGTH, GRAM = 400, 128
#: Contexts of one gram that a task compares; beyond, window hashes are counted.
TOGETHER = 4096
#: Up to so many contexts all pairs are compared by their common prefixes, beyond, classes are counted by offset.
PAIRS = 64
RUN = "k1 long, k2 long, doc long, gram long, ctx long, at int, lo int, hi int"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text and the text's two 64-bit hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), text.alias("text"))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(U).max, U)
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def sampled_runs(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, ...]:
    """For texts of LENGTH bytes or more: text number, gram, context, sampled place, first and last window."""
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    s = powers.prefix(data)
    gram = mix((s[GRAM:] - s[:-GRAM]) * powers.down[: len(s) - GRAM])
    low = U(0xFFFFFFFF)
    least = _least((gram & ~low) | np.arange(len(gram), dtype=U), LENGTH - GRAM + 1)
    place = (least & low).astype(np.int64)
    own = np.searchsorted(begins, np.arange(len(place)), "right") - 1
    whole = np.arange(len(place)) + LENGTH <= begins[own + 1]
    first = whole & np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1])])
    lo = np.flatnonzero(first)
    ends = np.concatenate([np.flatnonzero(first)[1:], [len(place)]])
    hi = np.minimum(ends - 1, begins[own[lo] + 1] - LENGTH)
    at = place[lo]
    ctx = np.array([xxhash.xxh3_64_intdigest(raw[a : b + LENGTH], seed=c) for a, b, c in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)], U)
    base = begins[own[lo]]
    return own[lo], gram[at].view(np.int64), ctx.view(np.int64), at - base, lo - base, hi - base


def runs(texts: DataFrame) -> DataFrame:
    """The sampled runs of every text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for frame in frames:
            data = [x.encode("utf-8", "replace") for x in frame["text"]]
            long = [i for i, x in enumerate(data) if len(x) >= LENGTH]
            names = frame[["k1", "k2", "doc"]].to_numpy()
            for begin, end in chunks([len(data[i]) for i in long]):
                part = np.array(long[begin:end])
                own, gram, ctx, at, lo, hi = sampled_runs([data[i] for i in part], powers)
                k = names[part[own]]
                yield pd.DataFrame({"k1": k[:, 0], "k2": k[:, 1], "doc": k[:, 2], "gram": gram, "ctx": ctx, "at": at.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    return texts.mapInPandas(run, RUN)


def _code(start: Column, end: Column) -> Column:
    return F.shiftleft(start.cast("long"), 32) + (end - start).cast("long")


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted runs with the bytes before (from the nearest) and from the sampled place on."""
    places = wanted.groupBy("k1", "k2", "doc").agg(F.collect_list(F.struct("gram", "ctx", "at", "lo", "hi", "n")).alias("runs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k1, k2, text, own in zip(frame["k1"], frame["k2"], frame["text"], frame["runs"], strict=True):
                raw = text.encode("utf-8", "replace")
                rows = [(r["gram"], r["ctx"], k1, k2, r["at"], r["at"] - r["hi"], r["at"] - r["lo"], r["n"], raw[r["lo"] : r["at"]][::-1], raw[r["at"] : r["hi"] + LENGTH]) for r in own]
                yield pd.DataFrame(rows, columns=["gram", "ctx", "k1", "k2", "at", "least", "most", "n", "before", "after"])

    schema = "gram long, ctx long, k1 long, k2 long, at int, least int, most int, n long, before binary, after binary"
    return texts.join(places, ["k1", "k2", "doc"]).select("k1", "k2", "text", "runs").mapInPandas(run, schema)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def induced(after: list[bytes], before: list[bytes], least: np.ndarray, most: np.ndarray) -> list[list[tuple[int, int]]]:
    """Ranges of offsets at which each context's window equals that of another. after is in order."""
    n = len(after)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    right = np.array([common(a, b) for a, b in zip(after[:-1], after[1:], strict=True)])
    if n <= PAIRS:
        for i in range(n - 1):
            shared = LENGTH
            for j in range(i + 1, n):
                shared = min(shared, int(right[j - 1]))
                lo = max(LENGTH - shared, least[i], least[j])
                hi = min(most[i], most[j])
                if lo > hi:
                    continue
                hi = min(hi, common(before[i], before[j]))
                if lo <= hi:
                    out[i].append((int(lo), int(hi)))
                    out[j].append((int(lo), int(hi)))
        return out
    order = sorted(range(n), key=before.__getitem__)
    left = np.array([common(before[a], before[b]) for a, b in zip(order[:-1], order[1:], strict=True)])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    for o in range(int(least.min()), int(most.max()) + 1):
        there = np.flatnonzero((least <= o) & (o <= most))
        by_right = np.concatenate([[0], np.cumsum(right < LENGTH - o)])
        by_left = np.concatenate([[0], np.cumsum(left < o)])[place]
        _, at, counts = np.unique(by_right[there] * n + by_left[there], return_inverse=True, return_counts=True)
        for i in there[counts[at] > 1]:
            out[i].append((o, o))
    return out


def _resolve_together(contexts: DataFrame) -> DataFrame:
    """(k1, k2, code) of the repeated bytes of contexts that occur once."""

    def ready(group: pd.DataFrame) -> pd.DataFrame:
        found = induced(group["after"].tolist(), group["before"].tolist(), group["least"].to_numpy(), group["most"].to_numpy())
        rows = []
        for k1, k2, at, n, ranges in zip(group["k1"], group["k2"], group["at"], group["n"], found, strict=True):
            if n == 1:
                rows += [(k1, k2, ((at - hi) << 32) + hi - lo + LENGTH) for lo, hi in set(ranges)]
        return pd.DataFrame(rows, columns=["k1", "k2", "code"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            gram = frame["gram"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1])
            parts = [ready(frame.iloc[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            rest = frame.iloc[edges[-1] :]
            if parts:
                yield pd.concat(parts, ignore_index=True).astype("int64")
        if rest is not None and len(rest):
            yield ready(rest).astype("int64")

    return contexts.repartition("gram").sortWithinPartitions("gram", "after", "ctx").mapInPandas(run, "k1 long, k2 long, code long")


def _resolve_by_count(contexts: DataFrame) -> DataFrame:
    """The same by counting the hashes of all windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for gram, k1, k2, at, least, most, n, before, after in zip(*(frame[c] for c in ("gram", "k1", "k2", "at", "least", "most", "n", "before", "after")), strict=True):
                raw, first = before[::-1] + after, len(before)
                for o in range(least, most + 1):
                    window = xxhash.xxh3_128_intdigest(raw[first - o : first - o + LENGTH])
                    rows.append((gram, (window >> 64) - (1 << 63), (window & ((1 << 64) - 1)) - (1 << 63), k1, k2, n, ((at - o) << 32) + LENGTH))
            yield pd.DataFrame(rows, columns=["gram", "w1", "w2", "k1", "k2", "n", "code"]).astype("int64")

    windows = contexts.mapInPandas(run, "gram long, w1 long, w2 long, k1 long, k2 long, n long, code long")
    key = ["gram", "w1", "w2"]
    twice = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(*key)
    return windows.where("n = 1").join(twice, key).select("k1", "k2", "code")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(k1, k2, codes): start * 2^32 + length of byte ranges that are repeated, possibly overlapping."""
    found = materialize(runs(texts), "runs")
    total = found.count()
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    grams = materialize(grams, "shared-grams")
    shared = materialize(split_join(found, grams, ["gram"], "times", total), "shared-runs")
    discard(found)
    discard(grams)
    first = F.min(F.struct("k1", "k2", "doc", "at", "lo", "hi")).alias("first")
    contexts = materialize(shared.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"), first), "contexts")
    whole = split_join(shared, contexts.where("n > 1").select("gram", "ctx", "n"), ["gram", "ctx"], "n", total)
    whole = materialize(whole.select("k1", "k2", _code(F.col("lo"), F.col("hi") + LENGTH).alias("code")), "whole-runs")
    discard(shared)
    open_ = contexts.groupBy("gram").agg(F.min("n").alias("least_n"), F.count(F.lit(1)).alias("together")).where("least_n = 1 AND together > 1")
    open_ = materialize(open_.select("gram", "together", F.col("together").alias("rows")), "open-grams")
    wanted = split_join(contexts, open_, ["gram"], "rows", total).select("gram", "ctx", "n", "together", "first.*")
    wanted = materialize(wanted, "wanted-runs")
    discard(contexts)
    few = _resolve_together(_contexts(texts, wanted.where(F.col("together") <= TOGETHER)))
    parts = whole.unionByName(few)
    many = wanted.where(F.col("together") > TOGETHER)
    if not many.isEmpty():
        parts = parts.unionByName(_resolve_by_count(materialize(_contexts(texts, many), "many-contexts")))
    return parts.groupBy("k1", "k2").agg(F.collect_set("code").alias("codes"))


def merged(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs."""
    codes = np.sort(codes)
    start, end = codes >> 32, (codes >> 32) + (codes & 0xFFFFFFFF)
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(codes) - 1]])]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, repeated (whether any byte goes), and if asked spans and kept.

    spans are start * 2^32 + length of the removed runs, kept the remaining bytes.
    """
    texts = keyed(docs, id_col, text_col)
    spans = materialize(repeated_spans(texts), "spans")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "repeated", *(["spans", "kept"] if keep_bytes else [])]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, repeated boolean" + ", spans array<long>, kept binary" * keep_bytes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for first, last in chunks(whole["text"].str.len().tolist()):
                frame, rows = whole.iloc[first:last], []
                for doc, text, codes in zip(frame["doc_id"], frame["text"], frame["codes"], strict=True):
                    raw = text.encode("utf-8", "replace")
                    start, end = merged(np.asarray(codes, np.int64)) if codes is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    kept, at = [], 0
                    for a, b in zip(start.tolist(), end.tolist(), strict=True):
                        kept.append(raw[at:a])
                        at = b
                    left = b"".join([*kept, raw[at:]])
                    row = (doc, len(raw), len(raw) - len(left), len(start), hashlib.sha256(left).hexdigest(), len(left), len(left) < len(raw))
                    rows.append((*row, ((start << 32) + end - start).tolist(), left) if keep_bytes else row)
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return own.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "codes").mapInPandas(run, schema)
