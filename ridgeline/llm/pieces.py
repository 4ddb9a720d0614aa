"""SentencePiece encoding and decoding by vectorised merge rounds.

A chunk of texts is one flat array of code points. It falls into words wherever two neighbours stand together
in no piece of the vocabulary, as no merge can cross such a place; equal words are encoded once a chunk. Every
word is a run of symbols in one flat array with the rank of each pair of neighbours beside it. A round finds
each word's smallest rank (a segmented minimum), merges that rank's pairs from the left without overlap in
all words at once, looks up the ranks of the new pairs and compacts the arrays; words without a pair leave. If a
merged symbol makes a pair that the library would take before the word's next merge of that rank, the word's
later merges wait for the next round, so that ids are the library's own.

Defined results: null text is empty (begin and end ids alone); repeated rows are encoded each; an empty table
gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ridgeline.llm.shingles import U, chunks, mix

#: Code points of a numpy pass, about: memory, not results, depends on it.
CHUNK = 1 << 18
SPACE = "▁"
NONE = np.int64(1) << 40

codecs.register_error("byte-by-byte", lambda e: ("�", e.start + 1))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of sizes[i] elements, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Vocabulary:
    """The model as arrays: symbols of code points, ranks of pairs, bytes of ids.

    A symbol is a piece's id, or size + code point for a character that is no piece.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size, self.begin, self.end = model.get_piece_size(), model.bos_id(), model.eos_id()
        names = [model.id_to_piece(i) for i in range(self.size)]
        self.control = np.array([model.is_control(i) for i in range(self.size)])
        byte = [model.is_byte(i) for i in range(self.size)]
        plain = {p: i for i, p in enumerate(names) if not (byte[i] or self.control[i] or model.is_unknown(i))}
        self.of_byte = np.zeros(256, np.int64)
        self.of_byte[[int(p[3:-1], 16) for p, b in zip(names, byte, strict=True) if b]] = np.flatnonzero(byte)
        self.symbol = self.size + np.arange(0x110000)
        for p, i in plain.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self._pairs(plain, model)
        self._neighbours(plain)
        self._blocks(plain, model)
        shown = [b"" if c else bytes([int(p[3:-1], 16)]) if b else " ⁇ ".encode() if model.is_unknown(i) else p.replace(SPACE, " ").encode() for i, (p, b, c) in enumerate(zip(names, byte, self.control, strict=True))]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown])
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.spaced = np.array([p in plain and p.startswith(SPACE) for p in names])

    def _pairs(self, plain: dict[str, int], model) -> None:
        """Every way to make a piece of two symbols, with the rank of its score: equal scores have equal ranks."""
        ranks = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in plain.values()}, reverse=True))}
        known = lambda p: plain[p] if p in plain else self.size + ord(p) if len(p) == 1 else None
        made = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = known(p[:k]), known(p[k:])
                if a is not None and b is not None:
                    made[a << 32 | b] = (ranks[model.get_score(i)], i)
        self.pair = np.array(sorted(made), np.int64)
        self.pair_rank, self.pair_id = np.array([made[k] for k in self.pair.tolist()], np.int64).reshape(-1, 2).T.copy()

    def _neighbours(self, plain: dict[str, int]) -> None:
        """Which code points stand side by side in a piece."""
        found = {(a, b) for p in plain for a, b in zip(p, p[1:], strict=False)}
        self.side = np.zeros(0x110000, np.int64)
        letters = sorted({x for ab in found for x in ab})
        self.side[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.together = np.zeros(self.width * self.width, bool)
        for a, b in found:
            self.together[self.side[ord(a)] * self.width + self.side[ord(b)]] = True

    def _blocks(self, plain: dict[str, int], model) -> None:
        """The length of the pieces that long runs of spaces are cut into from the left; 0 if they aren't.

        They are if runs of spaces alone have the lowest score, so that they merge last and from the left, and the
        leftmost run becomes a piece of the greatest length before any space behind it merges.
        """
        runs = {len(p): model.get_score(i) for p, i in plain.items() if len(p) > 1 and not p.strip(SPACE)}
        longest, lowest = max(runs, default=0), min(model.get_score(i) for p, i in plain.items() if len(p) > 1)
        mixed = any(SPACE * 2 in p and p.strip(SPACE) for p in plain)
        left = [1] * (2 * longest)
        while left and left[0] < longest:
            k = next((k for k in range(len(left) - 1) if left[k] + left[k + 1] in runs), len(left))
            if k == len(left) or sum(left[: k + 2]) > longest:
                break
            left[k : k + 2] = [left[k] + left[k + 1]]
        self.block = longest if left and left[0] == longest and not mixed and set(runs.values()) == {lowest} else 0

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is none) and piece of pairs of symbols."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.pair_id[at]

    def words(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the words start; first: where the texts do."""
        side = self.side[points]
        cut = np.ones(len(points), bool)
        np.logical_not(self.together[side[:-1] * self.width + side[1:]], out=cut[1:])
        cut[first] = True
        if self.block:
            space = points == ord(SPACE)
            fresh = space.copy()
            fresh[1:] &= ~space[:-1] | cut[1:]
            own = np.flatnonzero(space)
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(points)), 0))[own]
            cut[own[(own - begin) % self.block == 0]] = True
        return np.flatnonzero(cut)


def _merged(v: Vocabulary, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words when no pair remains, and their number by word."""
    number = np.zeros(len(symbols), np.int64)
    number[starts[1:]] = 1
    number = np.cumsum(number)
    rank = np.full(len(symbols), NONE)
    rank[:-1] = np.where(number[1:] == number[:-1], v.look_up(symbols[:-1], symbols[1:])[0], NONE)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        sizes = np.diff(np.append(starts, len(symbols)))
        least = np.minimum.reduceat(rank, starts)
        if (over := least == NONE).any():
            leave = np.repeat(over, sizes)
            done.append((number[leave], symbols[leave]))
            stay = ~leave
            symbols, number, rank = symbols[stay], number[stay], rank[stay]
            least, sizes = least[~over], sizes[~over]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        # of neighbouring pairs every other one, from the left
        fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        word, own = number[at], rank[at]
        piece = v.look_up(symbols[at], symbols[at + 1])[1]
        # what stands left of a merged symbol at that moment is merged already, what stands right is not
        before = symbols[at - 1]
        touches = np.concatenate([[False], at[1:] == at[:-1] + 2])
        before[touches] = piece[:-1][touches[1:]]
        left = np.where((at > 0) & (number[at - 1] == word), v.look_up(before, piece)[0], NONE)
        behind = np.minimum(at + 2, len(symbols) - 1)
        right = np.where((at + 2 < len(symbols)) & (number[behind] == word), v.look_up(piece, symbols[behind])[0], NONE)
        early = np.minimum(left, right) <= own
        if early.any():
            earlier = np.cumsum(early) - early
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            keep = earlier == np.repeat(earlier[first], np.diff(np.append(first, len(at))))
            at, piece = at[keep], piece[keep]
        symbols[at] = piece
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        new = at - np.arange(len(at))
        symbols, number, rank = symbols[stay], number[stay], rank[stay]
        touched = np.concatenate([new, new[new > 0] - 1])
        beside = np.minimum(touched + 1, len(symbols) - 1)
        inside = (touched + 1 < len(symbols)) & (number[touched] == number[beside])
        rank[touched] = np.where(inside, v.look_up(symbols[touched], symbols[beside])[0], NONE)
    number, symbols = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(number, kind="stable")
    return symbols[order], np.bincount(number)


def _ids(v: Vocabulary, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their number by word: characters that are no piece become their UTF-8 bytes."""
    odd = symbols >= v.size
    if not odd.any():
        return symbols, sizes
    raw = [chr(c).encode("utf-8", "replace") for c in (symbols[odd] - v.size).tolist()]
    width = np.ones(len(symbols), np.int64)
    width[odd] = [len(x) for x in raw]
    out = np.repeat(symbols, width)
    out[np.repeat(odd, width)] = v.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.add.reduceat(width, np.cumsum(sizes) - sizes)


def _same(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> bool:
    return bool((sizes == sizes[chosen]).all() and (points == points[_spread(starts[chosen], sizes)]).all())


def encode_texts(v: Vocabulary, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text, with begin and end ids, as little-endian unsigned 32-bit integers."""
    for begin, end in chunks([len(x) + 1 for x in texts], CHUNK):
        own = [SPACE + x.replace(" ", SPACE) if x else "" for x in texts[begin:end]]
        lengths = np.array([len(x) for x in own])
        points = np.frombuffer("".join(own).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        first = (np.cumsum(lengths) - lengths)[lengths > 0]
        if not len(points):
            ids, counts, inverse, starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            starts = v.words(points, first)
            sizes = np.diff(np.append(starts, len(points)))
            # a word's key: the sum of its code points' hashes, each mixed with its place in the word
            place = (np.arange(len(points)) - np.repeat(starts, sizes)).astype(U)
            key = np.add.reduceat(mix(mix(points.astype(U) + U(1)) + place * U(0x9E3779B97F4A7C15)), starts) + sizes.astype(U)
            _, chosen, inverse = np.unique(key, return_index=True, return_inverse=True)
            if not _same(points, starts, sizes, chosen[inverse]):  # two words of one key
                chosen = inverse = np.arange(len(starts))
            flat = v.symbol[points[_spread(starts[chosen], sizes[chosen])]]
            ids, counts = _ids(v, *_merged(v, flat, np.cumsum(sizes[chosen]) - sizes[chosen]))
        of_word = counts[inverse]
        out = ids[_spread((np.cumsum(counts) - counts)[inverse], of_word)].astype("<u4")
        total = np.concatenate([[0], np.cumsum(of_word)])
        edge = total[np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield np.concatenate([[v.begin], out[a:b], [v.end]]).astype("<u4")


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids: control ids are silent, the first space goes, bytes that are no UTF-8 become U+FFFD each."""
    runs = [x[~v.control[x]].astype(np.int64) for x in np.split(ids, np.flatnonzero(v.control[ids]))]  # bytes don't meet across a control id
    data = [v.shown[_spread(v.shown_start[x], v.shown_size[x])].tobytes() for x in runs if len(x)]
    if data and v.spaced[next(x for x in runs if len(x))[0]]:
        data[0] = data[0][1:]
    return "".join([x.decode("utf-8", "byte-by-byte") for x in data])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """A worker's vocabulary, which outlasts its tasks."""
    return Vocabulary(path)


def encoder(path: str) -> Callable[[Column], Column]:
    """A column function: a text's ids as little-endian unsigned 32-bit integers."""

    @pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for texts in batches:
            yield pd.Series([x.tobytes() for x in encode_texts(v, texts.fillna("").tolist())], dtype=object)

    return run


def decoder(path: str) -> Callable[[Column], Column]:
    """A column function: the text of such ids."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for rows in batches:
            yield pd.Series([decode_ids(v, np.frombuffer(x or b"", "<u4")) for x in rows.tolist()], dtype=object)

    return run


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """encode() and decode() by one worker a task: docs with ids, n_tokens and decoded."""

    @pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for texts in batches:
            ids = list(encode_texts(v, texts.fillna("").tolist()))
            yield pd.DataFrame({"ids": [x.tobytes() for x in ids], "decoded": [decode_ids(v, x) for x in ids]}, dtype=object)

    out = docs.drop(*({"ids", "n_tokens", "decoded"} - {text_col})).withColumn("_coded", run(F.col(text_col)))
    return out.withColumns({"ids": F.col("_coded.ids"), "n_tokens": F.expr("octet_length(_coded.ids) div 4"), "decoded": F.col("_coded.decoded")}).drop("_coded")


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ids (binary, 4 bytes an id) and n_tokens; the model at path must be there on every executor."""
    return docs.withColumn("ids", encoder(path)(F.col(text_col))).withColumn("n_tokens", F.expr("octet_length(ids) div 4"))


def decode(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """docs with decoded, the text of their ids."""
    return docs.withColumn("decoded", decoder(path)(F.col(ids_col)))
