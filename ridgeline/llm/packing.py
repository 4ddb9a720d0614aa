"""Packing of tokenized documents into fixed-length sequences.

Documents become token ids plus one end id; longer ones are cut at the sequence length. Pieces are dealt
by hash into groups of bounded size, and each group is packed on its own, what it leaves in underfull bins once
more with those of other groups: best fit by decreasing length, then a local search over the underfull bins. It takes each of them, the emptiest first, and moves its
pieces into any other, or exchanges one of them for any one or two shorter pieces of any other, as long as
that raises the sum of squared fills; emptied bins go. It ends at the fewest possible bins, or where no
such step is left. Groups with hardly any short piece can end above the fewest; README has figures.

Defined results: null text is empty and becomes the end id alone; repeated rows are packed each on their
own; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ridgeline.sources.scratch import materialize

#: Pieces of a group, about; a group is one task's work and memory.
GROUP = 16384
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 600_000
#: Stands for a choice that is gone.
LARGE = 1 << 40
#: A bin with more than this share of a sequence free is packed again with those of other groups.
ROOM = 8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: The words of the tokenizer's own pre-tokenization.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Marks that are a pre-token of their own behind a letter.
MARKS = (",", ".", ";", ":", "!", "?")
#: The texts on which its normalizer only lower-cases.
PLAIN = regex.compile(r"[!-;=-~ß-öø-ÿÀ-ÖØ-Þ]*")


class Parts(dict):
    """Little-endian 32-bit ids by pre-token.

    The normalizer and the byte mapping leave printable ASCII in lower case as it is, so that such a
    pre-token goes to the tokenizer's model at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        if part.isascii():
            ids = [x.id for x in self.model.tokenize(part)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        else:
            found = self.whole(part)
        self[part] = found
        return found


class Words(dict):
    """Little-endian 32-bit ids by word: what the tokenizer gives for a text without white space.

    The tokenizer splits at white space, so a text's ids are those of its words in turn. Plain words are
    further split into its pre-tokens, of which there are far fewer.
    """

    def __init__(self, path: str):
        self.parts = Parts(path)

    def __missing__(self, word: str) -> bytes:
        letters = word[:-1] if word[-1:] in MARKS else word
        if letters.isascii() and letters.isalpha():
            found = self.parts[letters.lower()]
            if letters is not word:
                found += self.parts[word[-1]]
        elif PLAIN.fullmatch(word):
            found = b"".join([self.parts[x] for x in WORD.findall(word.lower())])
        else:
            found = self.parts.whole(word)
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        if text.isascii() and "<" not in text:  # a special token begins with <, and counts as written only
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """A worker's words, which outlast its tasks."""
    return Words(path)


def cut_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids: the pieces of at most length tokens; ids only if kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = words.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; items in decreasing length each go to the fullest bin with room."""
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        k = bisect_left(room, n)
        if k == len(room):
            b, left = len(bins), capacity
            bins.append([])
        else:
            left = room[k]
            b = by_room[left].pop()
            if not by_room[left]:
                del by_room[left]
                room.pop(k)
        bins[b].append(i)
        left -= n
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(room, left)
            by_room[left].append(b)
    return bins


class Exchanges:
    """Every move into an underfull bin, and every exchange for one or two of its pieces, by what the bin gives back.

    Pieces of one length are one choice, so a bin has at most about 2,000 choices, whatever it holds.
    """

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, size, capacity
        self.fill = np.array([sum(size[i] for i in b) for b in bins], np.int64)
        self.back = np.zeros(0, np.int64)
        self.bin = np.zeros(0, np.int64)
        self.count = 0
        self.spans: dict[int, tuple[int, int]] = {}
        self.renew([k for k in range(len(bins)) if 0 < self.fill[k] < capacity])

    def _choices(self, k: int) -> np.ndarray:
        """0, the lengths of bin k, and the sums of two of them."""
        counts: dict[int, int] = {}
        for i in self.bins[k]:
            counts[self.size[i]] = counts.get(self.size[i], 0) + 1
        one = np.array(sorted(counts), np.int64)
        two = (one[:, None] + one[None, :])[np.triu_indices(len(one), 1)]
        twice = np.array([2 * n for n, c in counts.items() if c > 1], np.int64)
        return np.unique(np.concatenate([[0], one, two, twice]))

    def renew(self, changed: list[int]) -> None:
        """Take in what these bins hold now."""
        for k in changed:
            if k in self.spans:
                a, b = self.spans.pop(k)
                self.back[a:b] = LARGE
        new = [(k, self._choices(k)) for k in changed if 0 < self.fill[k] < self.capacity]
        need = sum(len(x) for _, x in new)
        if self.count + need > len(self.back):
            live = self.back[: self.count] < LARGE
            back, bins = self.back[: self.count][live], self.bin[: self.count][live]
            self.count = len(back)
            room = 2 * (self.count + need) + 1024
            self.back, self.bin = np.full(room, LARGE), np.zeros(room, np.int64)
            self.back[: self.count], self.bin[: self.count] = back, bins
            starts = np.flatnonzero(np.diff(bins, prepend=-1)).tolist()
            self.spans = {int(bins[a]): (a, b) for a, b in zip(starts, [*starts[1:], self.count], strict=False)}
        for k, x in new:
            self.back[self.count : self.count + len(x)], self.bin[self.count : self.count + len(x)] = x, k
            self.spans[k] = (self.count, self.count + len(x))
            self.count += len(x)

    def best(self, source: int, n: int) -> tuple[int, int] | None:
        """The bin, and the length it gives back for a piece of n of source, that gain most; the fullest of several."""
        back, bins = self.back[: self.count], self.bin[: self.count]
        at = np.flatnonzero(back < n)
        back, bins = back[at], bins[at]
        fill = self.fill[bins] + n - back
        # the sum of squared fills rises exactly if the bin ends fuller than the source was
        fits = np.flatnonzero((fill <= self.capacity) & (fill > self.fill[source]) & (bins != source))
        if not len(fits):
            return None
        k = fits[np.lexsort((bins[fits], -fill[fits], back[fits]))[0]] if len(fits) > 1 else fits[0]
        return int(bins[k]), int(back[k])

    def swap(self, source: int, i: int, k: int, back: int) -> None:
        """Piece i of source goes to bin k, and pieces of that length together come back."""
        own, size = self.bins[k], self.size
        given: list[int] = []
        if back:
            by_size: dict[int, list[int]] = {}
            for j in own:
                by_size.setdefault(size[j], []).append(j)
            if back in by_size:
                given = [by_size[back][0]]
            else:
                first = next(m for m in by_size if back - m in by_size and (2 * m != back or len(by_size[m]) > 1))
                given = [by_size[first][0], by_size[back - first][-1]]
        for j in given:
            own.remove(j)
        own.append(i)
        self.bins[source].remove(i)
        self.bins[source].extend(given)
        self.fill[k] += size[i] - back
        self.fill[source] += back - size[i]


def empty_bins(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The local search: raises the sum of squared fills by moves and exchanges, and drops emptied bins.

    Each pass goes through all underfull bins, the emptiest first. It ends when the fewest possible bins are
    left, or no move or exchange of any bin raises the sum.
    """
    size = lengths.tolist()
    fewest = -(-sum(size) // capacity)
    alive = len(bins)
    if alive <= fewest:
        return bins
    state = Exchanges(bins, size, capacity)
    changed = True
    while changed and alive > fewest:
        changed = False
        for source in sorted(np.flatnonzero((state.fill > 0) & (state.fill < capacity)).tolist(), key=lambda k: state.fill[k]):
            moved = True
            while moved and bins[source] and state.fill[source] < capacity:
                moved = False
                tried = set()
                for i in sorted(bins[source], key=lambda i: -size[i]):
                    if size[i] in tried:
                        continue
                    tried.add(size[i])
                    found = state.best(source, size[i])
                    if found:
                        state.swap(source, i, *found)
                        state.renew([source, found[0]])
                        moved = changed = True
                        break
            alive -= not bins[source]
            if alive <= fewest:
                break
    return [b for b in bins if b]


def pack(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset.

    Groups are set by the number of pieces. The bins of a group that have more room than 1 / ROOM of a sequence, few
    if the group came out well, are packed once more with those of other groups, until one group holds all of
    them, or most pieces are in such bins and another round would not find much.
    """
    pieces = materialize(pieces, "pieces")
    names = pieces.columns
    out_schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("_full", BooleanType())])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        bins = empty_bins(best_fit(lengths, capacity), lengths, capacity)
        order = np.concatenate([np.asarray(b, np.int64) for b in bins])
        counts = np.array([len(b) for b in bins])
        ends = np.cumsum(lengths[order])
        first = np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        out = frame.iloc[order].copy()
        out["sequence_id"] = np.repeat(np.arange(len(bins)), counts) + (int(key[0]) << 24) + (int(key[1]) << 56)
        out["offset"] = ends - lengths[order] - (ends - lengths[order])[first]
        out["_full"] = np.repeat(np.add.reduceat(lengths[order], np.concatenate([[0], np.cumsum(counts)[:-1]])) >= capacity - capacity // ROOM, counts)
        return out[[*names, "sequence_id", "offset", "_full"]]

    done, rest, n, level = [], pieces, pieces.count(), 0
    while True:
        groups = max(1, -(-n // group))
        place = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(groups)).alias("_group")
        packed = rest.groupBy(place, F.lit(level).alias("_level")).applyInPandas(run, out_schema)
        if groups == 1:
            done.append(packed.drop("_full"))
            break
        packed = materialize(packed, "packed")
        left = packed.where("NOT _full").count()
        if 4 * left > 3 * n:
            done.append(packed.drop("_full"))
            break
        done.append(packed.where("_full").drop("_full"))
        rest, n, level = packed.where("NOT _full").select(*names), left, level + 1
    return reduce(DataFrame.unionByName, done)
