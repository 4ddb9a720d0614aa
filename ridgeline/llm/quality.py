"""Document grades by ordinal cumulative-link regression on hashed text.

A document's features are its words, their beginnings and the marks around them, hashed into one weight
vector; P(grade > k) = logistic(x.w - t_k) with ordered thresholds t_k shared by all documents. The
expected grade and the probability of at least a wanted grade decide what is selected.

Defined results: null text is empty; a text without words has x = 0 and gets the thresholds' own
probabilities; rows without a grade don't train; without graded rows every probability is one half.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
#: At most so many graded documents train, taken in order of a hash of their id; of rows that share an id, one.
TRAINING = 6000
#: Words that a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Features of a block of documents in a pass of the fit, about.
BLOCK = 1 << 18
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


class Features(dict):
    """Buckets of a word: itself, its beginning and its marks."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        core = word.strip(EDGES)
        marks = word.replace(core, " ", 1) if core else word
        self[word] = found = tuple(crc32(x.encode("utf-8", "replace")) % BUCKETS for x in ("w" + core, "p" + core[:6], "m" + marks))
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values, of unit length."""
        if len(self) > REMEMBERED:
            self.clear()
        words = text.lower().split()
        flat = np.fromiter((b for w in map(self.__getitem__, words) for b in w), np.int64, 3 * len(words))
        buckets, counts = np.unique(flat, return_counts=True)
        values = 1 + np.log(counts)
        return buckets, values / max(np.sqrt(values @ values), 1e-12)


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], grades: int, passes: int = 200, rate: float = 0.3, penalty: float = 2e-5) -> Model:
    """Full-batch Adam on the negative log likelihood, every grade weighing the same in sum.

    rows (buckets, values, grade) are packed as they come, into 8 bytes a feature; each pass goes through
    them in blocks, so that nothing but the features themselves grows with the texts.
    """
    y, blocks, slots = [], [], np.full(BUCKETS, -1, np.int32)
    open_: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> None:
        if open_:
            buckets = np.concatenate([b for b, _ in open_])
            fresh = np.unique(buckets[slots[buckets] < 0])
            slots[fresh] = slots.max() + 1 + np.arange(len(fresh))
            own = np.repeat(np.arange(len(open_), dtype=np.int32), [len(b) for b, _ in open_])
            blocks.append((len(y) - len(open_), len(y), own, slots[buckets], np.concatenate([v for _, v in open_]).astype(np.float32)))
            open_.clear()

    held = 0
    for buckets, values, grade in rows:
        open_.append((buckets, values))
        y.append(grade)
        held += len(buckets)
        if held >= BLOCK:
            close()
            held = 0
    close()
    thresholds = np.zeros(grades - 1)
    if not y:
        return Model(np.zeros(BUCKETS), thresholds)
    y = np.array(y)
    size = int(slots.max()) + 1
    share = np.bincount(y, minlength=grades)
    weight = (1 / np.maximum(share, 1))[y] / max(1, (share > 0).sum())
    at = np.arange(len(y))
    w, raw = np.zeros(size), np.concatenate([[-0.5], np.zeros(grades - 2)])  # t_0, then log steps
    state = [np.zeros(size + grades - 1) for _ in range(2)]
    for n in range(1, passes + 1):
        score = np.zeros(len(y))
        for a, b, own, slot, values in blocks:
            score[a:b] = np.bincount(own, values * w[slot], b - a)
        thresholds = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
        tail = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -40, 40)))
        full = np.concatenate([np.ones((len(y), 1)), tail, np.zeros((len(y), 1))], axis=1)
        p = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
        slope = np.concatenate([np.zeros((len(y), 1)), tail * (1 - tail), np.zeros((len(y), 1))], axis=1)
        up, down = slope[at, y], slope[at, y + 1]
        d_score = -weight * (up - down) / p
        d_t = np.bincount(y, weight * up / p, grades + 1) - np.bincount(y + 1, weight * down / p, grades + 1)
        d_t = d_t[1:-1]
        d_raw = np.concatenate([[d_t.sum()], [d_t[k:].sum() * np.exp(raw[k]) for k in range(1, grades - 1)]])
        d_w = penalty * w
        for a, b, own, slot, values in blocks:
            d_w += np.bincount(slot, values * d_score[a:b][own], size)
        grad = np.concatenate([d_w, d_raw])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = rate * (state[0] / (1 - 0.9**n)) / (np.sqrt(state[1] / (1 - 0.99**n)) + 1e-9) * min(1.0, 2 * (1 - n / (passes + 1)))
        w, raw = w - step[:size], raw - step[size:] * 0.3
    weights = np.zeros(BUCKETS)
    weights[slots >= 0] = w[slots[slots >= 0]]
    return Model(weights, thresholds)


def training_rows(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = TRAINING) -> DataFrame:
    """_id, g and the features b, v of at most limit graded ids, each with the text of the smallest hash that its id has."""
    chosen = graded.select(F.col(id_col).alias("_id"), F.col("grade").cast("int").alias("_grade")).where("_id IS NOT NULL AND _grade IS NOT NULL")
    chosen = chosen.groupBy("_id").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(limit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for frame in frames:
            rows = [(i, g, *features.of(x)) for i, g, x in zip(frame["_id"], frame["_grade"], frame["_text"], strict=True)]
            yield pd.DataFrame([(i, g, b.astype("<i4").tobytes(), v.astype("<f4").tobytes()) for i, g, b, v in rows], columns=["_id", "g", "b", "v"])

    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_grade").agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), F.col("_text").alias("text"))).alias("_least"))
    kind = chosen.schema["_id"].dataType.simpleString()
    return texts.select("_id", F.col("_least.text").alias("_text"), "_grade").mapInPandas(run, f"_id {kind}, g int, b binary, v binary")


def train(docs: DataFrame, graded: DataFrame, grades: int, id_col: str = "doc_id", text: str = "text", limit: int = TRAINING) -> Model:
    """graded: id, grade from 0. The bounded sample is fitted in one task; the driver gets the weights alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((np.frombuffer(b, "<i4"), np.frombuffer(v, "<f4"), g) for frame in frames for b, v, g in zip(frame["b"], frame["v"], frame["g"], strict=True))
        model = fit(rows, grades)
        yield pd.DataFrame({"weights": [model.weights.astype("<f4").tobytes()], "thresholds": [model.thresholds.tolist()]})

    rows = training_rows(docs, graded, id_col, text, limit)
    found = rows.repartition(1).sortWithinPartitions("g", "_id").mapInPandas(run, "weights binary, thresholds array<double>").first()
    if found is None:
        return Model(np.zeros(BUCKETS), np.zeros(grades - 1))
    return Model(np.frombuffer(found["weights"], "<f4"), np.array(found["thresholds"]))


def score(docs: DataFrame, model: Model, wanted: int, text: str = "text") -> DataFrame:
    """docs with expected_grade and tail_probability, P(grade >= wanted)."""
    weights, thresholds = np.asarray(model.weights, np.float32), model.thresholds

    @F.pandas_udf("expected_grade double, tail_probability double")
    def grade(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, own = Features(), Model(weights, thresholds)
        for part in parts:
            scores = np.zeros(len(part))
            for i, x in enumerate(part):
                if x:
                    buckets, values = features.of(x)
                    scores[i] = values @ weights[buckets]
            tails = own.tails(scores)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, wanted - 1]})

    names = ["expected_grade", "tail_probability"]
    return docs.drop(*names).withColumn("_grade", grade(F.col(text))).select("*", "_grade.*").drop("_grade")
