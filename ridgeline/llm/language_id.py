"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +-1. A letter n-gram's vector binds (multiplies) its letters'
vectors, each rotated by its place; a text's vector bundles (adds) those of its n-grams, and so does a
language's prototype over its training texts. A text gets the language whose prototype has the largest
cosine with it. Tasks bundle what they read, so only sums of fixed size are gathered.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties go to the first
language by name; without training texts everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
SEED = 7
N = 3
#: Letters per numpy pass.
CHUNK = 1 << 20
BITS = 8


def _letters() -> np.ndarray:
    """Code point to letter number: 0 for other characters, 1-58 for Latin letters, a bucket for the rest."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = 59 + c % 197
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[0xDF:0x100] = np.where(out[0xDF:0x100] > 0, np.arange(26, 59), 0)
    out[0xDF] = 27
    return out


class Encoder:
    """N-gram codes of texts, and their vectors."""

    def __init__(self) -> None:
        self.letters = _letters()
        base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (1 << BITS, DIMENSIONS))
        self.turned = [np.roll(base, N - 1 - k, axis=1) for k in range(N)]

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of all texts: text number, n-gram and count. Words and texts are bounded by one blank."""
        joined = f"\0{chr(0).join(texts)}\0".lower()
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        if joined.count("\0") != len(texts) + 1 or len(texts) == 0:  # a text that holds the separator itself
            return self._one_by_one(texts)
        text = np.cumsum(points == 0, dtype=np.int64) - 1
        x = self.letters[points]
        # runs of other characters become one; a separator is the blank after one text and before the next
        keep = (x > 0) | np.concatenate([[True], x[:-1] > 0]) | (points == 0)
        x, text = x[keep].astype(np.int64), text[keep]
        if len(x) < N:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        gram = np.zeros(len(x) - N + 1, np.int64)
        for k in range(N):
            gram = (gram << BITS) | x[k : len(x) - N + 1 + k]
        # an n-gram belongs to the text of its middle letter, and at most one separator is beside that
        whole, text = x[1 : len(gram) + 1] > 0, text[1 : len(gram) + 1]
        both, counts = np.unique((text[whole] << (BITS * N)) | gram[whole], return_counts=True)
        return both >> (BITS * N), both & ((1 << BITS * N) - 1), counts

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [self.codes([x.replace("\0", " ")]) for x in texts]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] + i for i, p in enumerate(parts)]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), DIMENSIONS), np.int8)
        for k in range(N):
            out *= self.turned[k][(grams >> (BITS * (N - 1 - k))) & ((1 << BITS) - 1)]
        return out


def _chunks(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of consecutive texts of about CHUNK characters together."""
    own: list[int] = []
    size = 0
    for i, x in enumerate(texts):
        own.append(i)
        size += len(x) + 1
        if size >= CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name and their bundled vectors, over every row with a language."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = Encoder(), {}
        for frame in frames:
            for name, own in frame.groupby("lang"):
                texts = own["text"].tolist()
                for chunk in _chunks(texts):
                    _, grams, counts = encoder.codes([texts[i] for i in chunk])
                    grams, at = np.unique(grams, return_inverse=True)
                    if len(grams):
                        weights = np.bincount(at, counts)
                        sums[name] = sums.get(name, 0) + weights @ encoder.vectors(grams).astype(np.float64)
        yield pd.DataFrame({"lang": list(sums), "bundle": [v.tolist() for v in sums.values()]}, dtype=object)

    parts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = parts.mapInPandas(run, "lang string, bundle array<double>")
    total = parts.select("lang", F.posexplode("bundle").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("bundle")).orderBy("lang").collect()
    return [r["lang"] for r in rows], np.array([[x["v"] for x in r["bundle"]] for r in rows]).reshape(len(rows), DIMENSIONS)


def identify(docs: DataFrame, names: list[str], bundles: np.ndarray, text: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of the text; only the text decides."""
    docs = docs.drop("lang_pred", "score")
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    unit = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-300)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        wanted = unit.T.astype(np.float32)
        for frame in frames:
            texts = ["" if x is None else x for x in frame[text]]
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for chunk in _chunks(texts):
                which, grams, counts = encoder.codes([texts[i] for i in chunk])
                if not len(grams) or not names:
                    continue
                known, at = np.unique(grams, return_inverse=True)
                table = encoder.vectors(known).astype(np.float32)
                ends = np.flatnonzero(np.diff(which, append=-1)) + 1
                begin = 0
                for end in ends:
                    v = counts[begin:end].astype(np.float32) @ table[at[begin:end]]
                    near = (v @ wanted) / max(float(np.sqrt(v @ v)), 1e-30)
                    best = int(np.argmax(near))
                    i = chunk[which[begin]]
                    lang[i], score[i] = names[best], min(1.0, max(0.0, float(near[best])))
                    begin = end
            yield frame.drop(columns=text).assign(lang_pred=lang, score=score)

    return docs.mapInPandas(run, schema)
