"""Words at one edit beside brute force, forms and roots, odd input."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import product

import pytest
import regex

from ridgeline.llm import variants


def _near(words):
    """All pairs at one edit, by all deletions of one character."""
    out = {w: set() for w in words}
    cut = {}
    for w in words:
        for i in range(len(w)):
            cut.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    for (_, short), own in cut.items():
        for a in own:
            out[a] |= set(own) - {a}
            if short in out:
                out[a].add(short)
                out[short].add(a)
    return out


def _want(counts):
    near = _near(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def _got(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = [tuple(r) for r in variants.variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_vocabularies(spark, seed):
    pick = random.Random(seed)
    if seed == 1:  # all short words of two letters: every node branches, and a word may have many neighbours
        words = ["".join(x) for n in range(1, 7) for x in product("ab", repeat=n)]
    else:
        words = list({"".join(pick.choice("abcé") for _ in range(pick.randint(1, 6))) for _ in range(500)} | {"x", "aaaaaaa", "aaaaaa"})
    counts = {w: pick.choice([1, 2, 3, 30, 400, 5000, 60000]) for w in words}
    assert _got(spark, counts) == _want(counts)


def test_hot_nodes_and_chains(spark, monkeypatch):
    monkeypatch.setattr("ridgeline.operators.skew.FLOOR", 2)
    counts = {"common" + "".join(x): 2 for x in product("abcd", repeat=3)} | {"variation": 5, "variatiom": 50, "variatioo": 500, "variatiop": 5000, "variatiopp": 50000, "z": 1}
    got = _got(spark, counts)
    assert got == _want(counts)
    assert {r[0]: r[2] for r in got}["variation"] == "variatiopp"


def test_ties_and_none(spark):
    assert _got(spark, {"abc": 1, "abd": 20, "abe": 20, "xyz": 7}) == {("abc", "abd", "abd", 1, 2, 20), ("abd", None, "abd", 20, 2, None), ("abe", None, "abe", 20, 2, None), ("xyz", None, "xyz", 7, 0, None)}
    assert _got(spark, {"alone": 3}) == {("alone", None, "alone", 3, 0, None)}
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.variants(empty).count() == 0


def test_words_of_documents(spark):
    pick = random.Random(5)
    texts = [" ".join("".join(pick.choice(["Straße", "Éclair", "word", "ÀÿX", "a", "Letters"]) for _ in range(pick.randint(1, 3))) + pick.choice(["", "9", "-", "ж"]) for _ in range(300)) for _ in range(12)]
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x"), (99, None, "x"), (100, "", "x"), (101, "short words of few", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = Counter()
    lower = str.maketrans(variants.UPPER, variants.LOWER)
    for doc, text, _ in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            want[run] += len(run) >= 7
    got = {r["word"]: r["n"] for r in variants.vocabulary(variants.typed_words(docs)).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2} and len(got) > 50
    assert variants.variants(variants.vocabulary(variants.typed_words(docs.limit(0)))).count() == 0
