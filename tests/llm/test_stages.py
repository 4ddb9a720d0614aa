"""Stages of the pipeline on small tables."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as p
from compare import duck_rows
from ridgeline.llm import queries
from ridgeline.sources.tables import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(seed: int, n: int = 60) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 100003}" for i in range(n))


def test_rows_that_share_an_id_stay_unless_near(spark, sf_dir):
    near = _text(1) + " tail"
    rows = [(1, _text(2)), (1, _text(3)), (1, _text(3)), (1, near), (0, _text(1)), (None, _text(4)), (None, _text(5)), (None, _text(2) + " x"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], DOCS)
    kept = p.drop_near_duplicates(spark, docs, sf_dir).collect()
    want = [(1, _text(2)), (1, _text(3)), (0, _text(1)), (None, _text(4)), (None, _text(5)), (2, None), (3, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(want, key=str)


ODD = [
    (None, None, None, None, None), (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", None), (3, "\n \t\n", "en", None, 3), (4, "one", "en", "s", 3),
    (5, " ".join(f"v{i}" for i in range(50000)), "en", "s", 1), (6, _text(8), "en", "s", 1), (6, _text(8), "en", "s", 1), (7, _text(8) + "\n" + _text(8), "en", "s", 1), (8, "\u0000 \U0001f600", "en", "s", 1),
]


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows, extra columns with names that the operators use, and empty tables."""
    docs = spark.createDataFrame(ODD, DOCS)
    for name, stage in p.STAGES:
        for own in (docs, docs.limit(0)):
            more = own.withColumns({c: F.lit("mine") for c in ("id", "label", "kept", "key", "_id", "_text", "piece", "length", "score", "n_lines")})
            rows = stage(spark, more, sf_dir)
            assert name == "best_fit_packing" or rows.columns == p.COLUMNS
            n = rows.count()
            assert n == 0 if own.isEmpty() else n > 0
    assert {r["doc_id"] for r in p.drop_near_duplicates(spark, docs, sf_dir).collect()} == {None, 1, 2, 3, 4, 5, 6, 8}
    lines = p.remove_lines(spark, docs, sf_dir).collect()
    assert len(lines) == len(ODD) and {r["text"] for r in lines if r["doc_id"] in (1, 2, 4)} == {None, "", "one"}
    packed = p.pack_sequences(spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == len(ODD)


def _duck(sql, sf_dir):
    names, rows = duck_rows(sql, sf_dir)
    return [dict(zip(names, r, strict=True)) for r in rows.elements()]


def test_line_stage_as_sql(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = {r["doc_id"]: r["kept_sha256"] for r in _duck(queries.ORACLE_SQL["op4_line_dedup"], sf_dir) if r["n_removed_lines"] < r["n_lines"]}
    got = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in p.remove_lines(spark, docs, sf_dir).collect()}
    assert got == want


def test_contamination_stage_as_sql(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bad = {r["doc_id"] for r in _duck(queries.ORACLE_SQL["op3_decontamination"], sf_dir)}
    assert bad and {r["doc_id"] for r in p.drop_contaminated(spark, docs, sf_dir).collect()} == {r["doc_id"] for r in docs.collect()} - bad


def test_near_duplicate_stage_by_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, sf_dir, "documents").collect()]
    base = _text(90, 80).split()
    # chains of ever more edits: each is near its neighbours, the ends are not near each other
    docs += [(100000 + k, " ".join(["x" * (i + 2) if i < k else w for i, w in enumerate(base)])) for k in range(0, 20, 2)]
    sets = {}
    for i, x in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    own = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in docs], DOCS)
    assert {r["doc_id"] for r in p.drop_near_duplicates(spark, own, sf_dir).collect()} == {find(i) for i in ids}
    assert len({find(100000 + k) for k in range(0, 20, 2)}) == 1


def test_links_at_the_threshold_are_found(spark):
    """Pairs at 75 to 80 percent: of 300 planted, all are linked, and none just below."""
    rows, want = [], {}
    for n in range(300):
        words = _text(1000 + n, 104).split()
        # an edit at the end of a set of 100 shingles takes k of them away and brings k others
        k = 14 if n % 2 else 15
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[:-k] + [f"z{n}x{i}" for i in range(k)]))]
        want[2 * n + 1] = 2 * n if 100 * (100 - k) >= 75 * (100 + k) else 2 * n + 1
    found = {r["doc_id"]: r["component_id"] for r in queries.near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: found[i] for i in want} == want and 0 < sum(v % 2 for v in want.values()) < 300


def test_a_large_group_of_near_copies(spark):
    """Several hundred copies with random edits: links are found whatever the group's size."""
    rng = random.Random(5)
    base = _text(7, 150).split()
    docs = {}
    for i in range(400):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 6])):
            w[at] = f"e{rng.randrange(10**6)}"
        docs[i] = w
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in docs.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a + 1, 400):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = queries.near_dedup.groups(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: find(i) for i in sets}
