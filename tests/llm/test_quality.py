"""Training rows, held-out labels and what is defined without grades."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import quality, queries
from ridgeline.sources.tables import table


def test_a_labelled_id_trains_once(spark):
    rows = [(1, f"text {i % 7} of the hot id") for i in range(50)] + [(2, "second"), (3, None), (4, "without a label")]
    graded = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (9, 1)], "doc_id long, grade int")
    both = [spark.createDataFrame(own, "doc_id long, text string") for own in (rows, rows[::-1])]
    assert [sorted(r["g"] for r in quality.training_rows(own, graded).collect()) for own in both] == [[0, 1, 1]] * 2
    models = [quality.train(own, graded, 2) for own in both]
    assert (models[0].weights == models[1].weights).all()


def test_held_out_grades(spark):
    """A third of the labels never trains; its documents are told apart all the same."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), queries.graded(table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = quality.train(docs, labels.where(~held_out), queries.GRADES)
    found = quality.score(docs, model, queries.GOOD).join(labels.where(held_out), "doc_id").collect()
    rows = [(r["tail_probability"] >= 0.5, r["grade"] == queries.GOOD) for r in found if r["grade"] is not None]
    assert np.mean([kept for kept, good in rows if good]) >= 0.95 and 0.85 <= np.mean([not kept for kept, good in rows if not good])
    by_grade = [np.mean([r["expected_grade"] for r in found if r["grade"] == g]) for g in range(3)]
    assert by_grade == sorted(by_grade)


def test_without_grades_every_probability_is_one_half(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (None, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    rows = quality.score(docs, quality.train(docs, none, 3), 2).collect()
    assert [(r["expected_grade"], r["tail_probability"]) for r in rows] == [(1.0, 0.5)] * 3


def test_thresholds_are_in_order():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 50, 8)) + 50 * g, np.ones(1), g) for g in rng.integers(0, 4, 60)]
    model = quality.fit([(b, np.full(len(b), len(b) ** -0.5), int(g)) for b, _, g in rows], 4)
    assert (np.diff(model.thresholds) > 0).all()


def test_fit_lowers_the_loss_written_out_for_each_row():
    """The ordinal likelihood row by row: no small change of a weight or a threshold is better than the fit by much."""
    import numpy as np

    from ridgeline.llm import quality

    pick = np.random.default_rng(3)
    rows = []
    for _ in range(120):
        buckets = np.unique(pick.integers(0, 9, 4))
        values = np.ones(len(buckets)) / np.sqrt(len(buckets))
        rows.append((buckets, values, int(np.clip(round(buckets.mean() / 3 + pick.normal(0, 0.6)), 0, 2))))
    penalty = 0.05
    model = quality.fit(rows, 3, passes=3000, penalty=penalty)
    share = np.bincount([g for _, _, g in rows], minlength=3)

    def loss(w: np.ndarray, t: np.ndarray) -> float:
        total = penalty * (w @ w) / 2
        for buckets, values, g in rows:
            tail = [1.0, *(1 / (1 + np.exp(x - values @ w[buckets])) for x in t), 0.0]
            total -= np.log(tail[g] - tail[g + 1]) / share[g] / 3
        return total

    w, t = model.weights[:9].copy(), model.thresholds.copy()
    assert not model.weights[9:].any() and t[0] < t[1]
    best = loss(w, t)
    for k in range(9):
        for d in (-0.05, 0.05):
            assert loss(w + d * (np.arange(9) == k), t) > best - 1e-4
    for k in range(2):
        for d in (-0.05, 0.05):
            assert loss(w, t + d * (np.arange(2) == k)) > best - 1e-4


def test_scores_by_hand(spark):
    import math
    from zlib import crc32

    import numpy as np

    from ridgeline.llm import quality

    weights = np.zeros(quality.BUCKETS)
    texts = ["Good good, bad", "bad", "", None, "other"]
    for word, x in (("wgood", 2.0), ("wbad", -1.0), ("pgood", 0.5)):
        weights[crc32(word.encode()) % quality.BUCKETS] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in quality.score(docs, quality.Model(weights, np.array([-0.5, 0.7])), 2).collect()}
    for i, text in enumerate(texts):
        counts: dict[str, int] = {}
        for word in (text or "").lower().split():
            core = word.strip(quality.EDGES)
            for name in ("w" + core, "p" + core[:6], "m" + word.replace(core, " ", 1)):
                counts[name] = counts.get(name, 0) + 1
        values = {k: 1 + math.log(n) for k, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in values.values())) or 1.0
        s = sum(v / norm * weights[crc32(k.encode()) % quality.BUCKETS] for k, v in values.items())
        tails = [1 / (1 + math.exp(t - s)) for t in (-0.5, 0.7)]
        assert abs(got[i]["tail_probability"] - tails[1]) < 1e-5 and abs(got[i]["expected_grade"] - sum(tails)) < 1e-5
