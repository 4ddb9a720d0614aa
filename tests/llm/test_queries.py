"""The registered text queries beside SQL or brute force, on a small table."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest

from compare import difference
from ridgeline.llm import queries
from ridgeline.sources.tables import table


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir) == ""


def test_repeats_by_brute_force(spark, sf_dir, texts):
    width, seen = 400, Counter()
    raw = {k: v.encode() for k, v in texts.items()}
    for x in raw.values():
        seen.update(hashlib.blake2b(x[i : i + width], digest_size=8).digest() for i in range(len(x) - width + 1))
    want = {}
    for k, x in raw.items():
        gone = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if seen[hashlib.blake2b(x[i : i + width], digest_size=8).digest()] > 1:
                gone[i : i + width] = b"\x01" * width
        left = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for p, g in zip(b"\0" + bytes(gone), gone, strict=False) if g and not p)
        want[k] = (len(x), sum(gone), spans, hashlib.sha256(left).hexdigest())
    rows = queries.op1_suffix_array_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want


def test_repeats_leave_the_rest_of_the_text(spark, tmp_path):
    """Passages of over 50 words go from 400 bytes on; shorter ones, and documents without one, keep their whole text."""
    long, short = (" ".join(f"{a}{i:0{n}d}" for i in range(60)) for a, n in (("p", 6), ("q", 4)))
    assert len(long) >= 400 > len(short)
    rows = {1: f"one {long} end", 2: f"two {long}\nlast", 3: f"three {short} c", 4: f"four {short} d", 5: "clean " * 60, 6: None, 7: f"é{long}é", 8: f"è{long}è"}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op1_suffix_array_dedup(spark, str(tmp_path)).collect()}
    want = rows | {1: "one end", 2: "two\nlast", 6: "", 7: "é\ufffd", 8: "è\ufffd"}
    assert {k: r["text"] for k, r in found.items()} == want
    assert [k for k, r in sorted(found.items()) if r["repeated"]] == [1, 2, 7, 8]
    left = "é".encode() + "é".encode()[1:]
    assert found[7]["kept_sha256"] == hashlib.sha256(left).hexdigest() and found[7]["n_removed"] == len(long) + 1


def test_packing_keeps_every_token(spark, sf_dir, texts):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in queries.op2_best_fit_packing(spark, sf_dir).collect():
        pieces[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for _, r in sorted(pieces[doc].items())] == want
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_language_on_held_out(spark, sf_dir):
    found = queries.op6_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = [r for r in found.collect() if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 0


def test_grades_order_the_labels(spark, sf_dir):
    found = queries.op8_quality_classifier(spark, sf_dir).join(queries.graded(table(spark, sf_dir, "labels")), "doc_id").collect()
    rows = [SimpleNamespace(**r.asDict()) for r in found if r["grade"] is not None]
    assert sum(r.kept == (r.grade == 2) for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_media_round_trip(spark, sf_dir, texts):
    rows = queries.op9_media_columns(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(full))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))


def test_pages_have_text_without_markup(spark, sf_dir):
    rows = queries.op10_html_extraction(spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "pages").count()
    assert all(r["n_chars"] == len(r["text"]) and "<script" not in r["text"] for r in rows)
    assert sum(bool(r["text"]) for r in rows) > 0.9 * len(rows)


def test_pipeline_stages_do_their_work(spark, sf_dir):
    import corpus_pipeline as p

    docs, seen = table(spark, sf_dir, "documents"), []
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, sf_dir), name)
        seen.append(docs.count())
        assert docs.columns == p.COLUMNS
    assert seen == sorted(seen, reverse=True)
    final = p.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in final.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    again = p.run(spark, sf_dir)
    order = ["doc_id", "piece", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(tuple, again.select(order).collect())) == sorted(map(tuple, final.select(order).collect()))
    assert difference(queries.decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")).select("doc_id"), "SELECT 1 AS doc_id WHERE false", sf_dir) == ""
