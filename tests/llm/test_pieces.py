"""Ids and texts beside the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from ridgeline.llm import pieces, queries
from ridgeline.sources.tables import table


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=queries.pieces_path())


def _compare(library, texts):
    v = pieces.vocabulary(queries.pieces_path())
    want = library.encode(texts, add_bos=True, add_eos=True)
    got = [x.tolist() for x in pieces.encode_texts(v, texts)]
    assert got == want
    assert [pieces.decode_ids(v, np.array(x)) for x in got] == [library.decode(x) for x in want]


def test_made_texts(library):
    pick = random.Random(3)
    parts = ["a", " ", "▁", "ab", "the", "ing", "\n", "é", "日", "́", "<s>", "</s>", "<0x41>", "0", "ee", "\U0001f600", "\0", "ß", "про", "=", "  "]
    _compare(library, ["".join(pick.choice(parts) for _ in range(pick.randint(0, 60))) for _ in range(3000)])
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    _compare(library, ["".join(pick.choice(known) for _ in range(30)) for _ in range(2000)])
    _compare(library, ["".join(chr(pick.randint(1, 0x2FFF)) for _ in range(100)) for _ in range(300)])


def test_runs_and_long_words(library):
    _compare(library, [" " * k for k in range(80)] + [" " * k + "The" + " " * (k % 37) + "x" for k in range(80)] + ["a" * k for k in range(90)] + ["ab" * k for k in range(90)])
    pick = random.Random(4)
    _compare(library, ["".join(pick.choice("etaoinshrdlu") for _ in range(20000)), "x" * 50000, " " * 50000 + "x", "word " * 50000, ""])


def test_small_chunks_are_the_same(library, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 7)
    _compare(library, ["", "one", "two words", "", "three whole words", "x" * 30])


def test_words_of_one_key_are_kept_apart(library, monkeypatch):
    monkeypatch.setattr(pieces, "mix", lambda x: x * 0)
    _compare(library, ["some other words", "one two six ten"])


def test_any_ids_decode_as_the_library_does(library):
    pick = random.Random(5)
    v = pieces.vocabulary(queries.pieces_path())
    for _ in range(2000):
        ids = [pick.choice([0, 1, 2, pick.randrange(3, 259), pick.randrange(259, 32000), 29871]) for _ in range(pick.randint(0, 12))]
        assert pieces.decode_ids(v, np.array(ids, "<u4")) == library.decode(ids)


def test_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = queries.op12_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_nulls_repeated_rows_and_clashing_names(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "same", "x"), (1, "same", "x"), (2, "word " * 300000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = queries.pieces_path()
    out = pieces.decode(pieces.encode(docs, path), path)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    got = sorted((r["n_tokens"], r["decoded"]) for r in out.collect())
    assert got[:2] == [(2, ""), (2, "")] and got[2] == got[3] and got[2][1] == "same" and got[4][1] == rows[4][1]
    assert pieces.decode(pieces.encode(docs.limit(0), path), path).count() == 0
    both = pieces.round_trip(docs, path)
    assert set(both.columns) == set(out.columns) and sorted((r["n_tokens"], r["decoded"]) for r in both.collect()) == got
    assert pieces.round_trip(docs.limit(0), path).count() == 0
