"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import pytest

from ridgeline.llm import decontaminate, html_text, language_id, line_dedup, media, near_dedup, packing, quality, queries, repeats, url_filter
from ridgeline.sources.tables import table

SCHEMA = "doc_id long, text string, lang string, id long, key string, words string, rule string, _id string"
LONG = " ".join(f"word{i % 977}" for i in range(60000))
PASSAGE = "\n".join(f"shared line number {i} of a passage that is long enough" for i in range(40))
ROWS = [
    (1, None, None), (2, "", "en"), (None, None, None), (None, "a text without an id", "en"), (3, "\n\n \t", "de"), (4, LONG, "en"),
    (5, PASSAGE + "\nfirst end", "en"), (6, "another start\n" + PASSAGE, None), (6, "another start\n" + PASSAGE, None), (7, "one", "fr"), (8, "\u0000 ퟿ \U0001f600 é", None),
]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    rows = [(*r, 5, "k", "w", "r", "x") for r in ROWS] if request.param == "rows" else []
    return spark.createDataFrame(rows, SCHEMA)


def test_repeats(docs):
    rows = repeats.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["doc_id"] not in (5, 6) or r["n_removed"] >= len(PASSAGE)


def test_packing(docs):
    pieces = packing.cut_pieces(docs, queries.tokenizer_path(), 2048)
    packed = packing.pack(pieces, 2048).collect()
    assert len(packed) == pieces.count()
    assert sum(r["piece"] == 0 for r in packed) == docs.count()


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "one"), (4, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == (set() if docs.isEmpty() else {(5, 1), (6, 1), (7, 3)})
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_by_joins_is_the_same(spark, sf_dir, monkeypatch):
    docs, items = (table(spark, sf_dir, x) for x in ("documents", "benchmark"))
    small = sorted(map(str, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert small and sorted(map(str, decontaminate.contaminated(docs, items).collect())) == small


def test_lines(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed_lines", "n_removed_chunks"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["_id"] == "x" for r in rows)
    assert docs.isEmpty() or any(r["doc_id"] == 6 and r["n_removed_lines"] > 20 for r in rows)


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (4, "http://A.example.ORG/es/1?q", "x"), (4, "http://A.example.ORG/es/1?q", "x")], "page_id int, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    rows = url_filter.apply_rules(pages, rules).select("page_id", "rule", "verdict").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, None, "allow"), (2, None, "allow"), (3, None, "allow"), (4, "example.org/es/", "block"), (4, "example.org/es/", "block")]
    assert {r["verdict"] for r in url_filter.apply_rules(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.apply_rules(pages.limit(0), rules).count() == 0


def test_hosts_with_odd_bytes_and_many_sweeps(spark):
    urls = ["http://a\0b.org/x", "http://x.com/fr/1", "http://x.com/de/1", "http://com/fr/", "http://..org/", "http://org", "http://org/", "ftp://ORG/y"] + [f"http://h{i}.com/{'fr' if i % 3 else 'de'}/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    runs = [sorted(map(str, url_filter.apply_rules(pages, rules, sweep_rows=n).select("page_id", "rule", "verdict").collect())) for n in (7, 1 << 17)]
    assert runs[0] == runs[1] and len(runs[0]) == len(urls)
    got = {r["page_id"]: r["rule"] for r in url_filter.apply_rules(pages, rules).collect()}
    assert [got[i] for i in range(8)] == ["org/", "com/fr/", "com/de/", "com/fr/", "org/", None, "org/", "org/"]


def test_language(docs):
    rows = language_id.identify(docs, *language_id.prototypes(docs)).collect()
    assert len(rows) == docs.count()
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (1, 2, 3))


def test_near_duplicates(docs):
    rows = near_dedup.groups(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["n_shingles"] == 0 and r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == (set() if docs.isEmpty() else {5})


def test_quality(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 1), (99, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        assert queries.graded_documents(docs, own).count() == docs.count()


def test_media(spark):
    pages = spark.createDataFrame([(1, '<p>a &amp; b</p><figure><img src="sha256:x"><figcaption>cap</figcaption></figure>c'), (2, None)], "page_id int, html string")
    items = media.interleave(pages, ["page_id"])
    rows = [(r["position"], r["kind"], r["text"], r["digest"], r["caption"]) for r in items.orderBy("position").collect()]
    assert rows == [(0, "text", "a & b", None, None), (1, "media", None, "x", "cap"), (2, "text", "c", None, None)]
    known = spark.createDataFrame([("x", bytearray(b"P5\n192 1\n255\n" + b"\n" * 192), 1)], "digest string, media binary, feature int")
    assert {r["position"] for r in media.describe(media.resolve(items, known)).where("payload_bytes = 192").collect()} == {1}
    assert media.interleave(pages.limit(0), ["page_id"]).count() == 0


def test_media_of_broken_html_takes_no_long():
    import time

    begin = time.perf_counter()
    for broken in ('<a "', "<a ", "<!--", "<img src='", "<!x", "<a '\"", "<"):
        media.parse_items(broken * 20000)
    assert time.perf_counter() - begin < 5


def test_interleaved_page(spark):
    page = '<h1>t</h1><p>one <b>two</b><img src="sha256:x" alt="a<b">three<figure><img src="sha256:y"><img src="sha256:x"><figcaption>c &amp; d</figcaption></figure><p>end'
    rows = [(r["position"], r["kind"], r["text"], r["digest"], r["caption"]) for r in media.interleave(spark.createDataFrame([(1, page)], "page_id int, html string"), ["page_id"]).collect()]
    assert rows == [(0, "text", "t", None, None), (1, "text", "one two", None, None), (2, "media", None, "x", None), (3, "text", "three", None, None), (4, "media", None, "y", "c & d"), (5, "media", None, "x", "c & d"), (6, "text", "end", None, None)]


def test_html(spark):
    page = "<nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>The  text\n of it all is here</p></article><div class=comments><p>I like it very much indeed</p></div><footer>(c) me</footer>"
    pages = spark.createDataFrame([(1, page, "old"), (2, None, "old"), (3, "<p <<", "old")], "page_id int, html string, text string")
    rows = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert rows[1] == "Title & more\n\nThe text of it all is here"
    assert rows[2] == "" and len(rows) == 3
