"""Sequences of the given pages with several media each, beside the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import functions as F

from ridgeline.llm import media
from ridgeline.sources.tables import table


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "img":
            self.items.append(("media", dict(attrs).get("src", "").removeprefix("sha256:")))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.items += [("word", w) for w in data.split()]


def test_pages_with_media_between_their_blocks(spark, sf_dir):
    """Pages of the table with an image before each paragraph, of which some share one: places, captions and payloads stay in order."""
    rows = table(spark, sf_dir, "pages").select("page_id", "html").limit(60).collect()
    pages = []
    for r in rows:
        parts = (r["html"] or "").split("<p")
        pages.append((r["page_id"], parts[0] + "".join(f'<img src="sha256:{(r["page_id"] * 7 + k) % 11}"><p{x}' for k, x in enumerate(parts[1:]))))
    items = media.interleave(spark.createDataFrame(pages, "page_id long, html string"), ["page_id"])
    known = spark.createDataFrame([(str(k), bytearray(b"P5\n192 1\n255\n" + bytes([65 + k]) * 192), 1) for k in range(10)], "digest string, media binary, copies long")
    got = {}
    for r in media.resolve(items, known, "copies", items.count()).orderBy("page_id", "position").collect():
        got.setdefault(r["page_id"], []).append(r)
    several = 0
    for page, html in pages:
        own = got.get(page, [])
        assert [r["position"] for r in own] == list(range(len(own)))
        plain = Plain()
        plain.feed(html)
        plain.close()
        assert [r["digest"] for r in own if r["kind"] == "media"] == [x for kind, x in plain.items if kind == "media"]
        assert all((r["media"] is None) == (r["digest"] == "10") for r in own if r["kind"] == "media")
        several += sum(r["kind"] == "media" for r in own) > 2
    assert several > 10


def test_deep_nesting_takes_no_long():
    import time

    begin = time.perf_counter()
    for part in ("<div>x ", "<figure><img src=a>", "<b>", "<figure><figcaption>"):
        media.parse_items(part * 50_000)
    assert time.perf_counter() - begin < 20


def test_repeated_rows_keep_their_sequences(spark):
    page = '<p>a</p><img src="sha256:x"><p>b</p><img src="sha256:y"><figure><img src="sha256:x"><figcaption>c</figcaption></figure>'
    items = media.interleave(spark.createDataFrame([(1, page), (1, page), (2, "")], "page_id int, html string"), ["page_id"])
    assert items.groupBy("page_id", "position", "kind", "digest", "caption").count().where(F.col("count") != 2).isEmpty() and items.count() == 10
