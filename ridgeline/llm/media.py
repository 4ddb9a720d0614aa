"""Interleaved text and media sequences, with payloads resolved by digest.

HTML becomes an ordered list of text and media items; an image keeps its place, its caption (the figure's)
and the digest its source names. Media are stored once per digest as binary grey images (PGM, one 8-bit
sample a byte) and joined by digest; a place whose digest is not stored keeps null media.

Defined results: null html has no items; null payloads count as empty; equal payloads have one digest, so
one stored form. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.html_text import TOKEN
from ridgeline.operators.skew import split_join

ROW = 192
SOURCE = re.compile(r"\bsrc\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr br article section figure blockquote".split())
ITEM = "array<struct<kind:string,text:string,digest:string,caption:string>>"


def parse_items(html: str | None) -> list[dict]:
    """Text and media in page order; a figcaption belongs to the media of its figure."""
    items: list[dict] = []
    words: list[str] = []
    caption, figure_from, skipped = None, 0, None

    def flush() -> None:
        text = " ".join(unescape("".join(words)).split())
        words.clear()
        if text:
            items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    for m in TOKEN.finditer(html or ""):
        closing, tag, attributes, text = m.groups()
        if text is not None:
            if skipped is None:
                (words if caption is None else caption).append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if skipped:
            skipped = None if closing and tag == skipped else skipped
        elif tag in ("script", "style"):
            skipped = None if closing else tag
        elif tag == "figcaption" and not closing:
            caption = []
        elif tag == "figcaption":
            said = " ".join(unescape("".join(caption or [])).split())
            caption = None
            for item in items[figure_from:]:
                if item["kind"] == "media":
                    item["caption"] = said
        elif tag == "img":
            flush()
            source = SOURCE.search(attributes)
            name = unescape(next((x for x in source.groups() if x is not None), "")) if source else ""
            items.append({"kind": "media", "text": None, "digest": name.removeprefix("sha256:"), "caption": None})
        elif tag in BREAKS:
            flush()
            if tag == "figure" and not closing:
                figure_from = len(items)
        else:
            words.append(" ")
    flush()
    return items


def interleave(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, position, kind, text, digest, caption): one row per item."""

    @F.pandas_udf(ITEM)
    def items(texts: pd.Series) -> pd.Series:
        return texts.map(parse_items)

    parsed = pages.select(*keys, items(F.col(html)).alias("_items"))
    return parsed.select(*keys, F.posexplode("_items").alias("position", "_item")).select(*keys, "position", "_item.*")


def payload(text: Column) -> Column:
    """The UTF-8 bytes, filled with blanks to a positive multiple of ROW."""
    text = F.coalesce(text, F.lit(""))
    n = F.octet_length(text)
    full = F.greatest(F.ceil(n / F.lit(ROW)), F.lit(1)) * F.lit(ROW)
    return F.concat(text.cast("binary"), F.repeat(F.lit(" "), (full - n).cast("int")).cast("binary"))


def store(payloads: Column) -> Column:
    """A binary PGM image of ROW columns."""
    rows = (F.octet_length(payloads) / F.lit(ROW)).cast("int").cast("string")
    return F.concat(F.concat(F.lit(f"P5\n{ROW} "), rows, F.lit("\n255\n")).cast("binary"), payloads)


def samples(stored: bytes) -> np.ndarray:
    """The image's samples, by its header."""
    magic, columns, rows, most = stored.split(maxsplit=4)[:4]
    if magic != b"P5" or int(most) != 255:
        raise ValueError("not an 8-bit binary grey image")
    n = int(columns) * int(rows)
    return np.frombuffer(stored, np.uint8, n, len(stored) - n)


def describe(media: DataFrame, column: str = "media") -> DataFrame:
    """media with payload_bytes, payload_sha256, tail_crc32 and feature of the samples read back."""

    def one(stored: bytes | None) -> tuple:
        if stored is None:
            return None, None, None, None
        x = samples(stored)
        share = np.bincount(x, minlength=256) / len(x)
        entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
        mean = x.mean()
        edges = np.abs(np.diff(x.astype(np.int16))).mean()
        feature = f"mean={mean:.4f};deviation={x.std():.4f};entropy={entropy:.4f};edges={edges:.4f};rows={len(x) // ROW}"
        return len(x), hashlib.sha256(x.tobytes()).hexdigest(), zlib.crc32(x[-16:].tobytes()), feature

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature"]
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"

    @F.pandas_udf(schema)
    def features(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([one(x) for x in part], columns=names)

    return media.drop(*names).withColumn("_features", features(F.col(column))).select("*", "_features.*").drop("_features")


def media_table(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(digest, media): the stored form of each distinct payload."""
    return payloads.select(F.sha2(F.col(column), 256).alias("digest"), store(F.col(column)).alias("media"))


def described_media(stored: DataFrame, columns: list[str]) -> DataFrame:
    """(digest, copies, columns) of stored media (digest, media), each distinct digest described once."""
    once = stored.groupBy("digest").agg(F.min("media").alias("media"), F.count(F.lit(1)).alias("copies"))
    own = once.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return describe(own).select("digest", "copies", *columns)


def resolve(items: DataFrame, media: DataFrame, rows: str | None = None, total: int = 0) -> DataFrame:
    """items with media, by digest; media has one row per digest.

    rows names a column of media with the number of items of that digest, total their sum: with them, digests that
    hold a large share of all items are joined where these lie.
    """
    if rows is None:
        return items.join(media, "digest", "left")
    return split_join(items, media, ["digest"], rows, total, "left")
