"""Queries over the text tables, each a thin use of its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, html_text, language_id, line_dedup, media, near_dedup, packing, pieces, prefix_trie, quality, repeats, url_filter, variants
from ridgeline.sources.scratch import materialize
from ridgeline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=True)
    # a removed run may end within a character: what is left of it becomes U+FFFD in text, kept_sha256 has the bytes
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated", text)


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text_key")


ORACLE_SQL["op3_decontamination"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS MATERIALIZED (SELECT item_id, len(w) AS l, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS c FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b) GROUP BY ALL),
ds AS MATERIALIZED (SELECT doc_id, len(w) AS n, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
win AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, l, n, least(i, greatest(n - l, 0) + 1) AS a FROM ds JOIN bs USING (s)),
cnt AS (SELECT win.doc_id, win.item_id, l, win.n, a, ds.s, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.i BETWEEN a AND a + l - 5 GROUP BY ALL),
sim AS (SELECT cnt.doc_id, cnt.item_id, cnt.l, a, sum(least(cnt.c, coalesce(bs.c, 0)))::DOUBLE AS shared, sum(cnt.c)::DOUBLE AS own FROM cnt LEFT JOIN bs ON bs.item_id = cnt.item_id AND bs.s = cnt.s GROUP BY ALL),
ok AS (SELECT doc_id, item_id, l, a, shared / (own + l - 4 - shared) AS j FROM sim WHERE shared / (own + l - 4 - shared) >= 0.75),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY j DESC, a) AS k FROM ok)
SELECT doc_id, item_id, round(j, 6) AS similarity, (a - 1)::INT AS start, l::INT AS length FROM r WHERE k = 1
"""


@_query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL["op4_line_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM d),
h AS (SELECT *, md5(line) AS m, lag(md5(line)) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l),
b AS (SELECT *, (i = n OR (i >= 2 AND substr(md5(p || m), 1, 1) < '4'))::INT AS cut FROM h),
c AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
k AS (SELECT doc_id, chunk, count(*) AS len, min(i) AS start, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, chunk),
r AS (SELECT *, row_number() OVER (PARTITION BY body, len >= 2 ORDER BY doc_id, start) AS nth FROM k),
g AS (SELECT *, (len >= 2 AND nth > 1) AS gone FROM r)
SELECT doc_id, sum(len)::BIGINT AS n_lines, coalesce(sum(len) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  count(*) FILTER (gone)::BIGINT AS n_removed_chunks,
  sha256(coalesce(string_agg(body, chr(10) ORDER BY start) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""

#: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@_query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.apply_rules(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op5_url_filter"] = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS n
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""

SEQUENCE = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.cut_pieces(docs, tokenizer_path(), SEQUENCE).drop("ids"), SEQUENCE)


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    names, bundles = language_id.prototypes(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), names, bundles)


#: Grades: 0 toxic, 1 poor, 2 good.
GRADES, GOOD = 3, 2


def graded(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2).alias("grade"))


def graded_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with expected_grade, tail_probability and kept: whether grade GOOD is as likely as not."""
    model = quality.train(docs, graded(labels), GRADES)
    return quality.score(docs, model, GOOD).withColumn("kept", F.col("tail_probability") >= 0.5)


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return graded_documents(docs, table(spark, sf_dir, "labels")).drop("text")


def page_of(text: F.Column, digest: F.Column, caption: F.Column) -> F.Column:
    """A page of a document's text around its figure: the figure stands after the first half of the lines."""
    escaped = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(escaped, "\n", -1)
    half = F.floor((F.size(lines) + 1) / 2).cast("int")
    part = lambda x: F.concat(F.lit("<p>"), F.array_join(x, "\n"), F.lit("</p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), F.coalesce(caption, F.lit("")), F.lit("</figcaption></figure>"))
    return F.concat(part(F.slice(lines, 1, half)), figure, part(F.slice(lines, half + 1, F.size(lines))))


@_query
def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page of its text around the image that stores its payload; the row is that image's."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    stored = media.media_table(docs.select(media.payload(text).alias("payload")))
    described = materialize(media.described_media(stored, ["media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]), "described-media")
    pages = docs.select("doc_id", F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), page_of(text, F.sha2(media.payload(text), 256), F.col("doc_id").cast("string")).alias("html"))
    items = materialize(media.interleave(pages, ["doc_id", "n_bytes"]).where("kind = 'media'").drop("kind", "text"), "media-items")
    return media.resolve(items, described, "copies", items.count()).drop("digest")


@_query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.round_trip(docs, pieces_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


#: crc32 of a list of bytes.
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295, {0}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.variants(variants.vocabulary(variants.typed_words(docs)))


ORACLE_SQL["op11_spelling_variants"] = r"""
WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
h AS MATERIALIZED (SELECT w, n, CRC AS h FROM r),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.cut = w.word UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.cut = w.word),
b AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b ON b.word = w.word AND k = 1),
t AS (SELECT word, word AS at FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f e ON e.word = t.at AND e.form IS NULL
""".replace("CRC", CRC32_SQL.format("flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))"))


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations").withColumn("conv_id", F.col("conv_id").cast("long")))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    return prefix_trie.prefix_trie(*prefix_trie.grafted(turns, convs, F.col("conv_id") - F.col("conv_id") % 20, head, 3))


ORACLE_SQL["op13_prefix_trie"] = r"""
WITH c AS MATERIALIZED (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, CRC % 4 AS h FROM c),
r AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(b.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS MATERIALIZED (SELECT conv_id, d, len(t) = d AS ended, md5(to_json(t[1:d])::VARCHAR) AS p, CASE WHEN d > 0 THEN md5(to_json(t[1:d - 1])::VARCHAR) END AS up,
  CASE WHEN d > 0 THEN len(regexp_extract_all(t[d].t, '[^ 	-
]+')) ELSE 0 END AS w FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT d, p, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n, bool_and(ended) AS leaf,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends FROM m GROUP BY d, p),
s AS (SELECT m.d, m.p, count(*) FILTER (n.leaf) AS n_leaves, sum((n.n - 1) * n.w) AS saved, count(*) FILTER (n.d = m.d + 1) AS n_children FROM n JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.d, m.p)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, s.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.p = n.p LEFT JOIN n u ON u.d = n.d - 1 AND u.p = n.up
""".replace("CRC", CRC32_SQL.format("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
