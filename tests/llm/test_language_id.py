"""Short texts and the bounds of texts."""

from __future__ import annotations

from ridgeline.llm import language_id

SHORT = ["a", "ab", "A.", "a b", "é", "\u0000a", "1x2", "abc", "字"]


def test_short_texts_have_a_language(spark):
    rows = [(1, "the cat and the dog are in a house", "en"), (2, "der Hund und die Katze sind ein Paar", "de")]
    names, bundles = language_id.prototypes(spark.createDataFrame(rows, "id long, text string, lang string"))
    docs = spark.createDataFrame([*enumerate(SHORT), (90, "1."), (91, " "), (92, None)], "id long, text string")
    found = {r["id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, names, bundles).collect()}
    assert all(found[i][0] in ("de", "en") for i in range(len(SHORT)))
    assert found[0][0] == "en" and found[0][1] > 0
    assert all(found[i] == ("und", 0.0) for i in (90, 91, 92))


def test_codes_do_not_hang_on_the_place():
    encoder = language_id.Encoder()
    texts = ['"quoted" text', "1st of all", "a", "plain words.", "...", "", "ends (so)", *SHORT]

    def brute(x: str) -> dict[int, int]:
        out: dict[int, int] = {}
        letters = [int(encoder.letters[ord(c)]) for c in f" {x} ".lower()]
        letters = [c for k, c in enumerate(letters) if c or k == 0 or letters[k - 1]]
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
            if b:
                out[a << 16 | b << 8 | c] = out.get(a << 16 | b << 8 | c, 0) + 1
        return out

    for own in (texts, texts[::-1]):
        which, grams, counts = encoder.codes(own)
        for i, x in enumerate(own):
            assert {int(g): int(n) for w, g, n in zip(which, grams, counts, strict=True) if w == i} == brute(x)
    which, grams, counts = encoder.codes(texts[:7])  # none holds the separator
    for i, x in enumerate(texts[:7]):
        assert {int(g): int(n) for w, g, n in zip(which, grams, counts, strict=True) if w == i} == brute(x)


def test_query_beside_vectors_bound_and_bundled_one_by_one(spark, sf_dir):
    import zlib

    import numpy as np

    from ridgeline.llm import queries
    from ridgeline.sources.tables import table

    encoder = language_id.Encoder()
    base = encoder.turned[-1]  # the last place is not rotated
    rows = sorted(map(tuple, table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()))

    def bundle(text: str | None) -> np.ndarray:
        """Each n-gram's letters, rotated by their place and multiplied; all added."""
        letters = [int(encoder.letters[ord(c)]) for c in f" {text or ''} ".replace("\0", " ").lower()]
        letters = [c for k, c in enumerate(letters) if c or k == 0 or letters[k - 1]]
        grams: dict[tuple, int] = {}
        for g in zip(letters, letters[1:], letters[2:], strict=False):
            if g[1]:
                grams[g] = grams.get(g, 0) + 1
        out = np.zeros(language_id.DIMENSIONS)
        for (a, b, c), n in grams.items():
            out += n * (np.roll(base[a], 2).astype(int) * np.roll(base[b], 1) * base[c])
        return out

    own = {i: bundle(t) for i, t, _ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    names = sorted({x for i, _, x in rows if x is not None and not held[i]})
    whole = np.array([sum((own[i] for i, t, x in rows if x == name and t is not None and not held[i]), np.zeros(language_id.DIMENSIONS)) for name in names])
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, v in own.items():
        assert got[i]["held_out"] == held[i]
        if not v.any():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        near = whole @ v / np.linalg.norm(v)
        assert abs(got[i]["score"] - min(1, max(0, near.max()))) < 1e-4
        assert got[i]["lang_pred"] == names[int(near.argmax())] or np.sort(near)[-1] - np.sort(near)[-2] < 1e-4


def test_repeated_rows_and_ties(spark):
    rows = [(1, "eins zwei drei", "b"), (1, "eins zwei drei", "b"), (2, "eins zwei drei", "a")]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    names, bundles = language_id.prototypes(docs)
    found = language_id.identify(docs, names, bundles).collect()
    assert len(found) == 3 and {r["lang_pred"] for r in found} == {"a"} and len({r["score"] for r in found}) == 1
