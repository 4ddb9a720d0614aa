"""The local search of the packing on lengths without short pieces."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from ridgeline.llm import packing


def _packed(count: int, seed: int, capacity: int = 2048) -> tuple[list[int], list[list[int]], int]:
    lengths = np.random.default_rng(seed).integers(300, 1201, count)
    bins = packing.empty_bins(packing.best_fit(lengths, capacity), lengths, capacity)
    size = lengths.tolist()
    assert sorted(i for b in bins for i in b) == list(range(count))
    assert all(sum(size[i] for i in b) <= capacity for b in bins)
    return size, bins, -(-sum(size) // capacity)


def test_many_underfull_bins():
    size, bins, fewest = _packed(2048, 1)
    assert len(bins) <= fewest + 3  # 771 against 760 by best fit alone


@pytest.mark.parametrize("seed", range(8))
def test_ends_where_no_exchange_is_left(seed):
    size, bins, fewest = _packed(90, seed)
    if len(bins) == fewest:
        return
    fill = [sum(size[i] for i in b) for b in bins]
    for a, source in enumerate(bins):
        for b, other in enumerate(bins):
            backs = {0, *(size[j] for j in other), *(size[j] + size[k] for j, k in combinations(other, 2))}
            for i in source:
                assert a == b or fill[a] == 2048 or not any(back < size[i] and fill[a] < fill[b] + size[i] - back <= 2048 for back in backs)


def test_groups_meet_again(spark):
    """Several groups lose no more bins than one does, and every piece has its place."""
    rng = np.random.default_rng(3)
    lengths = [*rng.integers(1, 400, 3000).tolist(), *[700] * 200, *[2048] * 50]
    pieces = spark.createDataFrame([(i % 900, i, 0, int(n), i % 7) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = {}
    for group in (200, 1 << 20):
        rows = packing.pack(pieces, 2048, group).collect()
        assert sorted(r["piece"] for r in rows) == list(range(len(lengths)))
        bins: dict[int, list] = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        found[group] = len(bins)
    fewest = -(-sum(lengths) // 2048)
    assert found[1 << 20] == fewest and found[200] <= fewest + 1


def test_words_give_the_ids_of_the_whole_text():
    import struct

    from ridgeline.llm.queries import tokenizer_path

    words = packing.Words(tokenizer_path())
    signs = np.array(list("abAB'sS.,;:!?<|>-0 1\n\tzéÉİ中_"))
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(signs, rng.integers(0, 15))) for _ in range(3000)]
    texts += ["", "<|startoftext|> a", "<|STARTOFTEXT|> A.", "Don't, STOP!", "éA"]
    for text in texts:
        ids = words.parts.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text
