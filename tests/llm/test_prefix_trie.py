"""The trie beside one built turn by turn, odd input, deep shared prefixes and hot conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    return {c: (own.get(c - c % 20) or [])[: (h := zlib.crc32(str(c).encode()) % 4)] + t[h:] for c, t in own.items()}


def _want(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    rows = {p: [min(m), len(p), min(members[p[:-1]]) if p else None, len(m), 0, 0, 0, hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest()] for p, m in members.items()}
    inner = {p[:-1] for p in members if p}
    for p, m in members.items():
        if p:
            rows[p[:-1]][4] += 1
        for d in range(len(p) + 1):
            rows[p[:d]][5] += p not in inner
            rows[p[:d]][6] += (len(m) - 1) * words(p)
    return sorted(map(tuple, rows.values()), key=str)


def _trie(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long, label string")
    turns, convs = prefix_trie.ordered_turns(table)
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    out = prefix_trie.prefix_trie(*prefix_trie.grafted(turns, convs, F.col("conv_id") - F.col("conv_id") % 20, head, 3))
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_beside_brute_force(spark, seed):
    pick = random.Random(seed)
    rows = []
    for c in range(70):
        if seed == 1 or c % 20:  # without them conversations have no base
            for t in range(pick.randint(1, 7)):
                text = pick.choice(["a b", "a\tb c", "", None, "one  two three", "é x"])
                rows.append((c, t if pick.random() < 0.9 else None, pick.choice(["user", "assistant", None, ""]), text, 1, "x"))
    rows += [rows[3], rows[3]]  # repeated rows
    assert _trie(spark, rows) == _want(_rebuilt(rows))


def test_deep_shared_prefixes_and_copies(spark):
    long = [("user", f"turn {k}") for k in range(130)]
    rows = [(c, k, *x, 1, "x") for c in (20, 40, 60, 80) for k, x in enumerate(long[: 130 - 20 * (c == 80)])]
    rows += [(100, k, *x, 1, "x") for k, x in enumerate([*long[:77], ("user", "other"), *long[78:]])]
    assert _trie(spark, rows) == _want(_rebuilt(rows))


def test_hot_keys_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr("ridgeline.operators.skew.FLOOR", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(20 * c, k, "user", f"same {k}", 1, "x") for c in range(30) for k in range(3)] + [(7, k, "user", f"own {k}", 1, "x") for k in range(90)]
    assert _trie(spark, rows) == _want(_rebuilt(rows))


def test_small_tables(spark):
    for rows in ([], [(None, 1, "user", "x", 1, "x")], [(5, 0, "user", "a b", 1, "x")], [(20, 0, None, None, 1, "x"), (None, None, None, None, 1, "x")], [(1, 0, "u", "x", 1, "x"), (2, 0, "u", "x", 1, "x"), (3, 0, "u", "x", 1, "x")]):
        convs = _rebuilt(rows)
        assert _trie(spark, rows) == (_want(convs) if convs else [])
