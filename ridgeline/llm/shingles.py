"""Hashed word shingles of whole texts, shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes per numpy pass, about.
CHUNK = 1 << 20
SEED = 5
U = np.uint64

_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
BLANK = (_byte == 32) | ((_byte >= 9) & (_byte <= 13))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, and a random number per byte."""

    def __init__(self) -> None:
        self.base = 0x2545F4914F6CDD1D
        self.inverse = pow(self.base, -1, 1 << 64)
        self.of_byte = np.random.default_rng(SEED).integers(0, 1 << 64, 256, U)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * CHUNK)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (self.base, self.inverse))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """s such that (s[j] - s[i]) * down[i] depends on data[i:j] alone."""
        self.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, U)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], out=out[1:])
        return out


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about limit bytes together."""
    begin = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def shingle_sets(texts: list[str], size: int, powers: Powers) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of size words; of all words if there are fewer; empty if none.

    A-Z are lower-cased; blanks and the control characters 9 to 13 part words.
    """
    data = [x.encode("utf-8", "replace") for x in texts]
    for begin, end in chunks([len(x) for x in data]):
        own = data[begin:end]
        raw = LOWER[np.frombuffer(b" " + b" ".join(own) + b" ", np.uint8)]
        blank = BLANK[raw]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        s = powers.prefix(raw)
        words = mix((s[ends] - s[starts]) * powers.down[starts] + (ends - starts).astype(U))
        at = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in own)]))
        n = len(words) - size + 1
        runs = np.full(max(n, 0), size, U)
        for k in range(size):
            runs = mix(runs + words[k : k + max(n, 0)])
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= size:
                h = np.sort(runs[a : b - size + 1])
            else:
                h = np.full(min(1, b - a), b - a, U)
                for k in range(a, b):
                    h = mix(h + words[k : k + 1])
            yield h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
