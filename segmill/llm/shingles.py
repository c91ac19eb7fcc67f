"""Sets of word shingles as sorted 64-bit hashes, for many texts at a time."""

from __future__ import annotations

import numpy as np

#: Odd multipliers, made from the golden ratio; the first is the base of the byte polynomial.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Texts are hashed together up to this many bytes.
CHUNK = 1 << 19

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse, kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE))
    return _powers


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start])


def _chunk_sets(parts: list[bytes], k: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    word = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    words = span_hashes(data, start, end)
    first = np.searchsorted(start, bounds)
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(words) - k + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        runs += words[j : j + n] * factors[j]
    runs = mixed(runs)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:  # the whole sequence as one, told apart by its length
            out.append(mixed(np.array([np.sum(words[a:b] * factors[: b - a]) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    A-Z are lower-cased, words are runs without ASCII white space. With fewer words than
    ``k`` the whole sequence is the one shingle; a null text or one without words has none.
    """
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        if part and size + len(b) > CHUNK:
            out += _chunk_sets(part, k)
            part, size = [], 0
        part.append(b)
        size += len(b) + 1
    return out + (_chunk_sets(part, k) if part else [])
