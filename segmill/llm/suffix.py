"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` classifies suffixes as smaller (S) or larger (L) than their right
neighbour, sorts the leftmost-S substrings by induction, names them, sorts the shorter
text of names recursively, and induces the whole array from it. Over bytes the
induction runs a bucket at a time in numpy: what a finished bucket induces is dealt
stably to the buckets it belongs to. Over names, whose alphabet is large, it runs an
entry at a time.
"""

from __future__ import annotations

import numpy as np

_BYTES = 256


def smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one to its right; the end is smallest of all."""
    n = len(text)
    kind = np.zeros(n, bool)
    if n < 2:
        return kind
    less, differs = text[:-1] < text[1:], text[:-1] != text[1:]
    # A position within a run of equal symbols is of the kind of the run's last one.
    at = np.where(differs, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    kind[:-1] = np.append(less, False)[at]
    return kind


def _deal(spots: np.ndarray, symbols: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append ``spots`` to the lists of their symbols, in order."""
    if not len(spots):
        return
    order = np.argsort(symbols, kind="stable")
    spots, symbols = spots[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part, c in zip(np.split(spots, cuts), symbols[np.append(0, cuts)]):
        into[c].append(part)


def _chain(first: list[np.ndarray], text: np.ndarray, kind: np.ndarray, c: int, want: bool) -> np.ndarray:
    """A bucket's induced entries in order: those dealt to it, and then those that they induce in the same bucket."""
    rounds = []
    q = np.concatenate(first) if first else np.zeros(0, np.int64)
    while len(q):
        rounds.append(q)
        j = q[q > 0] - 1
        q = j[(text[j] == c) & (kind[j] == want)]
    return np.concatenate(rounds) if rounds else np.zeros(0, np.int64)


def _induce_bytes(text: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes (or the leftmost-S substrings) in order, given the leftmost-S positions in order within each bucket."""
    tails: list[list[np.ndarray]] = [[] for _ in range(_BYTES)]
    _deal(lms, text[lms], tails)
    dealt: list[list[np.ndarray]] = [[] for _ in range(_BYTES)]
    dealt[text[-1]].append(np.array([len(text) - 1]))  # induced by the end
    larger = []
    for c in range(_BYTES):
        own = _chain(dealt[c], text, kind, c, False)
        larger.append(own)
        j = np.concatenate([own, *tails[c]])
        j = j[j > 0] - 1
        j = j[~kind[j] & (text[j] > c)]
        _deal(j, text[j], dealt)
        dealt[c] = []
    dealt = [[] for _ in range(_BYTES)]
    out = []
    for c in range(_BYTES - 1, -1, -1):
        own = _chain(dealt[c], text, kind, c, True)
        back = np.concatenate([own, larger[c][::-1]])
        out.append(back)
        j = back[back > 0] - 1
        j = j[kind[j] & (text[j] < c)]
        _deal(j, text[j], dealt)
        dealt[c] = []
    return np.concatenate(out)[::-1]


def _induce_names(text: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As ``_induce_bytes`` for any alphabet, an entry at a time."""
    counts = np.bincount(text)
    ends = np.cumsum(counts)
    n = len(text)
    array = np.full(n, n, np.int64)  # n stands for an empty entry
    symbols = text[lms]
    order = np.argsort(symbols, kind="stable")
    spots = lms[order]
    if len(spots):
        first = np.flatnonzero(np.append(True, np.diff(symbols[order]) != 0))
        size = np.diff(np.append(first, len(spots)))
        rank = np.arange(len(spots)) - np.repeat(first, size)
        array[ends[text[spots]] - np.repeat(size, size) + rank] = spots
    # For each entry the bucket that it induces into, or -1: of the suffix to its left, by that one's kind.
    left = np.append(-1, text[:-1])
    larger = np.append(np.where(np.append(True, kind[:-1]), -1, left), -1).tolist()
    less = np.append(np.where(np.append(False, kind[:-1]), left, -1), -1).tolist()
    sa = array.tolist()
    heads, tails = (ends - counts).tolist(), ends.tolist()
    c = int(text[-1])
    sa[heads[c]] = n - 1
    heads[c] += 1
    for j in sa:  # entries appear ahead of the scan
        c = larger[j]
        if c >= 0:
            h = heads[c]
            sa[h] = j - 1
            heads[c] = h + 1
    # The scan back puts every S suffix anew, the leftmost ones too.
    for j in reversed(sa):
        c = less[j]
        if c >= 0:
            h = tails[c] = tails[c] - 1
            sa[h] = j - 1
    return np.array(sa, np.int64)


def suffix_array(text: np.ndarray, level: int = 0) -> np.ndarray:
    """Start positions of all suffixes of a non-negative integer array in lexicographic order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    induce = _induce_bytes if level == 0 else _induce_names
    if level == 0:
        text = np.asarray(text, np.uint8)
    kind = smaller(text)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    if len(lms) < 2:
        return induce(text, kind, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found = induce(text, kind, lms)
    found = found[is_lms[found]]
    # Equal neighbours in the sorted substrings share a name; a substring runs up to the next leftmost-S position.
    end = np.append(lms[1:], n - 1)
    length = end - lms + 1
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    k = index[found]
    a, b = found[:-1], found[1:]
    same = (length[k[:-1]] == length[k[1:]]) & (b != lms[-1]) & (a != lms[-1])
    live = np.flatnonzero(same)
    at = 0
    most = length[k[1:]]
    while len(live):
        live = live[most[live] > at]
        bad = text[a[live] + at] != text[b[live] + at]
        same[live[bad]] = False
        live = live[~bad]
        at += 1
    names = np.zeros(len(lms), np.int64)
    names[k] = np.cumsum(np.append(0, ~same))
    if names.max() + 1 == len(lms):
        order = np.argsort(names, kind="stable")
    else:
        order = suffix_array(names, level + 1)
    return induce(text, kind, lms[order])


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, length): for each position the suffix before its own in ``array``, -1 for the first, and their common prefix, right up to ``cap``.

    Where the symbols to the left of the two agree, the prefix is one shorter than that
    of the position to the left; only the others are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[: n + cap + 8].view(np.uint8), (n + cap + 1, 8), (1, 1))
    own = np.arange(n)
    reducible = np.zeros(n, bool)
    inner = (own > 0) & (before > 0)
    reducible[inner] = text[own[inner] - 1] == text[before[inner] - 1]
    start = np.flatnonzero(~reducible & (before >= 0))
    length = np.zeros(n, np.int64)
    live, at = start, 0
    while len(live) and at < cap:
        left, right = words[live + at], words[before[live] + at]
        differs = left != right
        stop = differs.any(axis=1)
        length[live[stop]] = at + differs[stop].argmax(axis=1)
        live = live[~stop]
        at += 8
    length[live] = cap
    room = n - np.maximum(own, before)
    length = np.minimum(length, np.maximum(room, 0))
    last = np.maximum.accumulate(np.where(reducible, -1, own))
    known = np.where(before >= 0, length[last] - (own - last), 0)
    return before, np.maximum(known, 0)
