"""Plain single-machine forms of operators that SQL cannot express."""

from __future__ import annotations

import re


def near_classes(rows: list[tuple], percent: int = 75) -> dict:
    """doc_id -> (n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = {}
    for doc_id, text in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    common: dict = {}
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def stripped(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, bytes]]:
    """(n_bytes, n_removed, n_spans, rest) of each text, from the places of all strings of ``length`` bytes."""
    raw = [(t or "").encode() for t in texts]
    places: dict = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            places.setdefault(hash(b[i : i + length]), []).append((d, i))
    gone = [bytearray(len(b)) for b in raw]
    for ps in places.values():
        if len(ps) > 1:
            for d, i in ps:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for b, g in zip(raw, gone):
        spans = len(re.findall(b"\1+", bytes(g)))
        out.append((len(b), sum(g), spans, bytes(x for x, y in zip(b, g) if not y)))
    return out
