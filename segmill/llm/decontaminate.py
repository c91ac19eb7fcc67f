"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case, every run of other than letters and digits
one space). An item of length n may occur with up to ``RATE * n`` edits: cut into one
piece more than that, at least one piece occurs unchanged. An Aho-Corasick automaton
finds all pieces in one pass over a text; around each hit, Myers' bit-parallel
algorithm gives the least edit distance of the item to any substring.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Edits for each character of an item.
RATE = 0.08
#: Items with fewer normalised characters are searched exactly, at word boundaries.
MIN_CHARS = 32
#: Such items of fewer words are common phrases, no evidence, and are not searched; ``unsearched`` gives them.
MIN_WORDS = 4
#: Characters of items searched at a time; a larger benchmark is searched in blocks.
BLOCK_CHARS = 4_000_000
#: Rows in work at a time.
SLICE = 500

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(n: int, rate: float = RATE) -> tuple[int, list[tuple[int, int]]]:
    """(error budget, spans of the budget-plus-one pieces) of an item of ``n`` characters."""
    budget = int(n * rate)
    cuts = [n * i // (budget + 1) for i in range(budget + 2)]
    return budget, list(zip(cuts, cuts[1:]))


def least_distance(item: str, text: str, masks: dict[str, int] | None = None) -> int:
    """The least edit distance of ``item`` to any substring of ``text``: Myers' bit vectors, one integer a column."""
    masks = masks if masks is not None else item_masks(item)
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score = full, 0, n
    best = n
    for c in text:
        eq = masks.get(c, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = vn | (~(d0 | vp) & full), d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best = score
        hp, hn = (hp << 1) & full, (hn << 1) & full  # a match may start anywhere: no carry comes in
        vp, vn = hn | (~(d0 | hp) & full), d0 & hp
    return best


def item_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Searcher:
    """Finds a block of items in texts; those in ``exact`` without edits and as whole words."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, exact: list[tuple[int, str]] = ()):
        self.items = items
        ids: dict[str, list[int]] = {}
        for item_id, t in exact:
            ids.setdefault(f" {t} ", []).append(item_id)
        self.words = ahocorasick.Automaton()
        for t, found in ids.items():
            self.words.add_word(t, found)
        if ids:
            self.words.make_automaton()
        self.exact = bool(ids)
        self.plan = [pieces(len(t), rate) for _, t in items]
        self.masks = [item_masks(t) for _, t in items]
        where: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, t) in enumerate(items):
            for a, b in self.plan[k][1]:
                where.setdefault(t[a:b], []).append((k, a, b))
        self.automaton = ahocorasick.Automaton()
        for piece, spots in where.items():
            self.automaton.add_word(piece, spots)
        if where:
            self.automaton.make_automaton()
        self.some = bool(where)

    def search(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of every item within its budget somewhere in the text."""
        t = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for end, spots in self.automaton.iter(t) if self.some else ():
            for k, a, b in spots:
                budget, n = self.plan[k][0], len(self.items[k][1])
                start = end + 1 - b  # where the item would start without edits
                low, high = max(0, start - budget), start + n + budget
                mine = windows.setdefault(k, [])
                if mine and low <= mine[-1][1] and low >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], high)
                else:
                    mine.append([low, high])
        found = [(i, 0) for i in {i for _, ids in self.words.iter(f" {t} ") for i in ids}] if self.exact else []
        for k, mine in windows.items():
            item_id, item = self.items[k]
            budget = self.plan[k][0]
            best = budget + 1
            for low, high in mine:
                part = t[low:high]
                if len(part) < len(item) - budget:
                    continue
                best = min(best, 0 if item in part else least_distance(item, part, self.masks[k]))
                if best == 0:
                    break
            if best <= budget:
                found.append((item_id, best))
        return found


def _too_short(t: str) -> bool:
    return len(t) < MIN_CHARS and t.count(" ") + 1 < MIN_WORDS


def _parted(items: list[tuple[int, str]], rate: float) -> tuple:
    return [x for x in items if len(x[1]) >= MIN_CHARS], rate, [x for x in items if len(x[1]) < MIN_CHARS]


_searchers: dict = {}


def _searcher(block: tuple, rate: float) -> Searcher:
    """The searcher of a block of items, built once in a worker; blocks are told apart by a name of their own."""
    name, shared = block
    if (name, rate) not in _searchers:
        _searchers.clear()
        _searchers[name, rate] = Searcher(*_parted(shared.value, rate))
    return _searchers[name, rate]


def _blocks(benchmark: DataFrame, block_chars: int) -> list[tuple]:
    """(name, broadcast) of blocks of the distinct normalised items, each of about ``block_chars`` characters at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    out = []
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        mine = sorted({(r.item_id, t) for r in rows if not _too_short(t := normal(r.text))}, key=str)
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(mine)))
    return out


def unsearched(benchmark: DataFrame) -> DataFrame:
    """The rows of ``benchmark`` that no search looks for: null, without a word, or under ``MIN_CHARS`` characters and ``MIN_WORDS`` words."""
    short = F.udf(lambda text: _too_short(normal(text)), "boolean")
    return benchmark.filter(short("text"))


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance): each item found in each document, with its least edit distance.

    Null or empty texts contain nothing. Items of under ``MIN_CHARS`` normalised
    characters are found where they stand exactly, as whole words; null ones and those of
    under ``MIN_WORDS`` words besides are not searched (see ``unsearched``). Rows that repeat a doc_id or an item_id give
    one row, with the least distance. A benchmark above ``block_chars`` is searched in
    several passes, so what a pass broadcasts has a fixed bound.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for block in _blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            search = _searcher(block, rate)
            for batch in batches:
                hits = [(d, i, n) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i, n in search.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([h[j] for h in hits], pa.int64()) for j in range(3)], names=["doc_id", "item_id", "distance"])

        parts.append(source.mapInArrow(run, "doc_id long, item_id long, distance long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item within its error budget, columns unchanged; no shuffle.

    Null and empty texts stay, repeated rows are judged alike, texts of any length are
    searched whole. Without items, or without rows, nothing is dropped.
    """
    out, where, schema = docs, docs.columns.index("text"), docs.schema
    for block in _blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            search = _searcher(block, rate)
            for batch in batches:
                for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                    yield part.filter(pa.array([not search.search(t) for t in part.column(where).to_pylist()], pa.bool_()))
            settle()

        out = out.mapInArrow(run, schema)
    return out
