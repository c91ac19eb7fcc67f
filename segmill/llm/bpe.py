"""Byte-level BPE in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round takes the lowest rank
of each word, merges its occurrences from left to right, looks up the pairs that are new
by binary search over the sorted pair keys, and drops the words that have no pair left.

Long words lie in an array of their own, whose symbols are linked to their neighbours.
There a round takes the lowest rank of all words and touches only the places that have
it, so the work grows with the merges and not with their number times the length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Fixed value: the public pattern that cuts texts into words for this vocabulary.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text in work at a time, and distinct words a worker remembers.
CHUNK = 1_000_000
REMEMBERED = 150_000
#: Bytes from which a word is long.
LONG = 512
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = count(256)
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pick(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``values`` at ``start`` with ``size`` items, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - size), size) + np.arange(total)]


class Vocabulary:
    """A byte-level BPE vocabulary and its merges, from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        self.of_byte = np.array([ids[c] for c in letters], np.int64)
        to_byte = {c: b for b, c in enumerate(letters)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.place = np.argsort(self.ranks)  # of a rank in the sorted keys
        born = np.zeros(max(ids.values()) + 1, np.int64)
        born[made] = np.arange(1, len(made) + 1)
        # Whether every merge comes after those that made its two sides, as training has it.
        self.ordered = bool((np.maximum(born[keys >> 32], born[keys & 0xFFFFFFFF]) <= np.arange(len(keys))).all())
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        raw = [b"".join(bytes([to_byte[c]]) if c in to_byte else c.encode() for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_size = np.array([len(b) for b in raw], np.int64)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = regex.compile(WORD)
        self.forget()

    def forget(self) -> None:
        """Start the store of known words anew, with the special tokens only."""
        self.index: dict[str, int] = {}
        self.flat = np.array(list(self.special.values()), np.uint32)
        self.start = np.arange(len(self.special), dtype=np.int64)
        self.size = np.ones(len(self.special), np.int64)
        for s in self.special:
            self.index[s] = len(self.index)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the sorted keys, -1 for a pair that never merges."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        long = np.array([len(w) > LONG for w in words], bool) & self.ordered
        if not long.any():
            return self._merged(words, self._rounds)
        short = [w for w, x in zip(words, long) if not x]
        (a, n), (b, m) = self._merged(short, self._rounds), self._merged([w for w, x in zip(words, long) if x], self._linked_rounds)
        size = np.zeros(len(words), np.int64)
        size[~long], size[long] = n, m
        out = np.zeros(int(size.sum()), np.uint32)
        of = np.repeat(long, size)
        out[~of], out[of] = a, b
        return out, size

    def _merged(self, words: list[bytes], rounds) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        if not sizes.sum():
            return np.zeros(0, np.uint32), sizes
        word, ids = rounds(np.repeat(np.arange(len(words)), sizes), self.of_byte[np.frombuffer(b"".join(words), np.uint8)])
        return ids.astype(np.uint32), np.bincount(word, minlength=len(words))

    def _rounds(self, word: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, ids) after all merges, by word."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.append(np.where(word[1:] == word[:-1], self.pairs(ids[:-1], ids[1:]), -1), -1)
        rank = np.where(pair >= 0, self.ranks[pair], _NONE)
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            live = low != _NONE
            if not live.all():
                done.append((word[~live], ids[~live]))
                word, ids, pair, rank, low = word[live], ids[live], pair[live], rank[live], low[live]
                if not len(ids):
                    break
            spots = _apart(np.flatnonzero(rank == low), lambda x: x + 1)
            ids[spots] = self.made[pair[spots]]
            left = np.ones(len(ids), bool)
            left[spots + 1] = False
            word, ids, pair, rank = word[left], ids[left], pair[left], rank[left]
            now = spots - np.arange(len(spots))  # their places after the cut
            new = np.append(now, now[now > 0] - 1)
            after = np.minimum(new + 1, len(ids) - 1)
            pair[new] = np.where((after > new) & (word[after] == word[new]), self.pairs(ids[new], ids[after]), -1)
            rank[new] = np.where(pair[new] >= 0, self.ranks[pair[new]], _NONE)
        word, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return word[order], ids[order]

    def _linked_rounds(self, word: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_rounds``, the lowest rank of all words at a time. A new pair's rank is always above that of the merge that made it."""
        n = len(ids)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        there = np.ones(n, bool)
        pair = np.full(n, -1)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look_up(spots: np.ndarray) -> None:
            after = following[spots]
            inner = after < n
            inner[inner] = word[after[inner]] == word[spots[inner]]
            pair[spots[~inner]] = -1
            spots, after = spots[inner], after[inner]
            pair[spots] = self.pairs(ids[spots], ids[after])
            spots = spots[pair[spots] >= 0]
            of = self.ranks[pair[spots]]
            order = np.argsort(of, kind="stable")
            spots, of = spots[order], of[order]
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else ()
            for a, b in zip(cuts, [*cuts[1:], len(of)]):
                r = int(of[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(spots[a:b])

        look_up(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = self.place[r]
            spots = np.unique(np.concatenate(waiting.pop(r)))
            spots = _apart(spots[there[spots] & (pair[spots] == at)], lambda x: following[x])
            if not len(spots):
                continue
            gone = following[spots]
            ids[spots] = self.made[at]
            there[gone] = False
            after = following[gone]
            following[spots] = after
            inner = after < n
            before[after[inner]] = spots[inner]
            left = before[spots]
            look_up(np.unique(np.append(spots, left[left >= 0])))
        return word[there], ids[there]

    def cut_words(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.word.findall(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.word.findall(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if len(self.index) > REMEMBERED:
            self.forget()
        known = len(self.index)
        code = self.index.setdefault
        words = [self.cut_words(t) for t in texts]
        codes = np.fromiter((code(w, len(self.index)) for ws in words for w in ws), np.int64)
        if len(self.index) > known:
            new = list(self.index)[known:]
            ids, size = self.merge([w.encode("utf-8", "surrogatepass") for w in new])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids])
        sizes = self.size[codes]
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum([len(ws) for ws in words])).astype(np.int64)]
        return pick(self.flat, self.start[codes], sizes), np.diff(ends)

    def decode_bytes(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes that each text's ids stand for; ids outside the vocabulary stand for none."""
        ids = ids.astype(np.int64)
        inside = ids < len(self.byte_size)
        at = np.where(inside, ids, 0)
        width = np.where(inside, self.byte_size[at], 0)
        data = pick(self.bytes, self.byte_start[at], width).tobytes()
        ends = np.append(0, np.cumsum(width))[np.append(0, np.cumsum(sizes)).astype(np.int64)]
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Each text's ids as a text; bytes that aren't UTF-8 become U+FFFD."""
        return [b.decode("utf-8", "replace") for b in self.decode_bytes(ids, sizes)]


def _apart(spots: np.ndarray, following) -> np.ndarray:
    """Of places that hold the same pair those that merge: of places that touch, one symbol repeated, every second."""
    if len(spots) < 2:
        return spots
    new_run = np.append(True, following(spots[:-1]) != spots[1:])
    number = np.arange(len(spots))
    return spots[(number - np.maximum.accumulate(np.where(new_run, number, 0))) % 2 == 0]


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _chunks(texts: list[str], most: int) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encode(docs: DataFrame, vocabulary_path: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with an array column ``into`` of token ids, in place of one of that name; a null text counts as empty and has none.

    Repeated rows repeat, an empty table gives no rows, and all other columns pass as they are.
    """
    path = vocabulary_path or default_vocabulary()
    names = [c for c in docs.columns if c != into]
    where = names.index(text)
    schema = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("array<bigint>").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(where).to_pylist()]
            for s in _chunks(texts, CHUNK):
                ids, sizes = vocab.encode(texts[s])
                made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids.astype(np.int64)))
                part = batch.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*names, into])
        settle()

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs`` (doc_id, text).

    Each text is encoded, its ids hashed as little-endian 32-bit integers, and the ids
    decoded again. A null text is empty: no ids, hashes of nothing. Repeated rows repeat,
    an empty table gives no rows, and other columns are ignored. A text may be one word
    of any length.
    """
    path = vocabulary_path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n, of_ids, of_text = [], [], []
            for s in _chunks(texts, CHUNK):
                ids, sizes = vocab.encode(texts[s])
                data, ends = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(sizes)) * 4
                n += sizes.tolist()
                of_ids += [sha(data[a:b]) for a, b in zip(ends, ends[1:])]
                of_text += [sha(t.encode()) for t in vocab.decode(ids, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        settle()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
