"""Removal of every byte covered by a repeated 400-byte string, by suffix arrays of shards.

A string of ``LENGTH`` bytes is assigned to its anchor, the least hashed ``GRAM``-byte
piece in it, so equal strings have equal anchors wherever they stand. The starts that
share an anchor are a run, and the bytes their strings cover a context. Then:

1. Equal contexts of an anchor become one with the number of its occurrences. An anchor
   that occurs once altogether can have no repeat and goes no further.
2. All other contexts go to shards by anchor; those that are their anchor's only one can
   be in any shard, and adjacent ones go as one piece. A shard's text gets a suffix array
   by induced sorting and its permuted common prefixes. Suffixes that share ``LENGTH``
   bytes are neighbours; those of a group that occurs twice or more are repeated.
3. Anchors with too many bytes of contexts for a shard are parted first: the strings
   that have the anchor at about the same place agree on the bytes around it, so they
   are dealt by place and by those bytes, in rounds with ever narrower places.

Repeated starts of a context hold for each of its occurrences. Contexts meet by 64-bit
anchor hashes, which only bring them together, and are told apart by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .idfilter import marked
from .shared import drop, stash
from .shingles import mixed, powers
from .suffix import permuted_common_prefixes, suffix_array

LENGTH = 400
GRAM = 100
#: Bytes of contexts in a shard, about; bytes above which an anchor's contexts are parted first.
SHARD = 2_000_000
HOT = 4_000_000
#: A round of parting narrows the anchor's places by this factor.
NARROWER = 8
#: Bytes of texts hashed together.
CHUNK = 1 << 20
_NO_ID = -(1 << 63)
_BREAK = b"\xff"  # in no UTF-8 text


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def runs(parts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, int]]:
    """(part, first start, number of starts, anchor's place, anchor's hash) of each run in each part.

    A string's anchor depends on its own bytes alone: the leftmost of its pieces with the
    least whole hash.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(_BREAK.join(parts) + _BREAK, np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    n = len(data)
    if n < length or not (sizes >= length).any():
        return
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    width = length - gram + 1
    bits = np.uint64(int(n).bit_length())
    least = _window_least(((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64), width)  # the leftmost of the least leading bits
    anchors = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    for w in np.flatnonzero(grams[anchors] != _window_least(grams, width)):  # leading bits that agree where whole hashes don't
        anchors[w] = w + int(np.argmin(grams[w : w + width]))
    for k in np.flatnonzero(sizes >= length):
        a = anchors[begin[k] : begin[k] + sizes[k] - length + 1]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        for s, e, at in zip(first.tolist(), np.append(first[1:], len(a)).tolist(), a[first].tolist()):
            yield int(k), s, e - s, at - int(begin[k]), int(grams[at])


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from block-wise minima to both sides."""
    n = len(values)
    padded = np.append(values, np.full(-n % width + width, np.iinfo(np.uint64).max)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _chunked(items: list[bytes], most: int, length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Items together up to ``most`` bytes, with the number and offset of each; a longer one in parts that share no start."""
    where, parts, size = [], [], 0
    for i, b in enumerate(items):
        for at in range(0, max(1, len(b) - length + 1), most):
            part = b[at : at + most + length - 1]
            if parts and size + len(part) > most:
                yield where, parts
                where, parts, size = [], [], 0
            where.append((i, at))
            parts.append(part)
            size += len(part) + 1
    if parts:
        yield where, parts


def _digest(data: bytes, lead: int) -> bytes:
    """Of a context's bytes and its anchor's place."""
    return hashlib.blake2b(data, digest_size=16, salt=lead.to_bytes(4, "little")).digest()


def _occurrences(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_raw(t) for t in batch.column("text").to_pylist()]
            rows, first, size, leads, keys, digests = [], [], [], [], [], []
            for where, parts in _chunked(texts, CHUNK, length):
                for k, s, n, at, key in runs(parts, length, gram):
                    rows.append(where[k][0])
                    first.append(where[k][1] + s)
                    size.append(n)
                    leads.append(at - s)
                    keys.append(key)
                    digests.append(_digest(parts[k][s : s + n - 1 + length], at - s))
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), batch.column("th").take(of), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(leads, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(digests, pa.binary())],
                names=["doc_id", "th", "first", "n", "lead", "key", "digest"],
            )

    return run


def _pieces(wanted: list[dict]) -> Iterator[list[dict]]:
    """Wanted contexts of a text, those that follow each other and are their anchors' only ones together."""
    piece: list[dict] = []
    for w in sorted(wanted, key=lambda w: (w["kinds"] > 1, w["first"])):
        if piece and (w["kinds"] > 1 or w["first"] != piece[-1]["first"] + piece[-1]["n"] or w["first"] - piece[0]["first"] > CHUNK):
            yield piece
            piece = []
        piece.append(w)
    if piece:
        yield piece


_PIECE = {"group": pa.int64(), "data": pa.binary(), "keys": pa.list_(pa.int64()), "digests": pa.list_(pa.binary()), "at": pa.list_(pa.int32()), "n": pa.list_(pa.int32()), "times": pa.list_(pa.int64())}
_PIECE_SCHEMA = "group long, data binary, keys array<long>, digests array<binary>, at array<int>, n array<int>, times array<long>"


def _fetch(length: int):
    """The bytes of wanted contexts in pieces, with each context's place, starts and number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = _raw(text)
                for piece in _pieces(wanted):
                    a, b = piece[0]["first"], piece[-1]["first"] + piece[-1]["n"] - 1 + length
                    out.append((piece[0]["key"], raw[a:b], *([w[c] for w in piece] for c in ("key", "digest")), [w["first"] - a for w in piece], *([w[c] for w in piece] for c in ("n", "times"))))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(_PIECE.values())], names=list(_PIECE))

    return run


def parted(data: bytes, n: int, lead: int, key: int, width: int, length: int = LENGTH) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first start, starts, lead, key, digest) of the parts of a context: its starts by the anchor's place in their strings.

    A part's places are ``width`` wide. All strings with the anchor at these places share
    the bytes around it, which with the place make the part's key.
    """
    for place in range(max(0, lead - n + 1) // width, lead // width + 1):
        low, high = place * width, place * width + width - 1
        a, b = max(0, lead - high), min(n - 1, lead - low)
        core = data[lead - low : lead - high + length]
        own = hashlib.blake2b(core, digest_size=8, salt=place.to_bytes(4, "little"), key=(key & (1 << 64) - 1).to_bytes(8, "little")).digest()
        yield a, b - a + 1, lead - a, int.from_bytes(own, "little", signed=True), _digest(data[a : b + length], lead - a)


def _part(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, th, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "wanted"))):
                raw = _raw(text)
                for w in wanted:
                    data = raw[w["first"] : w["first"] + w["n"] - 1 + length]
                    out += [(doc_id, th, w["first"] + a, n, lead, key, digest, w["times"], w["key"], w["digest"], a) for a, n, lead, key, digest in parted(data, w["n"], w["lead"], w["key"], width, length)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(_PART.values())], names=list(_PART))

    return run


_PART = {"doc_id": pa.int64(), "th": pa.int64(), "first": pa.int32(), "n": pa.int32(), "lead": pa.int32(), "key": pa.int64(), "digest": pa.binary(), "times": pa.int64(), "of_key": pa.int64(), "of_digest": pa.binary(), "shift": pa.int32()}
_PART_SCHEMA = "doc_id long, th long, first int, n int, lead int, key long, digest binary, times long, of_key long, of_digest binary, shift int"


def repeated_starts(pieces: list[bytes], length: int = LENGTH, weights: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each piece the starts whose ``length``-byte string occurs at another start; a start occurs as often as its weight says, once without."""
    text = np.frombuffer(_BREAK.join(pieces), np.uint8)
    array = suffix_array(text)
    _, common = permuted_common_prefixes(text, array, len(text))
    # Suffixes in order fall into groups that share ``length`` bytes; a group occurs as often as its starts.
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    weight = np.zeros(len(text), np.int64)
    for k, (at, size) in enumerate(zip(begin.tolist(), sizes.tolist())):
        weight[at : at + max(0, size - length + 1)] = weights[k] if weights else 1
    first = np.flatnonzero(np.append(True, common[array[1:]] < length))
    total = np.add.reduceat(weight[array], first)
    flags = np.zeros(len(text), bool)
    flags[array] = np.repeat(total > 1, np.diff(np.append(first, len(text))))
    return [np.flatnonzero(flags[at : at + max(0, size - length + 1)]) for at, size in zip(begin.tolist(), sizes.tolist())]


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive starts as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


def _shard(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(pdf["data"].tolist(), length, [np.repeat(t, n) for t, n in zip(pdf["times"], pdf["n"])])
        out = []
        for starts, keys, digests, at, n in zip(found, pdf["keys"], pdf["digests"], pdf["at"], pdf["n"]):
            cuts = np.searchsorted(starts, np.append(at, at[-1] + n[-1]))
            out += [(k, d, a, b) for k, d, x, i, j in zip(keys, digests, at, cuts, cuts[1:]) for a, b in _spans(starts[i:j] - x)]
        return pd.DataFrame(out, columns=["key", "digest", "a", "b"])

    return run


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                raw, keep, at, removed, n = _raw(text), [], 0, 0, 0
                end = -1
                for s in sorted((s["a"], s["b"] + length) for s in spans or ()):
                    if s[0] > end:  # a new run; one that touches the last goes on with it
                        n += 1
                        if end >= 0:
                            removed += end - at
                            at = end
                        keep.append(raw[at : s[0]])
                        at, end = s[0], s[1]
                    else:
                        end = max(end, s[1])
                if end >= 0:
                    removed += end - at
                    at = end
                keep.append(raw[at:])
                rest = b"".join(keep)
                out.append((doc_id, len(raw), removed, n, hashlib.sha256(rest).hexdigest(), rest, rest.decode("utf-8", "ignore")))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "text"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            arrays = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _counted(rows: DataFrame) -> DataFrame:
    """Equal contexts as one, with the number of their occurrences and the place of the first; those of anchors that occur once left out."""
    each = rows.groupBy("key", "digest").agg(F.sum("times").alias("times"), F.min(F.struct("doc_id", "th", "first", "n", "lead")).alias("at"))
    each = stash(each.select("key", "digest", "times", "at.*"), "contexts")
    anchors = each.groupBy(F.col("key").alias("its_key")).agg(F.sum("times").alias("all"), F.sum(F.col("n").cast("long")).alias("starts"), F.count("*").alias("kinds")).filter("all > 1")
    anchors = stash(anchors, "anchors")  # as a table: of a join with an aggregate Spark can't split hot keys
    out = stash(each.join(anchors, F.col("key") == F.col("its_key")).drop("its_key", "all"), "open")
    drop(each, anchors)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): ``docs`` as doc_id, th, text, and per doc_id and th the runs (a, b) of repeated starts.

    ``th`` is a hash of the text: rows are told apart by doc_id and text, and equal
    rows are occurrences of their own.
    """
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("th"), "text")
    seen = stash(whole.filter(F.octet_length("text") >= length).mapInArrow(_occurrences(length, gram), "doc_id long, th long, first int, n int, lead int, key long, digest binary"), "occurrences")

    def wanted(rows: DataFrame) -> DataFrame:
        texts = marked(whole, "doc_id", rows.select("doc_id"))[0]
        lists = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "n", "lead", "key", "digest", "times", "kinds")).alias("wanted"))
        return texts.join(lists, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])  # equal rows have equal bytes

    size = F.col("starts") + F.col("kinds") * length
    level = _counted(seen.withColumn("times", F.lit(1).cast("long")))
    found: list[DataFrame] = []
    made: list[DataFrame] = [level]
    origin: DataFrame | None = None  # (key, digest, of_key, of_digest, shift): the contexts of the occurrences that a part belongs to
    width = length - gram + 1
    while True:
        total, most = level.agg(F.sum(F.col("n").cast("long") + F.when(F.col("kinds") > 1, length).otherwise(0)), F.max(size)).first()
        if total is None:
            break
        cold, shards = level.filter(size <= hot) if width > 1 else level, max(1, -(-total // shard))
        data = wanted(cold).select("text", "wanted").mapInArrow(_fetch(length), _PIECE_SCHEMA)
        spans = stash(data.groupBy(F.pmod(F.xxhash64("group"), F.lit(shards)).alias("shard")).applyInPandas(_shard(length), "key long, digest binary, a int, b int"), "spans")
        made.append(spans)
        if origin is not None:
            spans = spans.join(origin, ["key", "digest"]).select(F.col("of_key").alias("key"), F.col("of_digest").alias("digest"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"))
        found.append(spans)
        if width == 1 or most <= hot:
            break
        width = -(-width // NARROWER)
        parts = stash(wanted(level.filter(size > hot)).select("doc_id", "th", "text", "wanted").mapInArrow(_part(length, width), _PART_SCHEMA), "parts")
        made.append(parts)
        links = parts.select("key", "digest", "of_key", "of_digest", "shift")
        if origin is not None:
            above = origin.select(F.col("key").alias("of_key"), F.col("digest").alias("of_digest"), F.col("of_key").alias("top_key"), F.col("of_digest").alias("top_digest"), F.col("shift").alias("more"))
            links = links.join(above, ["of_key", "of_digest"]).select("key", "digest", F.col("top_key").alias("of_key"), F.col("top_digest").alias("of_digest"), (F.col("shift") + F.col("more")).alias("shift"))
        origin = stash(links, "origin")
        level = _counted(parts)
        made += [origin, level]
    if found:
        per = found[0]
        for f in found[1:]:
            per = per.unionByName(f)
        per = stash(per.groupBy("key", "digest").agg(F.collect_list(F.struct("a", "b")).alias("parts")), "found")
        made.append(per)
        hits = seen.join(per, ["key", "digest"]).select("doc_id", "th", F.explode(F.transform("parts", lambda p: F.struct((p["a"] + F.col("first")).alias("a"), (p["b"] + F.col("first")).alias("b")))).alias("s"))
        spans = stash(hits.groupBy("doc_id", "th").agg(F.collect_set("s").alias("spans")), "removed")
    else:
        spans = docs.sparkSession.createDataFrame([], "doc_id long, th long, spans array<struct<a:int,b:int>>")
    drop(seen, *made)
    return whole, spans


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes and text of every row of ``docs`` (doc_id, text).

    A byte goes if a ``length``-byte string that covers it also starts anywhere else, in
    this text or another. What is left is bytes, since a cut can fall within a character;
    ``text`` is the same without the bytes of such a character. A null text is empty, a
    null doc_id stays null. Rows that repeat are occurrences of each other's strings. Long
    texts are searched in parts that lose no string. Other columns are ignored, and an
    empty table gives no rows.
    """
    texts, spans = repeated_spans(docs, length, gram, shard, hot)
    out = texts.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    made = out.mapInArrow(_strip(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary, text string")
    return made.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
