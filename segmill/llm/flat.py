"""Flat files of unsigned integers for token ids, with 64-bit document offsets.

A shard holds the ids of its documents one after the other, in 16 bits where the
vocabulary allows and else in 32, little-endian. Beside it ``.idx`` holds the documents'
offsets in the shard and the shard's end as unsigned 64-bit integers, and ``.ids`` their
document ids as signed ones. Shards follow each other by document id; a shard's base is
the prefix sum of the token totals before it, so a document's global start is base plus
offset. Readers map the files into memory.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import pick
from .shared import new_path, open_store, write_once

END = 2
#: Distinct strings whose ids a worker remembers, and characters in work at a time.
REMEMBERED = 500_000
CHUNK = 4_000_000
#: Documents are read back in runs of about so many ids.
READ_IDS = 4_000_000
_CUT = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(r"[a-z]+|[0-9]|[!-&(-/:-@\[-`{-~]+").fullmatch
#: Latin letters, but for the one whose lower case is two characters.
_WORD_AND_TAIL = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-;=-@\[-`{-~]+)").fullmatch
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: What a vocabulary file must say for texts to be cut as above; texts go whole to any other tokenizer.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Index(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class Encoder:
    """The tokenizers library's encoding of whole texts, with each distinct piece encoded once.

    This tokenizer drops white space and never forms a token across it, so a text's ids
    are those of its runs in order. A run of ASCII is cut further where the tokenizer
    itself cuts: into letters, single digits and the rest, and a Latin word from the
    ASCII marks after it; runs with anything else, an apostrophe or the start of a
    special token go to the library as they are.
    ``str.split`` also splits at U+001C to U+001F, which the tokenizer keeps; texts with
    those go to the library whole. So do all texts where the file names another
    normaliser, other cuts or other special tokens than these hold for.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        own = spec.get("normalizer") == _NORMALIZER and steps[0].get("pattern") == {"Regex": _SPLIT} and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        self.cuts = own and spec["model"].get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") for t in spec.get("added_tokens", ()))
        self.size_of_vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.forget()

    def forget(self) -> None:
        """Start the stores of known runs and pieces anew."""
        self.runs, self.pieces = Index(), Index()
        self.run_ids = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.piece_ids = self.run_ids

    @staticmethod
    def _added(store: tuple, ids: np.ndarray, size: np.ndarray) -> tuple:
        flat, start, sizes = store
        return np.concatenate([flat, ids]), np.concatenate([start, len(flat) + np.cumsum(size) - size]), np.concatenate([sizes, size])

    @staticmethod
    def _gather(store: tuple, codes: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all codes one after the other, and how many each group of ``counts`` codes has."""
        flat, start, sizes = store
        size = sizes[codes]
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts)).astype(np.int64)]
        return pick(flat, start[codes], size), np.diff(ends)

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        """The library's ids of each piece. One of plain lower-case ASCII is a word to its model already and skips the rest."""
        merge = self.tokenizer.model.tokenize
        ids = [[t.id for t in merge(p)] if _PLAIN(p) else None for p in pieces]
        others = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(others, self.tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False)):
            ids[i] = e.ids
        return ids

    def _learn(self, known: int) -> None:
        """Encode the runs from number ``known`` on."""
        cut, tail, seen = _CUT.findall, _WORD_AND_TAIL, len(self.pieces)
        plain = lambda w: w.isascii() and "'" not in w and "<|" not in w
        parts = [cut(w.lower()) if plain(w) else m.groups() if (m := tail(w)) else (w,) for w in list(self.runs)[known:]]
        codes = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(parts)), np.int64)
        if len(self.pieces) > seen:
            ids = self._encoded(list(self.pieces)[seen:])
            self.piece_ids = self._added(self.piece_ids, np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64))
        self.run_ids = self._added(self.run_ids, *self._gather(self.piece_ids, codes, [len(p) for p in parts]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if not self.cuts:
            whole = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(whole), np.uint32), np.array([len(x) for x in whole], np.int64)
        if max(len(self.runs), len(self.pieces)) > REMEMBERED:
            self.forget()
        known = len(self.runs)
        parts = [(t,) if _SEPARATORS.search(t) else t.split() for t in texts]
        codes = np.fromiter(map(self.runs.__getitem__, chain.from_iterable(parts)), np.int64)
        if len(self.runs) > known:
            self._learn(known)
        return self._gather(self.run_ids, codes, [len(p) for p in parts])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The texts' ids with the end id after each text."""
    return np.insert(ids, np.cumsum(sizes), end)


SHARD = T.StructType([T.StructField(n, t) for n, t in (("shard", T.IntegerType()), ("path", T.StringType()), ("width", T.IntegerType()), ("docs", T.LongType()), ("tokens", T.LongType()))])


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, partitions: int | None = None) -> list[dict]:
    """Encode the texts of ``docs`` (doc_id, text) into shards in ``folder``, by ascending doc_id; their list with bases.

    A null text is empty and has just the end id; rows with a null doc_id come first and
    are stored under the least 64-bit integer; rows that repeat a doc_id are documents of
    their own, in the order of their texts. A task that is repeated writes the same bytes
    under a name of its own and renames it. Empty shards are not written.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = np.dtype("<u2" if enc.size_of_vocabulary <= 1 << 16 else "<u4")
        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}"
        ids_of_docs, sizes_of_docs = [], []

        def tokens() -> Iterator[bytes]:
            for batch in batches:
                ids_of_docs.append(batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy())
                texts = [t or "" for t in batch.column("text").to_pylist()]
                start = size = 0
                for i, t in enumerate([*texts, None]):
                    if t is None or size > CHUNK:
                        ids, sizes = enc.encode(texts[start:i])
                        sizes_of_docs.append(sizes + 1)
                        yield with_end(ids, sizes, end).astype(kind).tobytes()
                        start, size = i, 0
                    size += len(t or "")

        first = next(batches, None)
        if first is None:
            return
        rest = batches

        def chained() -> Iterator[pa.RecordBatch]:
            yield first
            yield from rest

        batches = chained()
        write_once(f"{name}.bin", tokens())
        sizes = np.concatenate(sizes_of_docs)
        write_once(f"{name}.idx", [np.append(0, np.cumsum(sizes)).astype("<u8").tobytes()])
        write_once(f"{name}.ids", [np.concatenate(ids_of_docs).astype("<i8").tobytes()])
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "width": kind.itemsize, "docs": len(sizes), "tokens": int(sizes.sum())}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = source.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = sorted((r.asDict() for r in dealt.mapInArrow(run, SHARD).collect()), key=lambda r: r["shard"])  # a row a shard
    base = 0
    for s in shards:
        s["base"] = base
        base += s["tokens"]
    return shards


class Shard:
    """A shard mapped into memory, or read by ranges where its store isn't a local folder."""

    def __init__(self, path: str, width: int):
        self.path, self.kind = path, np.dtype(f"<u{width}")
        self.offsets = self._array(f"{path}.idx", np.dtype("<u8"))
        self.doc_ids = self._array(f"{path}.ids", np.dtype("<i8"))

    @staticmethod
    def _array(uri: str, kind: np.dtype, first: int = 0, n: int | None = None) -> np.ndarray:
        store, path = open_store(uri)
        if store.type_name == "local":
            whole = np.memmap(path, kind, "r")
            return whole[first : None if n is None else first + n]
        with store.open_input_file(path) as f:
            f.seek(first * kind.itemsize)
            return np.frombuffer(f.read(None if n is None else n * kind.itemsize), kind)

    def tokens(self, first_doc: int, last_doc: int) -> np.ndarray:
        """The ids of documents ``first_doc`` up to ``last_doc``."""
        a, b = int(self.offsets[first_doc]), int(self.offsets[last_doc])
        return self._array(f"{self.path}.bin", self.kind, a, b - a) if b > a else np.zeros(0, self.kind)


def read_documents(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, read from the files.

    Each task takes a run of one shard's documents of bounded size.
    """
    runs = [(s["path"], s["width"], s["base"], k, n) for s in shards for n in [max(1, -(-s["tokens"] // READ_IDS))] for k in range(n)]
    schema = "path string, width int, base long, k int, n int"
    plan = spark.createDataFrame(runs, schema)
    if runs:
        plan = plan.repartition(min(len(runs), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(r["path"], r["width"])
                total = int(shard.offsets[-1])
                a, b = (int(np.searchsorted(shard.offsets[:-1], total * x // r["n"])) for x in (r["k"], r["k"] + 1))
                if r["k"] + 1 == r["n"]:
                    b = len(shard.doc_ids)
                if a >= b:
                    continue
                bounds = shard.offsets[a : b + 1].astype(np.int64)
                ids = shard.tokens(a, b)
                crc = [zlib.crc32(ids[x - bounds[0] : y - bounds[0]].astype("<u4").tobytes()) for x, y in zip(bounds, bounds[1:])]
                doc = shard.doc_ids[a:b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64(), mask=doc == np.iinfo(np.int64).min), pa.array(bounds[:-1] + r["base"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return plan.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of ``docs`` (doc_id, text), from flat files in the shared folder.

    Null and empty texts have the end id alone; texts of any length are written as they
    come. Rows with a null doc_id come first, rows that repeat a doc_id are documents of
    their own. An empty table writes no file and gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    return read_documents(spark, write_shards(docs, new_path(spark, "tokens"), vocabulary, end))
