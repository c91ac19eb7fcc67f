"""Token counts from flat files without an index, by scanning for the end-of-document id.

Files are cut into blocks of a fixed number of ids. Each block is searched on its own,
vectorised; it yields the lengths between its separators and the ids left over before
the first and after the last one. An exclusive prefix scan over the blocks of a file, in
order, carries the open length and the number of documents across block boundaries.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, open_store, write_once

END = 50256
WIDTH = 2
#: Ids in a block.
BLOCK = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(1)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _file(uri: str) -> tuple:
    store, path = open_store(uri)
    return store, path


def write_flat(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write the texts' ids, each text closed by ``end``, one unindexed file a partition.

    Returns the order in which the documents lie: (file, position, doc_id), kept as a
    table apart from the files. A null text has just its end id.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        file = f"part-{TaskContext.get().partitionId():06d}.bin"
        order = []

        def data() -> Iterator[bytes]:
            for batch in batches:
                order.append(batch.column("doc_id"))
                for t in batch.column("text").to_pylist():
                    yield np.array([*enc.encode_ordinary(t or ""), end], f"<u{WIDTH}").tobytes()

        write_once(f"{folder}/{file}", data())
        at = 0
        for ids in order:
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(ids), pa.string()), pa.array(range(at, at + len(ids)), pa.int64()), ids], names=["file", "position", "doc_id"])
            at += len(ids)

    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, position long, doc_id long")
    order.write.parquet(f"{folder}/order")
    return spark.read.schema(order.schema).parquet(f"{folder}/order")


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, ids) of the flat files in a folder; each is a whole number of ids long."""
    from pyarrow import fs

    store, path = _file(folder)
    found = [f for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file and f.base_name.endswith(".bin")]
    if bad := [f.base_name for f in found if f.size % WIDTH]:
        raise ValueError(f"not a whole number of ids: {bad[0]}")
    return sorted((f.base_name, f.size // WIDTH) for f in found)


def scan_block(ids: np.ndarray, end: int = END) -> tuple[int, int, int, np.ndarray]:
    """(separators, ids up to and with the first, ids after the last, lengths between them) of a block.

    A block without a separator has all its ids after the last one.
    """
    at = np.flatnonzero(ids == end)
    if not len(at):
        return 0, 0, len(ids), np.zeros(0, np.int64)
    return len(at), int(at[0]) + 1, len(ids) - 1 - int(at[-1]), np.diff(at)


def count_tokens(spark: SparkSession, folder: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, position, n_tokens) of every document in the files of ``folder``, the end id counted.

    Ids after a file's last separator form a document too. Empty files have none.
    """
    blocks = [(name, b, min(block, n - b * block)) for name, n in list_files(spark, folder) for b in range(-(-n // block))]
    plan = spark.createDataFrame(blocks, "file string, block long, n long")
    if blocks:
        plan = plan.repartition(min(len(blocks), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = _file(f"{folder}/{r['file']}")
                with store.open_input_file(path) as f:
                    f.seek(r["block"] * block * WIDTH)
                    ids = np.frombuffer(f.read(r["n"] * WIDTH), f"<u{WIDTH}")
                seps, head, tail, inner = scan_block(ids, end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]]), pa.array([r["block"]]), pa.array([seps]), pa.array([head]), pa.array([tail]), pa.array([inner.tolist()], pa.list_(pa.int64()))],
                    names=["file", "block", "seps", "head", "tail", "inner"],
                )

    found = plan.mapInArrow(run, "file string, block long, seps long, head long, tail long, inner array<bigint>")
    # A file's blocks are few; their windows are bounded by the file, the lengths stay with the block.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # The open length is what followed the last separator seen: tails since then, blocks without one included.
    all_tails = F.coalesce(F.sum("tail").over(before), F.lit(0))
    closed = F.coalesce(F.max(F.when(F.col("seps") > 0, F.col("up_to"))).over(before), F.lit(0))
    t = found.withColumn("up_to", all_tails)
    t = t.withColumn("base", F.coalesce(F.sum("seps").over(before), F.lit(0))).withColumn("open", F.col("up_to") - closed)
    t = t.withColumn("is_last", F.count("*").over(last) == 0)
    first = F.when(F.col("seps") > 0, F.array(F.col("open") + F.col("head"))).otherwise(F.array().cast("array<bigint>"))
    left = F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail"))
    rest = F.when(F.col("is_last") & (left > 0), F.array(left)).otherwise(F.array().cast("array<bigint>"))
    return t.select("file", "base", F.posexplode(F.concat(first, "inner", rest)).alias("i", "n_tokens")).select("file", (F.col("base") + F.col("i")).alias("position"), "n_tokens")


def counted(docs: DataFrame, vocabulary: str | None = None, end: int = END, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens, the end id counted, of every row of ``docs``, from flat files written to and scanned in the shared folder.

    A null or empty text has its end id alone. Rows that repeat a doc_id are documents of
    their own, rows with a null doc_id keep it. An empty table gives no rows; other columns
    are ignored. Both sides of the join have a row a document, so it is never a broadcast.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "flat")
    order = write_flat(docs, folder, vocabulary, end)
    counts = count_tokens(spark, folder, end, block)
    return order.join(counts.hint("merge"), ["file", "position"]).select("doc_id", "n_tokens")
