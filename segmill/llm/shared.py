"""The folder that driver and executors share, and tables and files kept in it."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of our own if all runs on this machine, else ValueError."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="segmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors.

    The shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stashed"] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that ``stash`` returned and no later read needs."""
    for df in tables:
        drop_path(df.sparkSession, df.__dict__["stashed"])


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder that no later read needs."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def open_store(uri: str):
    """(file system, path in it) of a URI, for byte access inside tasks; works for any store pyarrow knows."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def settle() -> None:
    """Hand memory that a task no longer uses back to the system: workers live on between tasks, beside a JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def write_once(uri: str, chunks) -> None:
    """Write a file under a name of this attempt and rename it, so a repeated task leaves one whole file."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(own, path)
