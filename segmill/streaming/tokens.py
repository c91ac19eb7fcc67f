"""Streams: the kernel is stateless, so a stream of documents is segmented row by row, without watermark or state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cascade import Options
from ..operators.engine import tokenize_text


def tokenize_stream(stream: DataFrame, options: Options | None = None, **how) -> DataFrame:
    """A stream of tokens from a stream of documents; see ``tokenize_text``."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return tokenize_text(stream, options, **how)


def write_available(stream: DataFrame, path: str) -> None:
    """Write what a stream has now to a folder, its checkpoint beside it, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def class_counts(stream: DataFrame, options: Options | None = None, **how) -> DataFrame:
    """Running counts of token classes over a stream of documents, for complete or update mode."""
    return tokenize_stream(stream, options, **how).groupBy("token_class").agg(F.count("*").alias("n_tokens"))
