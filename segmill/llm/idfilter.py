"""A bitmap of ids with a fixed size, so that a broadcast can keep rows from a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, 2 ** 26 of them in 8 MB, whatever the number of ids. A fuller bitmap lets more rows through, never fewer.
BITS = 26
#: Bits of a row of the bitmap, in words of 64.
ROW_BITS = 14


def _place(of: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(1 << bits))


def bitmap(ids: DataFrame, bits: int = BITS, row_bits: int = ROW_BITS) -> DataFrame:
    """(__segment, __words) of the one column of ``ids``: always ``2 ** (bits - row_bits)`` rows, aggregated before they are shuffled."""
    at = ids.select(_place(F.col(ids.columns[0]), bits).alias("at"))
    parts = at.select(F.shiftright("at", row_bits).alias("__segment"), F.pmod(F.shiftright("at", 6), F.lit(1 << (row_bits - 6))).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    none = ids.sparkSession.range(1 << (bits - row_bits)).select(F.col("id").alias("__segment"), F.lit(0).alias("word"), F.lit(0).cast("long").alias("bit"))
    words = parts.unionByName(none).groupBy("__segment", "word").agg(F.bit_or("bit").alias("bits"))
    rows = words.groupBy("__segment").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit((1 << (row_bits - 6)) - 1))
    return rows.select("__segment", F.transform(every, lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("__words"))


def marked(rows: DataFrame, of: str, ids: DataFrame, bits: int = BITS, row_bits: int = ROW_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``of`` may be among ``ids``, rows whose ``of`` surely isn't); nulls aren't. No shuffle of ``rows``."""
    names = rows.columns
    segments = F.broadcast(bitmap(ids, bits, row_bits))
    at = rows.withColumn("__at", _place(F.col(f"`{of}`"), bits)).withColumn("__own", F.shiftright("__at", row_bits))
    both = at.join(segments, F.col("__own") == F.col("__segment"), "left")
    word = F.get("__words", F.pmod(F.shiftright("__at", 6), F.lit(1 << (row_bits - 6))).cast("int"))
    hit = F.col(f"`{of}`").isNotNull() & F.coalesce(F.getbit(word, (F.col("__at") % 64).cast("int")) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in names]
    return both.filter(hit).select(*columns), both.filter(~hit).select(*columns)
