"""Text sources: files and columns as documents, and paragraphs with their offsets, in DataFrame functions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is unset, on this machine in local mode, else ValueError."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="segmill-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


SEPARATORS = ("single_newlines", "empty_lines")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of each UTF-8 file under ``path``; the file's path is its id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def read_lexicon(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """(entry) of a word list: one entry a line, blank lines and ``#`` comments left out, distinct; longest first, then by text."""
    entry = F.trim("value")
    rows = spark.read.text(path).select((F.lower(entry) if lower else entry).alias("entry"))
    return rows.filter((F.col("entry") != "") & ~F.col("entry").startswith("#")).distinct().orderBy(F.desc(F.length("entry")), "entry")


def lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, start, line): each line with its newline, and its first character's place in the text."""
    parts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text}`"), r"(?<=\n)", -1)).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.filter("line != ''").withColumn("start", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)).cast("long")).select("doc_id", "line_no", "start", "line")


def paragraphs(docs: DataFrame, separator: str = "empty_lines", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, par_no, par_start, text) of the paragraphs in each text.

    ``single_newlines``: a line each, blank ones left out but counted in the offsets.
    ``empty_lines``: a paragraph ends with its blank line, and each further blank line is
    a paragraph of its own. Null and empty texts have none. Windows stay within a text.
    """
    if separator not in SEPARATORS:
        raise ValueError(f"paragraphs are separated by {' or '.join(SEPARATORS)}")
    found = lines(docs, text, id_col)
    blank = F.col("line").rlike(r"(?U)^\s*$")
    if separator == "single_newlines":
        kept = found.filter(~blank)
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
        return kept.select("doc_id", number.cast("int").alias("par_no"), F.col("start").alias("par_start"), F.col("line").alias("text"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = found.withColumn("par_no", F.coalesce(F.sum(blank.cast("int")).over(before), F.lit(0)).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "")
    return numbered.groupBy("doc_id", "par_no").agg(F.min("start").alias("par_start"), joined.alias("text"))
