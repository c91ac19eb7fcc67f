"""``spark-submit -m segmill.plans.cli FILE -o FOLDER``: one token a line."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions.lexicons import EOS_TAGS
from ..operators.cascade import Options
from ..operators.engine import extra_info, tokenize_text, tokenize_xml
from ..sources.text import read_documents


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Segment German or English web text into tokens and sentences.")

    def option(*names: str, **how) -> None:
        """An option, its long name with hyphens or underscores."""
        p.add_argument(*dict.fromkeys(n for name in names for n in (name, name[:2] + name[2:].replace("-", "_"))), **how)

    p.add_argument("file", help="UTF-8 file, folder or pattern that Spark can read; - for standard input")
    p.add_argument("-v", "--version", action="version", version=f"segmill {__version__}")
    option("-o", "--out", required=True, help="folder for the output; - for standard output")
    option("-l", "--language", default="de_CMC", choices=["de_CMC", "en_PTB"])
    option("-s", "--paragraph-separator", default="empty_lines", choices=["empty_lines", "single_newlines"])
    option("-x", "--xml", action="store_true")
    option("--tag", action="append", default=[], help="sentence-final tag; implies --xml")
    option("--prune", action="append", default=[], help="tag to leave out with all it holds; implies --xml")
    option("--strip-tags", action="store_true", help="implies --xml")
    option("-c", "--split-camel-case", action="store_true")
    option("-t", "--token-classes", action="store_true")
    option("-e", "--extra-info", action="store_true")
    option("--character-offsets", action="store_true")
    option("--split-sentences", action="store_true")
    option("--sentence-tag", help="implies --split-sentences")
    option("--lexicon-folder", help="folder with complete word lists, where all workers can read it")
    a = p.parse_args(argv)
    a.xml = a.xml or bool(a.tag or a.prune or a.strip_tags)
    a.split_sentences = a.split_sentences or a.sentence_tag is not None
    return a


def lines(tokens: DataFrame, token_classes: bool = False, extra: bool = False, offsets: bool = False, blank_lines: bool = False) -> DataFrame:
    """(doc_id, ord, value): the output line of each token, a blank one after each sentence if asked for."""
    parts = [F.col("text")]
    own = ~F.col("markup")
    if token_classes:
        parts.append(F.when(own, F.coalesce("token_class", F.lit(""))))
    if extra:
        parts.append(F.when(own, extra_info()))
    if offsets:
        parts.append(F.when(own, F.concat_ws(", ", F.col("char_start").cast("string"), F.col("char_end").cast("string"))))
    value = F.concat_ws("\t", *parts)
    order = F.struct(F.coalesce("sent_no", F.lit(0)).alias("s"), "par_no", "tok_no")
    if not blank_lines:
        return tokens.select("doc_id", order.alias("ord"), value.alias("value"))
    after = F.lead("sent_no").over(Window.partitionBy("doc_id").orderBy("sent_no", "par_no", "tok_no"))
    ends = after.isNull() | (after != F.col("sent_no"))
    return tokens.select("doc_id", order.alias("ord"), F.when(ends, F.concat(value, F.lit("\n"))).otherwise(value).alias("value"))


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    options = Options(a.language, a.split_camel_case, a.split_sentences, a.character_offsets, a.lexicon_folder)
    docs = spark.createDataFrame([("-", sys.stdin.read())], "doc_id string, text string") if a.file == "-" else read_documents(spark, a.file)
    if a.xml:
        tokens = tokenize_xml(docs, options, a.tag or EOS_TAGS, a.strip_tags, a.prune, xml="text", xml_sentences=a.sentence_tag)
    else:
        tokens = tokenize_text(docs, options, separator=a.paragraph_separator, xml_sentences=a.sentence_tag)
    return lines(tokens, a.token_classes, a.extra_info, a.character_offsets, a.split_sentences and not a.sentence_tag)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("segmill").getOrCreate()
    began, out, n = time.time(), run(spark, a), 0
    if a.out == "-":
        for r in out.orderBy("doc_id", "ord").toLocalIterator():
            print(r.value)
            n += 1
    else:
        seen = Observation("tokens")
        # A file's lines stay together and in order; files are spread over the partitions.
        counted = out.observe(seen, F.count("*").alias("n"))
        counted.repartition("doc_id").sortWithinPartitions("doc_id", "ord").select("value").write.text(a.out)
        n = seen.get["n"]
    took = time.time() - began
    logging.info("%d tokens in %.2f s, %.0f tokens/s", n, took, n / max(took, 1e-9))


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    main()
