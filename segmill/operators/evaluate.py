"""Scoring a segmentation against a gold standard, on characters with boundary flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def characters(rows: DataFrame, ignore_tags: bool = False) -> DataFrame:
    """(file, pos, ch, token_end, sentence_end) from lines of one token each: (file, line_no, token).

    A blank line ends a sentence. With ``ignore_tags`` lines that are a tag are left out.
    """
    t = rows.select("file", "line_no", F.coalesce(F.trim("token"), F.lit("")).alias("token"))
    if ignore_tags:
        t = t.filter(~F.col("token").rlike(r"^<[^>]*>$"))
    order = Window.partitionBy("file").orderBy("line_no")
    t = t.withColumn("ends", F.coalesce(F.lead("token").over(order) == "", F.lit(True))).filter("token != ''")
    t = t.withColumn("base", F.coalesce(F.sum(F.length("token")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = t.select("file", "base", "ends", F.length("token").alias("n"), F.posexplode(F.split("token", "")).alias("i", "ch"))
    last = F.col("i") == F.col("n") - 1
    return each.select("file", (F.col("base") + F.col("i")).cast("long").alias("pos"), "ch", last.alias("token_end"), (last & F.col("ends")).alias("sentence_end"))


def aligned(gold: DataFrame, system: DataFrame) -> DataFrame:
    """Both sides' characters by file and place; null where a side has none."""
    g = gold.select("file", "pos", F.col("ch").alias("gold_ch"), F.col("token_end").alias("gold_tok"), F.col("sentence_end").alias("gold_sent"))
    s = system.select("file", "pos", F.col("ch").alias("sys_ch"), F.col("token_end").alias("sys_tok"), F.col("sentence_end").alias("sys_sent"))
    return g.join(s, ["file", "pos"], "full_outer")


def mismatches(both: DataFrame) -> DataFrame:
    """(file, differing, first_at): characters that differ between the sides; no rows if the texts are the same."""
    return both.filter(~F.col("gold_ch").eqNullSafe(F.col("sys_ch"))).groupBy("file").agg(F.count("*").alias("differing"), F.min("pos").alias("first_at"))


def _counts(kind: str) -> list[Column]:
    g, s = F.col(f"gold_{kind}"), F.col(f"sys_{kind}")
    return [F.count_if(g & s).alias(f"{kind}_tp"), F.count_if(~g & s).alias(f"{kind}_fp"), F.count_if(g & ~s).alias(f"{kind}_fn")]


def _measures(kind: str) -> dict[str, Column]:
    tp, fp, fn = (F.col(f"{kind}_{x}").cast("double") for x in ("tp", "fp", "fn"))
    return {f"{kind}_p": F.try_divide(tp, tp + fp), f"{kind}_r": F.try_divide(tp, tp + fn), f"{kind}_f1": F.try_divide(2 * tp, 2 * tp + fp + fn)}


def scores(both: DataFrame) -> DataFrame:
    """Per file: true and false positives and false negatives of token and sentence ends, precision, recall, F1; null without a denominator."""
    per = both.groupBy("file").agg(*_counts("tok"), *_counts("sent"))
    return per.withColumns(_measures("tok") | _measures("sent"))


def total(per_file: DataFrame) -> DataFrame:
    """The corpus row: means weighted by each file's gold tokens, and for sentences by the system's sentences."""
    weight = {"tok": F.col("tok_tp") + F.col("tok_fn"), "sent": F.col("sent_tp") + F.col("sent_fp")}
    sums = [F.sum(f"{k}_{c}").alias(f"{k}_{c}") for k in weight for c in ("tp", "fp", "fn")]
    means = [F.try_divide(F.sum(weight[k] * F.col(f"{k}_{m}")), F.sum(weight[k])).alias(f"{k}_{m}") for k in weight for m in ("p", "r", "f1")]
    return per_file.agg(*sums, *means).select(F.lit("TOTAL").alias("file"), "*")


def concordance(both: DataFrame, context: int = 20) -> DataFrame:
    """(file, pos, error, line): each wrong boundary with ``context`` characters on either side.

    ■ marks a missed token end, □ a false one, ● a missed sentence end, ○ a false one.
    """
    order = Window.partitionBy("file").orderBy("pos")
    ch = F.coalesce("gold_ch", "sys_ch")
    around = lambda a, b: F.array_join(F.collect_list(ch).over(order.rowsBetween(a, b)), "")
    shown = both.withColumn("left", around(-context, 0)).withColumn("right", around(1, context))
    wrong = F.filter(
        F.array(*[F.when(cond, F.lit(mark)) for cond, mark in ((F.col("gold_tok") & ~F.col("sys_tok"), "■"), (~F.col("gold_tok") & F.col("sys_tok"), "□"), (F.col("gold_sent") & ~F.col("sys_sent"), "●"), (~F.col("gold_sent") & F.col("sys_sent"), "○"))]),
        lambda x: x.isNotNull(),
    )
    return shown.select("file", "pos", F.explode(wrong).alias("error"), "left", "right").select("file", "pos", "error", F.concat("left", "error", "right").alias("line"))


def baseline(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tok_no, token) of the plain baseline: spaces around a few punctuation marks, then cut at white space."""
    spaced = F.regexp_replace(F.col(f"`{text}`"), r"([.!?,;:+*()\"'–])", r" $1 ")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.filter(F.split(spaced, r"[ \t\n\r\f]+"), lambda x: x != "")).alias("tok_no", "token"))
