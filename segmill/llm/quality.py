"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule says "reject when a share exceeds a cutoff". For each stratum and rule a
fixed grid of cutoffs, from the most lenient on, is tested on the labelled holdout:
the null hypothesis "more than ``alpha / rules`` of the good documents are rejected"
falls when the exact binomial tail of the observed false rejections is at most
``delta / (rules * strata)``. Testing stops at the first cutoff that isn't certified
(fixed-sequence testing, which needs no further correction along the grid). Of the
certified cutoffs the most lenient one that rejects the most bad documents is used.
With probability ``1 - delta`` no stratum then loses more than ``alpha`` of its good
documents to the rules together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ALPHA = 0.02
DELTA = 0.1
#: Strata whose cutoffs are written into the expression that applies them.
MAX_STRATA = 64
#: Cutoffs by rule, most lenient first.
GRIDS = {
    "symbol_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeat_share": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "shout_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
}


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def features(df: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """The rows of ``df`` with a struct column ``into`` of counts and shares.

    A null or empty text has no words: all counts are 0, all shares 0. Words are
    maximal runs without ASCII white space. ``n_repeat_words`` counts the words in
    three-word windows that occur twice or more in the text, exactly: equal windows
    are found by the leading bits of their hashes next to their position, sorted as
    plain integers, and confirmed on the words themselves. Other columns pass through,
    whatever their names.
    """
    names = df.columns
    own = "__quality"
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    t = df.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    t = t.select("row", "t", F.btrim("t", F.lit(SPACE)).alias("trimmed"))
    t = t.select(
        "row",
        "t",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+")).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    n = F.size("w")
    t = t.select(
        "row",
        "w",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(_without(F.col("t"), "!"))).cast("long").alias("n_shouts"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.ceil(F.log2(n + F.lit(2))).cast("int").alias("bits"),
    )
    # The window at i as hash bits over the position i.
    t = t.withColumn(
        "packed",
        F.when(
            F.size("w") >= 3,
            F.sort_array(F.transform(F.slice("w", 1, F.size("w") - 2), lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)), F.col("bits")).bitwiseOR(i.cast("long")))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    same = lambda x, y: F.coalesce(F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("bits")) == 0, F.lit(False))
    t = t.withColumn("alike", F.filter("packed", lambda x, i: same(x, F.get("packed", i - 1)) | same(x, F.get("packed", i + 1))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    t = t.withColumn(
        "windows",
        F.sort_array(
            F.transform(
                "alike",
                lambda x: F.struct(
                    F.concat_ws(" ", F.get("w", x.bitwiseAND(mask).cast("int")), F.get("w", x.bitwiseAND(mask).cast("int") + 1), F.get("w", x.bitwiseAND(mask).cast("int") + 2)).alias("g"),
                    x.bitwiseAND(mask).alias("p"),
                ),
            )
        ),
    )
    at = lambda i: F.coalesce(F.get("windows", i).getField("g"), F.lit(""))
    t = t.withColumn("starts", F.sort_array(F.transform(F.filter("windows", lambda x, i: (x.getField("g") == at(i - 1)) | (x.getField("g") == at(i + 1))), lambda x: x.getField("p"))))
    t = t.withColumn(
        "n_repeat_words",
        F.aggregate(
            "starts",
            F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct(p.alias("last"), (a.getField("n") + F.least(F.lit(3).cast("long"), p - a.getField("last"))).alias("n")),
            lambda a: a.getField("n"),
        ),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    made = F.struct(
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_shouts", "n_words").alias("shout_share"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    ).alias(own)
    t = t.select("row", made)
    return t.select(*[F.col("row").getField(c).alias(c) for c in names if c != into], F.col(own).alias(into))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term; 1 where k >= n * p, for there it is above a half anyway."""
    odds = math.log(p) - math.log1p(-p)
    first = n * F.lit(math.log1p(-p))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(
        steps,
        F.struct(first.alias("log"), F.exp(first).alias("sum")),
        lambda a, i: F.struct(
            (a.getField("log") + F.log((n - i + 1) / i) + F.lit(odds)).alias("log"),
            (a.getField("sum") + F.exp(a.getField("log") + F.log((n - i + 1) / i) + F.lit(odds))).alias("sum"),
        ),
        lambda a: a.getField("sum"),
    )
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(tail)


def fit_cutoffs(scored: DataFrame, labels: DataFrame, grids: dict[str, list[float]] | None = None, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) for each stratum and rule that has a certified cutoff worth using.

    ``scored``: doc_id, stratum and a struct ``quality``, best from a written table, since
    Catalyst works the counts out again for each use of them; ``labels``: doc_id, quality
    (1 good, 0 bad). All labelled documents count; rows with a null label, id or no
    partner are left out. Documents that fail the base rules are outside the guarantee,
    which is about the cutoffs. Labels that repeat for a document count once, as the
    worst of them. The bound takes labelled documents as independent draws; copies of a
    text that are labelled under several ids count each, so deduplicated labels are better.
    """
    grids = grids or GRIDS
    rules = len(grids)
    lab = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    rows = scored.filter(~F.col("quality.base_failed")).join(lab, "doc_id")
    level = lambda g, v: F.size(F.filter(F.array(*[F.lit(float(c)) for c in g]), lambda c: v > c))
    # The number of cutoffs a document exceeds is what counts: pre-aggregated before any shuffle.
    longs = rows.select("stratum", "good", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), (F.lit(len(g)) - level(g, F.col(f"quality.{r}"))).alias("step")) for r, g in grids.items()])))
    seen = longs.groupBy("stratum", "rule", "step").agg(F.sum((F.col("good") == 1).cast("long")).alias("good"), F.sum((F.col("good") != 1).cast("long")).alias("bad"))
    totals = seen.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("step", "good", "bad")).alias("steps"))
    strata = max(1, seen.select("stratum").distinct().count())
    grid = F.create_map(*[x for r, g in grids.items() for x in (F.lit(r), F.array(*[F.lit(float(c)) for c in g]))])
    cells = totals.select("stratum", "rule", "n_good", "steps", F.posexplode(grid[F.col("rule")]).alias("i", "cutoff"))
    below = lambda what: F.aggregate(F.filter("steps", lambda s: s.getField("step") <= F.col("i")), F.lit(0).cast("long"), lambda a, s: a + s.getField(what))
    cells = cells.select("stratum", "rule", "n_good", "i", "cutoff", below("good").alias("lost"), below("bad").alias("caught"))
    cells = cells.withColumn("certified", binomial_tail(F.col("n_good"), F.col("lost"), alpha / rules) <= F.lit(delta / rules / strata))
    by = cells.groupBy("stratum", "rule").agg(F.sort_array(F.collect_list(F.struct("i", "cutoff", "certified", "caught"))).alias("c"))
    # Up to the first that isn't certified; both lists are as long as the grid.
    first = F.coalesce(F.array_min(F.transform(F.filter("c", lambda x: ~x.getField("certified")), lambda x: x.getField("i"))), F.size("c"))
    by = by.withColumn("ok", F.filter("c", lambda x: (x.getField("i") < first) & (x.getField("caught") > 0)))
    best = F.array_max(F.transform("ok", lambda x: F.struct(x.getField("caught").alias("caught"), (-x.getField("i")).alias("lenient"), x.getField("cutoff").alias("cutoff"))))
    return by.filter(F.size("ok") > 0).select("stratum", "rule", best.getField("cutoff").alias("cutoff"))


def verdict(scored: DataFrame, cutoffs: DataFrame, grids: dict[str, list[float]] | None = None) -> DataFrame:
    """``scored`` with a boolean ``kept``: the base rules hold and no certified cutoff of the stratum is exceeded.

    Up to ``MAX_STRATA`` strata their cutoffs become part of the expression, so the rows
    don't move; more of them are joined, which deals the rows by stratum.
    """
    grids = grids or GRIDS
    found = cutoffs.limit(MAX_STRATA * len(grids) + 1).collect()
    if len(found) <= MAX_STRATA * len(grids):
        out, over = scored, F.lit(False)
        for rule in grids:
            mine = {c.stratum: c.cutoff for c in found if c.rule == rule}
            for stratum, cutoff in sorted(mine.items(), key=lambda x: (x[0] is None, x[0] or "")):
                same = F.col("stratum").isNull() if stratum is None else F.coalesce(F.col("stratum") == stratum, F.lit(False))
                over = over | (same & (F.col(f"quality.{rule}") > cutoff))
        return out.withColumn("kept", ~F.col("quality.base_failed") & ~over)
    per = cutoffs.groupBy(F.col("stratum").alias("cut_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    out = scored.join(per, scored["stratum"].eqNullSafe(per["cut_stratum"]), "left")
    over = F.lit(False)
    for rule in grids:
        over = over | F.coalesce(F.col(f"quality.{rule}") > F.try_element_at("cuts", F.lit(rule)), F.lit(False))
    return out.withColumn("kept", ~F.col("quality.base_failed") & ~over).drop("cut_stratum", "cuts")


def assess(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """doc_id, stratum, quality (struct) and kept for each row of ``docs``.

    Counts are made once and kept in the shared folder; cutoffs come from all labelled rows.
    """
    chosen = docs.select("doc_id", F.col(stratum).alias("stratum"), "text")
    scored = stash(features(chosen).drop("text"), "quality")
    return verdict(scored, fit_cutoffs(scored, labels.select("doc_id", "quality"), **how))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", F.col(stratum).alias("stratum"), "text")
    scored = stash(features(row).drop("text"), "quality")
    judged = verdict(scored, fit_cutoffs(scored.drop("row"), labels.select("doc_id", "quality"), **how))
    return judged.filter("kept").select(*[F.col("row").getField(c).alias(c) for c in names])
