"""The registered queries of the segmentation engine and their SQL forms.

Each query runs over its whole tables. Documents are segmented in their language, those
in a language without rules in German. The golden rows have a module of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons, native, sqludf
from ..functions.lexicons import EOS_TAGS
from ..operators import evaluate
from ..operators.cascade import Options
from ..operators.engine import detokenized, escape_xml, joined, laid_out, merge_empty_sentences, sentence_lengths, sentence_texts, spelled, tokenize_text, tokenize_xml
from ..sources.text import paragraphs, scratch
from ..streaming.tokens import tokenize_stream, write_available
from . import golden

_WORD_RUN = r"[\p{L}\p{N}_]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def _spread(df: DataFrame) -> DataFrame:
    """Rows spread over all cores before a costly pass: small files come as one partition, and long texts bunch up."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * n) if df.rdd.getNumPartitions() < n else df


def _tokens(spark: SparkSession, sf_dir: str, fields: list[str], split_sentences: bool = False, character_offsets: bool = False, separator: str | None = None) -> DataFrame:
    """A row a document with the array of its tokens."""
    options = Options(split_sentences=split_sentences, character_offsets=character_offsets)
    return tokenize_text(_spread(_docs(spark, sf_dir)), options, lang="lang", separator=separator, fields=fields, nested=True)


def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by language and class. A document's counts come from its own row, so only sums are shuffled."""
    docs = _tokens(spark, sf_dir, ["token_class"], separator="single_newlines").select("lang", F.col("tokens.token_class").alias("c"))
    per = docs.select("lang", "c", F.explode(F.array_distinct("c")).alias("token_class"))
    counts = per.select("lang", "token_class", F.size(F.filter("c", lambda x: x == F.col("token_class"))).alias("n"))
    return counts.groupBy("lang", "token_class").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_docs"))


def spaces_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.btrim(F.regexp_replace("text", r"[ \t\n\r\f]+", " "))).alias("text_md5"))


def baseline_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.baseline(_docs(spark, sf_dir))


def line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(_docs(spark, sf_dir), "single_newlines").select("doc_id", "par_no", "par_start", F.md5("text").alias("par_md5"))


def block_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-line paragraphs of the conversations' turns, joined by blank lines in their order."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    docs = turns.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
    return paragraphs(docs, "empty_lines").groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max("par_start").alias("last_start"))


def _per_doc(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = native.extract(_docs(spark, sf_dir), name)
        return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("match")), "|")).alias("matches_md5"))

    return query


def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = native.extract(_table(spark, sf_dir, "pages"), "entity", "html", "page_id")
    return hits.groupBy(F.col("match").alias("entity")).agg(F.count("*").alias("n"))


def escaped_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(escape_xml(F.col("text"))).alias("text_md5"))


def sentences_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("text", r"[.!?]+"), lambda x: F.btrim(x, F.lit(" \t\n\r\f")) != "")
    return _docs(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("n_sentences"))


def controls_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(native.strip_invisible(native.strip_controls(F.col("text")))).alias("text_md5"))


def abbreviation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = native.members(native.extract(_docs(spark, sf_dir), "bare_dot_word"), lexicons.ABBREVIATIONS["en"])
    return hits.groupBy(F.lower("match").alias("abbreviation")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def tokens_conserve_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of each document's tokens, without white space: none is lost or made up."""
    tokens = _tokens(spark, sf_dir, ["text", "original_spelling"], separator="single_newlines")
    return tokens.select("doc_id", F.md5(F.regexp_replace(joined(F.col("tokens"), spelled), r"[ \t\n\r\f]+", "")).alias("chars_md5"))


def stream_conserves_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``tokens_conserve_text``, the documents read, segmented and written as a stream."""
    docs = _docs(spark, sf_dir)
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern: the table may be a file or a folder
    tokens = tokenize_stream(stream, Options(split_sentences=False), lang="lang", separator="single_newlines", fields=["text", "original_spelling"], nested=True)
    path = scratch(spark, "stream")
    write_available(tokens.select("doc_id", joined(F.col("tokens"), spelled).alias("chars")), path)
    return spark.read.schema("doc_id long, chars string").parquet(path).select("doc_id", F.md5(F.regexp_replace("chars", r"[ \t\n\r\f]+", "")).alias("chars_md5"))


def tokens_detokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each document put together from its tokens and the spaces after them."""
    return _tokens(spark, sf_dir, ["text", "original_spelling", "space_after"]).select("doc_id", F.md5(detokenized(F.col("tokens"))).alias("text_md5"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each document laid out from its tokens and their places."""
    tokens = _tokens(spark, sf_dir, ["text", "original_spelling", "char_start", "char_end"], character_offsets=True, separator="single_newlines")
    return tokens.select("doc_id", F.md5(laid_out(F.col("tokens"))).alias("text_md5"))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document and their lengths in tokens."""
    t = _tokens(spark, sf_dir, ["sent_no"], split_sentences=True).select("doc_id", F.col("tokens.sent_no").alias("s"))
    return t.filter(F.size("s") > 0).select("doc_id", *[c.cast("long").alias(n) for n, c in sentence_lengths(F.col("s")).items()])


_DECOMPOSED = {"ä": "a\u0308", "ö": "o\u0308", "ü": "u\u0308", "é": "e\u0301", "è": "e\u0300", "ñ": "n\u0303", "ç": "c\u0327"}


def nfc_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with letters and marks apart, composed by the function that the first pass uses."""
    apart = F.col("text")
    for whole, parts in _DECOMPOSED.items():
        apart = F.replace(apart, F.lit(whole), F.lit(parts))
    docs = _docs(spark, sf_dir).select("doc_id", sqludf.nfc(apart).alias("t"), F.length(apart).cast("long").alias("n_apart"))
    return docs.select("doc_id", F.md5("t").alias("text_md5"), "n_apart")


def _as_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as XML: a p element a line, and an element to prune."""
    body = F.replace(escape_xml(F.col("text")), F.lit("\n"), F.lit("</p><p>"))
    return _docs(spark, sf_dir).select("doc_id", "lang", F.concat(F.lit("<doc><p>"), body, F.lit("</p><del>weg <b>damit</b></del></doc>")).alias("xml"))


def document_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, chunks and characters of the documents as XML, a p element a line."""
    docs = _spread(_as_xml(spark, sf_dir))
    t = tokenize_xml(docs, Options(split_sentences=False), ["p"], prune_tags=["del"], lang="lang", fields=["par_no", "text", "original_spelling", "markup", "markup_class"], nested=True)
    of = lambda kind: F.size(F.filter("tokens", lambda x: x["markup_class"] == kind)).cast("long")
    plain = F.filter("tokens", lambda x: ~x["markup"])
    return t.select("doc_id", of("start").alias("n_start"), of("end").alias("n_end"), (F.array_max("tokens.par_no") + 1).cast("long").alias("n_chunks"), F.md5(F.regexp_replace(joined(plain, spelled), r"\s+", "")).alias("chars_md5"))


def document_tags_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the documents as XML, without tags and with entities resolved."""
    docs = _spread(_as_xml(spark, sf_dir))
    t = tokenize_xml(docs, Options(split_sentences=False), ["p"], strip_tags=True, prune_tags=["del"], lang="lang", fields=["text", "original_spelling", "markup"], nested=True)
    return t.select("doc_id", F.size(F.filter("tokens", lambda x: x["markup"])).cast("long").alias("n_tags"), F.md5(F.regexp_replace(joined(F.col("tokens"), spelled), r"\s+", "")).alias("chars_md5"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space words as gold, the baseline's tokens as system, side by side; a word with an end mark ends a sentence on either side."""
    docs = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    words = docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda x: x != "")).alias("tok_no", "token"))

    def side(tokens: DataFrame) -> DataFrame:
        parts = F.when(F.col("token").rlike(r"[.!?]$"), F.array("token", F.lit(""))).otherwise(F.array("token"))
        rows = tokens.select(F.col("doc_id").alias("file"), "tok_no", F.posexplode(parts).alias("k", "token"))
        return evaluate.characters(rows.select("file", (F.col("tok_no") * 2 + F.col("k")).alias("line_no"), "token"))

    return evaluate.aligned(side(words), side(evaluate.baseline(docs)))


def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, precision, recall and F1 of the baseline against white-space words, by item and in all."""
    per = evaluate.scores(_scored(spark, sf_dir))
    both = per.withColumn("file", F.col("file").cast("string")).unionByName(evaluate.total(per))
    return both.select(*[F.col(c) if c == "file" else F.round(c, 9).alias(c) if c[-2:] in ("_p", "_r", "f1") else F.col(c).cast("long").alias(c) for c in both.columns])


def evaluation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concordance of the baseline's wrong boundaries."""
    return evaluate.concordance(_scored(spark, sf_dir), 20)


def benchmark_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return sentence_texts(tokenize_text(items, Options("en_PTB")))


def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline tokenizer scored against the cascade, over the benchmark items."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    gold = tokenize_text(items, Options("en_PTB", split_sentences=False))
    side = lambda t, no: t.select(F.col("doc_id").alias("file"), F.col(no).alias("line_no"), F.col("token"))
    g = evaluate.characters(side(gold.withColumnRenamed("text", "token"), "tok_no"))
    s = evaluate.characters(side(evaluate.baseline(items), "tok_no"))
    return evaluate.scores(evaluate.aligned(g, s))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, sentences and markup of the pages, parsed permissively, without scripts and styles."""
    pages = _spread(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml")))
    t = tokenize_xml(pages, Options("en_PTB"), EOS_TAGS, prune_tags=["script", "style"], html=True, fields=["sent_no", "markup"], nested=True)
    tags = F.size(F.filter("tokens", lambda x: x["markup"])).cast("long")
    return t.filter(F.size("tokens") > 0).select("doc_id", tags.alias("n_tags"), (F.size("tokens") - tags).alias("n_tokens"), F.size(F.array_distinct("tokens.sent_no")).cast("long").alias("n_sentences"))


def role_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the conversations by role."""
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "role", "conv_id", "turn").alias("doc_id"), "text")
    t = tokenize_text(_spread(turns), Options("en_PTB", split_sentences=False), fields=["tok_no"], nested=True)
    return t.groupBy(F.substring_index("doc_id", ":", 1).alias("role")).agg(F.sum(F.size("tokens")).alias("n_tokens"))


def camel_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each class with camel case split, all documents in German."""
    docs = _spread(_docs(spark, sf_dir))
    return tokenize_text(docs, Options("de_CMC", split_camel_case=True, split_sentences=False), fields=["token_class"]).groupBy("token_class").agg(F.count("*").alias("n_tokens"))


_UNITS = [(1, 0, 0, True), (1, 0, 1, False), (1, 1, 0, False), (1, 2, 0, True), (2, 0, 0, False), (2, 1, 0, True), (2, 1, 1, True), (2, 2, 0, False), (3, 0, 0, False)]


def merged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty sentences merged into their neighbours, on a fixed table of unit sentences of two tokens each."""
    units = spark.createDataFrame(_UNITS, "doc_id int, par_no int, unit_sent int, real boolean")
    rows = units.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    rows = rows.select("doc_id", "par_no", "unit_sent", (F.col("unit_sent") * 2 + F.col("k")).alias("tok_no"), (F.col("real") & (F.col("k") == 0)).alias("first_in_sentence"))
    return merge_empty_sentences(rows).select("doc_id", "par_no", "tok_no", "sent_no")


def merged_line_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty sentences of the documents merged into their neighbours.

    Lines are paragraphs; their runs of end marks and what lies between are the unit
    sentences, one row each, and those without a word are empty.
    """
    units = F.filter(F.regexp_extract_all("text", F.lit(r"[^.!?]+|[.!?]+"), F.lit(0)), lambda x: x.rlike(r"[^ \t\n\r\f]"))
    rows = paragraphs(_docs(spark, sf_dir), "single_newlines").select("doc_id", "par_no", F.posexplode(units).alias("unit_sent", "unit"))
    rows = rows.select("doc_id", "par_no", "unit_sent", F.col("unit_sent").alias("tok_no"), F.col("unit").rlike(_WORD_RUN).alias("first_in_sentence"))
    return merge_empty_sentences(rows).select("doc_id", "par_no", "tok_no", "sent_no")


QUERIES = {
    "token_classes": token_classes,
    "spaces_md5": spaces_md5,
    "baseline_tokens": baseline_tokens,
    "line_paragraphs": line_paragraphs,
    "block_paragraphs": block_paragraphs,
    "question_exclamation_runs": _per_doc("question_exclamation"),
    "email_hits": _per_doc("email"),
    "number_runs": _per_doc("number"),
    "word_runs": _per_doc("word"),
    "ellipsis_runs": _per_doc("ellipsis"),
    "page_entities": page_entities,
    "escaped_md5": escaped_md5,
    "sentences_naive": sentences_naive,
    "controls_stripped": controls_stripped,
    "abbreviation_candidates": abbreviation_candidates,
    "tokens_conserve_text": tokens_conserve_text,
    "stream_conserves_text": stream_conserves_text,
    "tokens_detokenized": tokens_detokenized,
    "token_offsets": token_offsets,
    "sentence_stats": sentence_stats,
    "benchmark_sentences": benchmark_sentences,
    "baseline_scores": baseline_scores,
    "page_text": page_text,
    "role_tokens": role_tokens,
    "camel_case": camel_case,
    "merged_sentences": merged_sentences,
    "merged_line_sentences": merged_line_sentences,
    "nfc_md5": nfc_md5,
    "document_markup": document_markup,
    "document_tags_stripped": document_tags_stripped,
    "evaluation_scores": evaluation_scores,
    "evaluation_errors": evaluation_errors,
}


def queries() -> dict:
    return QUERIES | golden.queries()


def _runs_sql(pattern: str) -> str:
    return f"""SELECT doc_id, count(*) AS n, md5(string_agg(m, '|' ORDER BY m)) AS matches_md5
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m FROM documents) GROUP BY doc_id"""


_COUNTS = [f"{k}_{c}" for k in ("tok", "sent") for c in ("tp", "fp", "fn")]
_RATIOS = [f"{k}_{m}" for k in ("tok", "sent") for m in ("p", "r", "f1")]
_WEIGHT = {"tok": "(tok_tp + tok_fn)", "sent": "(sent_tp + sent_fp)"}
#: Ends of tokens and sentences as places in the text without white space; a ratio without a denominator is null.
_SCORED_SQL = r"""WITH w AS (SELECT item_id AS file, text, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS g,
        list_filter(regexp_split_to_array(regexp_replace(text, '([.!?,;:+*()"''–])', ' \1 ', 'g'), '[ \t\n\r\f]+'), lambda x: x <> '') AS s FROM benchmark),
    e AS (SELECT file, 'g' AS side, len(array_to_string(g[1:i], '')) - 1 AS pos, regexp_matches(g[i], '[.!?]$') OR i = len(g) AS ends FROM (SELECT file, g, unnest(range(1, len(g) + 1)) AS i FROM w)
        UNION ALL SELECT file, 's', len(array_to_string(s[1:i], '')) - 1, regexp_matches(s[i], '[.!?]$') OR i = len(s) FROM (SELECT file, s, unnest(range(1, len(s) + 1)) AS i FROM w)),
    b AS (SELECT file, pos, bool_or(side = 'g') AS g, bool_or(side = 's') AS s, bool_or(side = 'g' AND ends) AS gs, bool_or(side = 's' AND ends) AS ss FROM e GROUP BY file, pos),
    c AS (SELECT file, count(*) FILTER (g AND s) AS tok_tp, count(*) FILTER (s AND NOT g) AS tok_fp, count(*) FILTER (g AND NOT s) AS tok_fn,
        count(*) FILTER (gs AND ss) AS sent_tp, count(*) FILTER (ss AND NOT gs) AS sent_fp, count(*) FILTER (gs AND NOT ss) AS sent_fn FROM b GROUP BY file),
    m AS (SELECT *, tok_tp / nullif(tok_tp + tok_fp, 0) AS tok_p, tok_tp / nullif(tok_tp + tok_fn, 0) AS tok_r, 2 * tok_tp / nullif(2 * tok_tp + tok_fp + tok_fn, 0) AS tok_f1,
        sent_tp / nullif(sent_tp + sent_fp, 0) AS sent_p, sent_tp / nullif(sent_tp + sent_fn, 0) AS sent_r, 2 * sent_tp / nullif(2 * sent_tp + sent_fp + sent_fn, 0) AS sent_f1 FROM c)
    """
#: A chunk a line with words, since each p element ends sentences; what follows the last one is a chunk of its own, unless no line has words.
_MARKUP_SQL = r"""SELECT doc_id, CAST(1 + len(p) AS BIGINT) AS n_start, CAST(1 + len(p) AS BIGINT) AS n_end,
        CAST(greatest(len(list_filter(p, lambda x: regexp_matches(x, '\S'))), 1) + CASE WHEN regexp_matches(text, '\S') AND NOT regexp_matches(p[len(p)], '\S') THEN 1 ELSE 0 END AS BIGINT) AS n_chunks,
        md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\s+', '', 'g')) AS chars_md5 FROM (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)"""
_BLANK = r"'^[ \t\n\r\f]*$'"


def oracle_sql() -> dict[str, str]:
    words = ", ".join(f"('{a}')" for a in sorted(set(lexicons.ABBREVIATIONS["en"])))
    units = ", ".join(f"({d}, {p}, {u}, {str(r).lower()})" for d, p, u, r in _UNITS)
    lines = """l AS (SELECT doc_id, i - 1 AS line_no, parts[i] || CASE WHEN i < len(parts) THEN chr(10) ELSE '' END AS line
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d)) WHERE NOT (i = len(parts) AND parts[i] = ''))"""
    apart = "text"
    for whole, parts in _DECOMPOSED.items():
        apart = f"replace({apart}, '{whole}', '{parts}')"
    return golden.oracle_sql() | {
        "nfc_md5": f"SELECT doc_id, md5(nfc_normalize({apart})) AS text_md5, CAST(length({apart}) AS BIGINT) AS n_apart FROM documents",
        "document_markup": _MARKUP_SQL,
        "document_tags_stripped": rf"SELECT doc_id, CAST(0 AS BIGINT) AS n_tags, md5(regexp_replace(text, '\s+', '', 'g')) AS chars_md5 FROM documents",
        "evaluation_scores": _SCORED_SQL + f"""SELECT CAST(file AS VARCHAR) AS file, {', '.join(_COUNTS)}, {', '.join(f'round({r}, 9) AS {r}' for r in _RATIOS)} FROM m
            UNION ALL SELECT 'TOTAL', {', '.join(f'CAST(sum({c}) AS BIGINT)' for c in _COUNTS)}, {', '.join(f'round(sum({w} * {r}) / sum({w}), 9)' for r in _RATIOS for w in [_WEIGHT[r.partition('_')[0]]])} FROM m""",
        "evaluation_errors": _SCORED_SQL + """SELECT file, CAST(pos AS BIGINT) AS pos, error, substring(t, greatest(pos - 19, 1), least(pos + 1, 21)) || error || substring(t, pos + 2, 20) AS line
            FROM (SELECT file, pos, unnest(list_filter([CASE WHEN g AND NOT s THEN '■' END, CASE WHEN s AND NOT g THEN '□' END, CASE WHEN gs AND NOT ss THEN '●' END, CASE WHEN ss AND NOT gs THEN '○' END], lambda x: x IS NOT NULL)) AS error FROM b)
            JOIN (SELECT item_id AS file, regexp_replace(text, '[ \t\n\r\f]+', '', 'g') AS t FROM benchmark) USING (file)""",
        "spaces_md5": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS text_md5 FROM documents",
        "baseline_tokens": r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS tok_no, t[i] AS token FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (
            SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?,;:+*()"''–])', ' \1 ', 'g'), '[ \t\n\r\f]+'), lambda x: x <> '') AS t FROM documents))""",
        "line_paragraphs": f"""WITH d AS (SELECT doc_id, text FROM documents), {lines},
            p AS (SELECT *, CAST(coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS par_start FROM l)
            SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS par_no, par_start, md5(line) AS par_md5 FROM p WHERE NOT regexp_matches(line, {_BLANK})""",
        "block_paragraphs": f"""WITH d AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), {lines},
            p AS (SELECT *, sum(length(line)) OVER w AS begin_at, sum(CASE WHEN regexp_matches(line, {_BLANK}) THEN 1 ELSE 0 END) OVER w AS par FROM l
                WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            g AS (SELECT doc_id, coalesce(par, 0) AS par, CAST(min(coalesce(begin_at, 0)) AS BIGINT) AS start FROM p GROUP BY ALL)
            SELECT doc_id, count(*) AS n_paragraphs, max(start) AS last_start FROM g GROUP BY doc_id""",
        "question_exclamation_runs": _runs_sql("[!?]+"),
        "email_hits": _runs_sql(r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_.-]+\.\p{L}{2,}"),
        "number_runs": _runs_sql("[0-9]+"),
        "word_runs": _runs_sql(_WORD_RUN),
        "ellipsis_runs": _runs_sql(r"\.{2,}|…+(?:\.{2,})?"),
        "page_entities": r"""SELECT m AS entity, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '&(?:quot|amp|apos|lt|gt|#[0-9]+|#x[0-9a-fA-F]+);')) AS m FROM pages) GROUP BY m""",
        "escaped_md5": "SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS text_md5 FROM documents",
        "sentences_naive": r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '[ \t\n\r\f]', '', 'g') <> '')) AS BIGINT) AS n_sentences FROM documents""",
        "controls_stripped": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}]', '', 'g'), '[\x{AD}\x{61C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{FEFF}]', '', 'g')) AS text_md5 FROM documents""",
        "abbreviation_candidates": rf"""SELECT lower(m) AS abbreviation, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\p{{L}}+\.')) AS m FROM documents)
            WHERE lower(m) IN (SELECT * FROM (VALUES {words})) GROUP BY lower(m)""",
        "stream_conserves_text": r"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\r\f]+', '', 'g')) AS chars_md5 FROM documents",
        "tokens_conserve_text": rf"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\r\f]+', '', 'g')) AS chars_md5 FROM documents",
        "tokens_detokenized": rf"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS text_md5 FROM documents",
        "token_offsets": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t\n\r\f]', ' ', 'g'), ' +$', '')) AS text_md5 FROM documents",
        "merged_sentences": f"""WITH u(doc_id, par_no, unit_sent, real) AS (VALUES {units}),
            n AS (SELECT *, greatest(sum(CASE WHEN real THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY par_no, unit_sent) - 1, 0) AS s FROM u)
            SELECT doc_id, par_no, CAST(unit_sent * 2 + k AS INTEGER) AS tok_no, CAST(s AS INTEGER) AS sent_no FROM n, (VALUES (0), (1)) AS t(k)""",
        "merged_line_sentences": rf"""WITH d AS (SELECT doc_id, text FROM documents), {lines},
            p AS (SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS par_no FROM l WHERE NOT regexp_matches(line, {_BLANK})),
            q AS (SELECT doc_id, par_no, list_filter(regexp_extract_all(line, '[^.!?]+|[.!?]+'), lambda x: regexp_matches(x, '[^ \t\n\r\f]')) AS t FROM p),
            u AS (SELECT doc_id, par_no, CAST(i - 1 AS INTEGER) AS tok_no, regexp_matches(t[i], '{_WORD_RUN}') AS real FROM (SELECT doc_id, par_no, t, unnest(range(1, len(t) + 1)) AS i FROM q))
            SELECT doc_id, par_no, tok_no, CAST(greatest(sum(CASE WHEN real THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY par_no, tok_no) - 1, 0) AS INTEGER) AS sent_no FROM u""",
    }
