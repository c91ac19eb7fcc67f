"""Segmentation of DataFrames: one narrow Arrow pass, a document a row in, a token a row out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cascade import LANGUAGES, Options, Piece, segment, segment_text
from .markup import Part, chunks, normalised, parse_html, parse_xml, place_tokens
from .sentences import add_sentence_tags, mark_sentences, merge_empty, sentence_ends

_FIELDS = [
    ("par_no", pa.int32()),
    ("sent_no", pa.int32()),
    ("tok_no", pa.int32()),
    ("text", pa.string()),
    ("token_class", pa.string()),
    ("markup", pa.bool_()),
    ("markup_class", pa.string()),
    ("markup_eos", pa.bool_()),
    ("space_after", pa.bool_()),
    ("original_spelling", pa.string()),
    ("first_in_sentence", pa.bool_()),
    ("last_in_sentence", pa.bool_()),
    ("char_start", pa.int32()),
    ("char_end", pa.int32()),
]
_PIECE = [n for n, _ in _FIELDS[3:]]
#: Rows of tokens handed on at a time.
BATCH = 20_000


def paragraphs(text: str, separator: str | None) -> list[tuple[int, str]]:
    """(start, text) of each paragraph: the whole text, a line each, or lines up to and with a blank one."""
    if separator is None:
        return [(0, text)]
    lines, at, out = text.split("\n"), 0, []
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    if separator == "single_newlines":
        for line in lines:
            if line.strip():
                out.append((at, line))
            at += len(line)
    elif separator == "empty_lines":
        start = 0
        for line in lines:
            at += len(line)
            if not line.strip():  # closes what came before, or stands alone
                out.append((start, text[start:at]))
                start = at
        if start < len(text):
            out.append((start, text[start:]))
    else:
        raise ValueError("paragraphs are separated by single_newlines or empty_lines")
    return out


Unit = tuple[int, list[Piece]]


def text_units(text: str, options: Options, separator: str | None = None, absolute: bool = True) -> list[Unit]:
    """(number, tokens) of each paragraph of a text."""
    out = []
    for no, (start, par) in enumerate(paragraphs(text, separator)):
        tokens = segment_text(par, options)
        if options.character_offsets:
            base = start if absolute else 0
            place_tokens(tokens, normalised(par, [(base + i, base + i + 1) for i in range(len(par))]))
        out.append((no, tokens))
    return out


def markup_units(text: str, options: Options, eos_tags: Iterable[str] | None, prune_tags: Iterable[str] | None, html: bool = False) -> list[Unit]:
    """(number, tokens) of each chunk of an XML (or HTML) document."""
    if prune_tags and options.character_offsets:
        raise ValueError("pruned documents have no character offsets")
    parts = (parse_html if html else parse_xml)(text, eos_tags, prune_tags)
    out = []
    for no, chunk in enumerate(chunks(parts)):
        source = _source(chunk) if options.character_offsets and not html else None
        tokens = segment([p.piece for p in chunk], options)
        if source is not None:
            place_tokens(tokens, source)
        out.append((no, tokens))
    return out


def _source(chunk: list[Part]) -> list[tuple[str, int, int]]:
    out = []
    for p in chunk:
        if p.piece.markup:
            p.piece.char_start, p.piece.char_end = p.spans[0]
        else:
            out += normalised(p.piece.text, p.spans)
    return out


def sentences(units: list[Unit], options: Options) -> list[tuple[int, list[Piece]]]:
    """(unit number of its first token, tokens) of each sentence of a document, empty ones merged."""
    split, of = [], {}
    for no, tokens in units:
        mark_sentences(tokens, options.language)
        start = 0
        for end in sentence_ends(tokens):
            if end > start:
                split.append(tokens[start:end])
                of[id(tokens[start])] = no
                start = end
    return [(of[id(s[0])], s) for s in merge_empty(split) if s]


def _runs(units: list[Unit], options: Options, xml_sentences: str | None, strip_tags: bool) -> Iterator[tuple[int, int | None, int, list[Piece]]]:
    """The tokens of one document in order, a sentence or a unit at a time: (unit, sentence, number of the first token, tokens)."""
    if not options.split_sentences:
        for no, tokens in units:
            yield no, None, 0, [t for t in tokens if not t.markup] if strip_tags else tokens
        return
    found = sentences(units, options)
    bodies = [[t for t in s if not t.markup] if strip_tags else s for _, s in found]
    if xml_sentences:
        bodies = add_sentence_tags(bodies, xml_sentences)
    at: dict[int, int] = {}
    for k, ((no, _), body) in enumerate(zip(found, bodies)):
        i = at.get(no, 0)
        at[no] = i + len(body)
        yield no, k, i, body


def _rows(units: list[Unit], options: Options, xml_sentences: str | None, strip_tags: bool) -> Iterator[tuple]:
    """The tokens of one document in order, numbered."""
    for no, k, first, body in _runs(units, options, xml_sentences, strip_tags):
        yield from ((no, k, i, t) for i, t in enumerate(body, first))


def _escaped(x: str | None) -> str | None:
    return x if x is None else x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _kernel(units_of, options_of, xml_sentences: str | None, strip_tags: bool, escape: bool, id_kind: pa.DataType, fields: list[tuple[str, pa.DataType]], nested: bool):
    """Batches of documents to batches of tokens; ``nested`` keeps a row a document, with its language and an array of tokens."""
    names = [n for n, _ in fields]
    attributes = [n for n in names if n in _PIECE]
    kinds = pa.struct([pa.field(n, k) for n, k in fields])
    schema = pa.schema([("doc_id", id_kind), ("lang", pa.string()), ("tokens", pa.list_(kinds))]) if nested else pa.schema([("doc_id", id_kind), *fields])

    def made(docs: list, langs: list, ends: list[int], none: list[bool], columns: dict[str, list]) -> pa.RecordBatch:
        arrays = [pa.array(columns[n], k) for n, k in fields]
        if not nested:
            sizes = np.diff([0, *ends])
            of = pa.array(np.repeat(np.arange(len(docs)), sizes), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(docs, id_kind).take(of), *arrays], schema=schema)
        inner = pa.StructArray.from_arrays(arrays, fields=list(kinds))
        lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), inner, mask=pa.array(none, pa.bool_()) if any(none) else None)
        return pa.RecordBatch.from_arrays([pa.array(docs, id_kind), pa.array(langs, pa.string()), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, langs, ends, none = [], [], [], []
        columns: dict[str, list] = {n: [] for n in names}
        first = columns[names[0]]
        for batch in batches:
            for doc, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                if text is not None:
                    options = options_of(lang)
                    for no, k, i, body in _runs(units_of(text, options), options, xml_sentences, strip_tags):
                        if "par_no" in columns:
                            columns["par_no"] += [no] * len(body)
                        if "sent_no" in columns:
                            columns["sent_no"] += [k] * len(body)
                        if "tok_no" in columns:
                            columns["tok_no"] += range(i, i + len(body))
                        for n in attributes:
                            values = [getattr(t, n) for t in body]
                            if escape and n in ("text", "original_spelling"):
                                values = [v if t.markup else _escaped(v) for v, t in zip(values, body)]
                            columns[n] += values
                docs.append(doc)
                langs.append(lang)
                ends.append(len(first))
                none.append(text is None)
                if len(first) >= BATCH:
                    yield made(docs, langs, ends, none, columns)
                    docs, langs, ends, none = [], [], [], []
                    columns = {n: [] for n in names}
                    first = columns[names[0]]
        yield made(docs, langs, ends, none, columns)

    return run


_SPARK = {pa.int32(): T.IntegerType(), pa.string(): T.StringType(), pa.bool_(): T.BooleanType()}


def _run(df: DataFrame, text: str, id_col: str, lang: str | None, options: Options, units_of, xml_sentences, strip_tags, escape, fields: Iterable[str] | None, nested: bool) -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame with a text column is needed, not a bare text")
    if not isinstance(df.schema[text].dataType, T.StringType):
        raise TypeError(f"{text} is not a text column")
    wanted = [(n, k) for n, k in _FIELDS if fields is None or n in set(fields)]
    if not wanted or (fields is not None and set(fields) - {n for n, _ in _FIELDS}):
        raise ValueError(f"fields of a token are {', '.join(n for n, _ in _FIELDS)}")
    by_code = {options.code: options}
    kind = df.schema[id_col].dataType
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64()
    source = df.select(
        F.col(f"`{id_col}`").cast("string" if arrow == pa.string() else "long").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
        (F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string")).alias("lang"),
    )

    def options_of(code: str | None) -> Options:
        known = LANGUAGES.get(code)
        if known is None:
            return options
        if known not in by_code:
            by_code[known] = Options(code, options.split_camel_case, options.split_sentences, options.character_offsets, options.lexicon_folder)
        return by_code[known]

    own = T.StructField("doc_id", T.StringType() if arrow == pa.string() else T.LongType())
    token = T.StructType([T.StructField(n, _SPARK[k]) for n, k in wanted])
    schema = T.StructType([own, T.StructField("lang", T.StringType()), T.StructField("tokens", T.ArrayType(token))]) if nested else T.StructType([own, *token])
    return source.mapInArrow(_kernel(units_of, options_of, xml_sentences, strip_tags, escape, arrow, wanted, nested), schema)


def tokenize_text(
    df: DataFrame,
    options: Options | None = None,
    text: str = "text",
    id_col: str = "doc_id",
    lang: str | None = None,
    separator: str | None = None,
    xml_sentences: str | None = None,
    fields: Iterable[str] | None = None,
    nested: bool = False,
) -> DataFrame:
    """The tokens of the texts in ``df``, flat: doc_id, par_no, sent_no, tok_no and the token's fields.

    ``separator`` cuts a text into paragraphs first (``single_newlines`` or
    ``empty_lines``); None takes each text as one. ``lang`` names a column with the
    language of each row; rows in a language without rules, or with none, are taken in
    that of ``options``. Null texts give no tokens. With ``xml_sentences`` sentence tags
    are put in and texts XML-escaped. ``fields`` names the columns that are wanted.
    ``nested`` gives a row a document instead (doc_id, lang, tokens), whose tokens stand
    in an array: what is asked of a document then needs no shuffle; null texts have null
    tokens. The pass is narrow at any size.
    """
    options = options or Options()
    if separator not in (None, "single_newlines", "empty_lines"):
        raise ValueError("paragraphs are separated by single_newlines or empty_lines")
    if xml_sentences and not options.split_sentences:
        raise ValueError("sentence tags need sentence splitting")
    return _run(df, text, id_col, lang, options, lambda t, o: text_units(t, o, separator), xml_sentences, False, bool(xml_sentences), fields, nested)


def tokenize_xml(
    df: DataFrame,
    options: Options | None = None,
    eos_tags: Iterable[str] | None = None,
    strip_tags: bool = False,
    prune_tags: Iterable[str] | None = None,
    xml: str = "xml",
    id_col: str = "doc_id",
    lang: str | None = None,
    xml_sentences: str | None = None,
    html: bool = False,
    fields: Iterable[str] | None = None,
    nested: bool = False,
) -> DataFrame:
    """The tokens of XML documents, one a row of ``df``; tags are tokens unless stripped.

    Tags in ``eos_tags`` end sentences; elements in ``prune_tags`` are left out with all
    they hold. Texts are escaped again unless tags are stripped and none put in.
    Ill-formed XML fails; with ``html`` pages are parsed permissively instead. ``lang``,
    ``fields`` and ``nested`` are those of ``tokenize_text``.
    """
    options = options or Options()
    eos, prune = frozenset(eos_tags or ()), frozenset(prune_tags or ())
    if prune and options.character_offsets:
        raise ValueError("pruned documents have no character offsets")
    escape = bool(xml_sentences) or not strip_tags
    return _run(df, xml, id_col, lang, options, lambda t, o: markup_units(t, o, eos, prune, html), xml_sentences, strip_tags, escape, fields, nested)


def strip_tags(tokens: DataFrame) -> DataFrame:
    return tokens.filter(~F.col("markup"))


def escape_xml(text: Column) -> Column:
    """``&``, ``<`` and ``>`` as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def extra_info(token: Column | None = None) -> Column:
    """``SpaceAfter=No`` and ``OriginalSpelling="…"`` of a token row or of a token in an array, joined."""
    of = (lambda n: token[n]) if token is not None else F.col
    return F.concat_ws(", ", F.when(~of("space_after"), F.lit("SpaceAfter=No")), F.when(of("original_spelling").isNotNull(), F.concat(F.lit('OriginalSpelling="'), of("original_spelling"), F.lit('"'))))


def sentence_texts(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_no, n_tokens and the tokens of each sentence joined by spaces."""
    parts = F.sort_array(F.collect_list(F.struct("par_no", "tok_no", "text")))
    got = tokens.groupBy("doc_id", "sent_no").agg(parts.alias("t"), F.count("*").alias("n_tokens"))
    return got.select("doc_id", "sent_no", "n_tokens", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("sentence"))


def sentence_lengths(numbers: Column) -> dict[str, Column]:
    """Sentences, tokens of the longest one and tokens, of an array with the sentence number of each token in order.

    One step a token: a lambda that looks into the array again would take it anew each time.
    """

    def step(a: Column, x: Column) -> Column:
        run = F.when(x.eqNullSafe(a["at"]), a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("at"), run.alias("run"), F.greatest(a["longest"], run).alias("longest"))

    start = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("longest"))
    return {"n_sentences": F.element_at(numbers, -1) + 1, "longest": F.aggregate(numbers, start, step, lambda a: a["longest"]), "n_tokens": F.size(numbers)}


def records(tokens: Column) -> Column:
    """An array of tokens as (text, token_class, extra_info), the form that given tokens have for the sentence functions of SQL."""
    return F.transform(tokens, lambda t: F.struct(t["text"].alias("text"), t["token_class"].alias("token_class"), extra_info(t).alias("extra_info")))


def joined(tokens: Column, piece) -> Column:
    """A string of what ``piece`` makes of each token of an array."""
    return F.array_join(F.transform(tokens, piece), "")


def spelled(token: Column) -> Column:
    """A token as its text has it."""
    return F.coalesce(token["original_spelling"], token["text"])


def detokenized(tokens: Column) -> Column:
    """The text of an array of tokens put together again, each with its space."""
    return F.btrim(joined(tokens, lambda t: F.concat(spelled(t), F.when(t["space_after"], " ").otherwise(""))))


def laid_out(tokens: Column) -> Column:
    """The tokens of an array at their places, with spaces in between."""
    gap = lambda t, i: t["char_start"] - F.coalesce(F.get(tokens, i - 1)["char_end"], F.lit(0))
    return F.array_join(F.transform(tokens, lambda t, i: F.concat(F.repeat(F.lit(" "), gap(t, i)), spelled(t))), "")


def merge_empty_sentences(tokens: DataFrame) -> DataFrame:
    """Rows of (doc_id, par_no, unit_sent, tok_no, first_in_sentence, …) with ``sent_no``, the document-wide sentence.

    A unit sentence without a first token joins the one before, across units; leading
    ones join the first real one. Windows are within a document.
    """
    unit = Window.partitionBy("doc_id", "par_no", "unit_sent")
    real = F.max(F.col("first_in_sentence").cast("int")).over(unit)
    head = F.row_number().over(unit.orderBy("tok_no")) == 1
    running = F.sum(F.when(head, real).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("par_no", "tok_no"))
    return tokens.withColumn("sent_no", F.greatest(running - 1, F.lit(0)).cast("int"))
