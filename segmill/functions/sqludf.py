"""The engine in SQL: table and scalar functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cascade import Options, Piece, segment_text
from ..operators.engine import sentences, text_units
from ..operators.sentences import mark_sentences, sentence_numbers

_WORDS = T.ArrayType(T.StringType())
_ROW = T.StructType([T.StructField("sent_no", T.IntegerType()), T.StructField("tok_no", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("token", "token_class", "extra_info"))])
_options: dict[str, Options] = {}


def options_for(language: str) -> Options:
    if language not in _options:
        _options[language] = Options(language)
    return _options[language]


@F.udtf(returnType=_ROW)
class TokenizeText:
    """``SELECT … FROM docs, LATERAL segmill_tokenize(text, 'de')``."""

    def eval(self, text: str, language: str):
        if text is None:
            return
        options = options_for(language)
        i = 0
        for k, (_, body) in enumerate(sentences(text_units(text, options), options)):
            for t in body:
                yield k, i, t.text, t.token_class, t.extra_info
                i += 1


@F.pandas_udf(_WORDS)
def tokens_de(texts: pd.Series) -> pd.Series:
    """German tokens of a text."""
    return texts.map(lambda t: None if t is None else [p.text for p in segment_text(t, options_for("de"))])


@F.pandas_udf(_WORDS)
def tokens_en(texts: pd.Series) -> pd.Series:
    """English tokens of a text."""
    return texts.map(lambda t: None if t is None else [p.text for p in segment_text(t, options_for("en"))])


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed characters, as the cascade's first pass makes them."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _is_tag(token: str) -> bool:
    return len(token) > 2 and token[0] == "<" and token[-1] == ">" and (token[1].isalpha() or token[1] in "/_:")


def _piece(token: str, eos_tags) -> Piece:
    if eos_tags is None or not _is_tag(token):
        return Piece(token)
    end = token[1] == "/"
    name = token.strip("</>").split()[0].rstrip("/")
    return Piece(token, None, True, "end" if end else "start", (name if end else name.rpartition(":")[2]) in eos_tags, True)


def split_numbers(tokens: list[str], language: str = "de_CMC", eos_tags=None) -> list[int]:
    """For each of given tokens the number of its sentence; with ``eos_tags`` tags among them are recognised, and those named end sentences."""
    pieces = [_piece(t, eos_tags) for t in tokens]
    first, last = True, None
    for p in pieces:
        if not p.markup:
            p.first_in_sentence, first, last = first, False, p
        elif p.markup_eos:
            first = True
            if last is not None:
                last.last_in_sentence = True
    mark_sentences(pieces, language)
    numbers = sentence_numbers(pieces)
    real = {k for k, p in zip(numbers, pieces) if p.first_in_sentence}
    # A sentence without a first token joins the one before, at the start the first real one.
    return [max(0, sum(r <= k for r in real) - 1) for k in numbers]


def split_tokens(tokens: list, language: str = "de_CMC", eos_tags=None, text=lambda t: t) -> list[list]:
    """Given tokens in sentences; ``text`` takes a token's text out of a record."""
    out: list[list] = [[]]
    for k, t in zip(split_numbers([text(t) for t in tokens], language, eos_tags), tokens):
        while len(out) <= k:
            out.append([])
        out[k].append(t)
    return out


_RECORDS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "token_class", "extra_info")]))


def _splitters(language: str) -> dict:
    """Functions for arrays of strings, of strings with tags, and of records whose first field is the token."""

    @F.pandas_udf(T.ArrayType(_WORDS))
    def split(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else split_tokens(list(x), language))

    @F.pandas_udf(T.ArrayType(_WORDS))
    def split_xml(column: pd.Series, tags: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else split_tokens(list(x), language, frozenset(() if t is None else t)) for x, t in zip(column, tags)])

    @F.pandas_udf(T.ArrayType(_RECORDS))
    def split_records(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else split_tokens(list(x), language, text=lambda t: t["text"]))

    return {f"segmill_split_{language}": split, f"segmill_split_xml_{language}": split_xml, f"segmill_split_records_{language}": split_records}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: segmill_tokenize, and for de and en segmill_tokens_, segmill_split_, segmill_split_xml_ and segmill_split_records_; segmill_nfc."""
    spark.udtf.register("segmill_tokenize", TokenizeText)
    spark.udf.register("segmill_tokens_de", tokens_de)
    spark.udf.register("segmill_tokens_en", tokens_en)
    spark.udf.register("segmill_nfc", nfc)
    for language in ("de", "en"):
        for name, function in _splitters(language).items():
            spark.udf.register(name, function)
