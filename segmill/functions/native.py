"""Single passes as Column expressions, where Spark's own functions can say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse_spaces(text: Column) -> Column:
    """White space of any kind as one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", "")


def strip_invisible(text: Column) -> Column:
    """Without soft hyphens, zero-width characters and direction marks."""
    return F.regexp_replace(text, r"[\u00AD\u061C\u200B-\u200F\u202A-\u202E\u2060\u2066-\u2069\uFEFF]", "")


def cleaned(text: Column) -> Column:
    """The plain part of normalisation: spaces, controls and invisible characters."""
    return F.trim(collapse_spaces(strip_invisible(strip_controls(collapse_spaces(text)))))


def found(text: Column, pattern: str) -> Column:
    """All matches of a Java pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


#: Patterns of passes that need no look at their surroundings.
PATTERNS = {
    "question_exclamation": r"[!?]+",
    "ellipsis": r"\.{2,}|…+(?:\.{2,})?",
    "entity": r"&(?:quot|amp|apos|lt|gt|#[0-9]+|#x[0-9a-fA-F]+);",
    "email": r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_.-]+\.\p{L}{2,}",
    "number": r"[0-9]+",
    "word": r"[\p{L}\p{N}_]+",
    "dingbat": r"[\u2600-\u27BF]",
    "bare_dot_word": r"\p{L}+\.",
}


def extract(docs: DataFrame, name: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, match) of one standalone pass, one row a match."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(found(F.col(f"`{text}`"), PATTERNS[name])).alias("match"))


def members(candidates: DataFrame, entries: list[str], match: str = "match") -> DataFrame:
    """Candidates whose lower-cased match is an entry; the list is part of the plan, so a set lookup and no join."""
    return candidates.filter(F.lower(match).isin([e.lower() for e in entries]))
