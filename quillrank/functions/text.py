"""Tokens and character trigrams as column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDLIKE = r"(?:[\p{IsAlphabetic}\p{N}]\p{M}*)+"
#: A term: letters and numbers, with single dots or apostrophes between two of them.
TERM = rf"{_WORDLIKE}(?:[.']{_WORDLIKE})*"
#: Case borders, as a pair that a space then parts: lower|Upper, and the last two of UPPER|Upperlower.
_LOWER_UPPER = r"(\p{IsLowercase}\p{M}*)(\p{IsUppercase})"
_ACRONYM_END = r"(\p{IsUppercase}\p{M}*)(\p{IsUppercase}\p{M}*\p{IsLowercase})"


def tokenize(text: Column) -> Column:
    """Lower-case terms in order, repeats kept; ``_``, ``-`` and case borders split, digits never do. Null gives null."""
    parted = F.regexp_replace(F.regexp_replace(text, _LOWER_UPPER, "$1 $2"), _ACRONYM_END, "$1 $2")
    return F.transform(F.regexp_extract_all(parted, F.lit(TERM), F.lit(0)), F.lower)


#: A character that may be part of a cluster of several code points; Latin texts of whole letters have none.
_CLUSTERS = r"[^\x00-\u02FF]|\r\n"


def char_trigrams(text: Column) -> Column:
    """All windows of three characters (grapheme clusters) of the lower-case text, in order; fewer than three give none."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1))
    return F.when(text.rlike(_CLUSTERS), grapheme_trigrams(text)).otherwise(plain)


def grapheme_trigrams(text: Column) -> Column:
    """Windows of three grapheme clusters, for text with combining sequences that no single code point stands for."""

    def windows(parts: Column) -> Column:
        starts = F.when(F.size(parts) >= 3, F.sequence(F.lit(1), F.size(parts) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, 3), ""))

    # bound to a name by a one-element array, so that the text is cut once and not for each window
    return F.element_at(F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(r"\X"), F.lit(0))), windows), 1)


def canonical_text(text: Column) -> Column:
    """The terms joined by single spaces."""
    return F.array_join(tokenize(text), " ")


def canonical_trigrams(text: Column) -> Column:
    """The set of trigrams of the canonical text."""
    return F.array_distinct(char_trigrams(canonical_text(text)))


def evaluate(spark, text: str, *functions) -> list:
    """Values of column functions of one literal text, without reading any table."""
    return list(spark.range(1).select(*[f(F.lit(text)).alias(f"_{i}") for i, f in enumerate(functions)]).first())
