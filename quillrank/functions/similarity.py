"""Similarities and keyword weights as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_trigrams

K1 = 1.2
B = 0.75
PRIMARY_WEIGHT = 5.0
BODY_WEIGHT = 1.0


def dice_sets(a: Column, b: Column) -> Column:
    """Sorensen-Dice of two sets held as distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.lit(2.0) * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    """Dice of the canonical trigram sets of two texts."""
    return dice_sets(canonical_trigrams(a), canonical_trigrams(b))


def trigram_score(query_set: Column, primary_set: Column, body_set: Column) -> Column:
    """Field-weighted Dice, from 0 to the sum of the field weights."""
    return F.lit(PRIMARY_WEIGHT) * dice_sets(query_set, primary_set) + F.lit(BODY_WEIGHT) * dice_sets(query_set, body_set)


def trigram_counts(n_query: int, primary: str, body: str) -> Column:
    """``trigram_score`` from the sizes of a row's sets and of what they share with a set of ``n_query``."""

    def one(f: str) -> Column:
        both, size = F.col(f"{f}_both"), F.col(f"{f}_size")
        return F.when((size > 0) & (F.lit(n_query) > 0), F.lit(2.0) * both / (F.lit(n_query) + size)).otherwise(F.lit(0.0))

    return F.lit(PRIMARY_WEIGHT) * one(primary) + F.lit(BODY_WEIGHT) * one(body)


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 1/2) / (df + 1/2)), never negative."""
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def length_norm(length: Column, average: Column) -> Column:
    return F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * length / average)


def term_weight(idf_: Column, tf: Column, length: Column, average: Column) -> Column:
    """One term's part of a BM25 score; 0 where the average length is 0."""
    return F.when(average > 0, idf_ * tf * F.lit(K1 + 1.0) / (tf + length_norm(length, average))).otherwise(F.lit(0.0))


def fold_sum(parts: list[Column]) -> Column:
    """Left-to-right sum, so that the last bits don't depend on a plan."""
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _products(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product of single-precision vectors in double precision, as SQL has it: single steps move scores over a rounding border."""
    return _products(a, b)


def square_norm(a: Column) -> Column:
    return _products(a, a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, within [-1, 1]; 0 for null, empty, unequal or zero vectors."""
    size = F.sqrt(square_norm(a) * square_norm(b))
    fine = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(F.coalesce(fine, F.lit(False)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(0.0))


def matvec(row: Column, query: Column, dimension: int) -> Column:
    """Dot product of a row of a matrix with a query vector; 0 unless both have ``dimension`` entries."""
    fine = (F.size(row) == dimension) & (F.size(query) == dimension)
    return F.when(F.coalesce(fine, F.lit(False)), dot(row, query)).otherwise(F.lit(0.0))
