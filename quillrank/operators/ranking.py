"""Ranks, reciprocal rank fusion and normalisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Smoothing constant of reciprocal rank fusion; ranks are counted from 0.
K = 60
SIGNALS = ("bm25", "trigram", "cosine")


@dataclass(frozen=True)
class SignalWeights:
    """Weights of the three signals in the fusion; a weight of 0 or less leaves a signal out."""

    bm25: float = 1.0
    trigram: float = 1.0
    cosine: float = 1.0

    def of(self, signal: str) -> float:
        return float(getattr(self, signal))


def rank_positive(score: Column, *partition: str) -> Column:
    """0-based rank among positive scores, ties by position, null for the others."""
    order = Window.partitionBy(*partition, score > 0).orderBy(score.desc(), F.col("pos"))
    return F.when(score > 0, F.row_number().over(order) - 1)


def global_rank(rows: DataFrame, score: str, rank: str) -> DataFrame:
    """``rows`` with the 0-based rank of their positive scores, from a distributed sort, without a window over all rows.

    Partitions of the range sort are counted (a row for each comes to the driver) and numbered on; other rows get null.
    The sorted rows are persisted, as numbering and counting must see the same partitions.
    """
    ordered = rows.where(F.col(score) > 0).orderBy(F.col(score).desc(), F.col("pos")).withColumn("_m", F.monotonically_increasing_id()).persist()
    part = F.shiftright(F.col("_m"), 33)
    counts = sorted(ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offset, starts = 0, {}
    for p, n in counts:
        starts[p] = offset
        offset += n
    table = F.lit([starts.get(p, 0) for p in range(max(starts, default=-1) + 1)] or [0])
    index = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ordered.withColumn(rank, (F.element_at(table, part.cast("int") + 1) + index).cast("int")).drop("_m")
    rest = rows.where(F.coalesce(F.col(score), F.lit(0.0)) <= 0).withColumn(rank, F.lit(None).cast("int"))
    return ranked.unionByName(rest)


def rrf_term(rank: Column, weight: float | Column, k: int = K) -> Column:
    return F.coalesce((F.lit(weight) if not isinstance(weight, Column) else weight) / (F.lit(float(k)) + rank), F.lit(0.0))


def rrf_fuse(lists: DataFrame, k: int = K, by: tuple[str, ...] = ()) -> DataFrame:
    """Fuse ranked lists (columns list, rank, doc, weight): the sum of weight / (k + rank) for each document.

    A document counts once for each place it has, in zero-weight lists too.
    """
    return lists.groupBy(*by, "doc").agg(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def rrf_normalize(fused: DataFrame, weights: list[float], k: int = K) -> DataFrame:
    """Divide scores by what a document first in every list would have; all 0 where that is 0."""
    ceiling = sum(w / k for w in weights)
    return fused.withColumn("score", F.col("score") / ceiling if ceiling > 0 else F.lit(0.0))


def fuse_ranks(ranks: dict[str, Column], weights: SignalWeights, present: dict[str, Column | bool]) -> tuple[Column, Column]:
    """Fused score (null for rows in no included list) and ceiling, folded in the order of ``SIGNALS``.

    A signal is included when its weight is positive and some row of the query scores in it.
    """
    score, ceiling, ranked = F.lit(0.0), F.lit(0.0), F.lit(False)
    for s in SIGNALS:
        w = weights.of(s)
        if s not in ranks or w <= 0 or present[s] is False:
            continue
        on = F.lit(True) if present[s] is True else present[s]
        score = score + F.when(on, rrf_term(ranks[s], w)).otherwise(F.lit(0.0))
        ceiling = ceiling + F.when(on, F.lit(w / K)).otherwise(F.lit(0.0))
        ranked = ranked | (on & ranks[s].isNotNull())
    return F.when(ranked, score), ceiling
