"""Hybrid ranking of one query or a table of queries over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import B, K1, cosine, fold_sum, idf, term_weight, trigram_counts, trigram_score
from ..functions.text import canonical_trigrams, evaluate, tokenize
from .corpus import query_stats, trigram_index
from .ranking import SIGNALS, SignalWeights, fuse_ranks, global_rank, rank_positive

#: Beyond so many rows a single query's ranks come from a distributed sort instead of a window.
WINDOW_ROWS = 200_000


def bm25_column(terms: list[str], n: int, average: float, df: dict[str, int]) -> Column:
    """Score of a row by its ``wtf`` and ``doc_len``; terms in sorted order, each once."""
    if not terms or average <= 0:
        return F.lit(0.0)
    parts = []
    for t in sorted(set(terms)):
        tf = F.try_element_at("wtf", F.lit(t))
        parts.append(F.coalesce(term_weight(idf(F.lit(float(n)), F.lit(float(df.get(t, 0)))), tf, F.col("doc_len"), F.lit(average)), F.lit(0.0)))
    return fold_sum(parts)


def _round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def signals(corpus: DataFrame, query: str, cosine_of: Column | list[float] | None = None, digits: int | None = None) -> DataFrame:
    """pos, id, bm25, trigram, cosine of every row. Statistics are those of the live rows at this moment.

    ``cosine_of`` is a query vector, or a column of ready scores; without it the cosine is 0. ``digits`` rounds scores,
    which makes ties independent of how sums are ordered elsewhere.
    """
    return _signals(corpus, query, cosine_of, digits)[0]


def _signals(corpus: DataFrame, query: str, cosine_of, digits: int | None) -> tuple[DataFrame, int]:
    tokens, grams = evaluate(corpus.sparkSession, query, tokenize, canonical_trigrams)
    terms = sorted(set(tokens))
    n, average, df = query_stats(corpus, terms)
    if "primary_both" in corpus.columns:  # of ``query_corpus``
        tri = trigram_counts(len(grams), "primary", "body")
    else:
        tri = trigram_score(F.lit(grams) if grams else F.array().cast("array<string>"), F.col("primary_tri"), F.col("body_tri"))
    cos = F.lit(0.0) if cosine_of is None else cosine_of if isinstance(cosine_of, Column) else cosine(F.lit([float(x) for x in cosine_of]).cast("array<float>"), F.col("embedding"))
    cols = {"bm25": bm25_column(terms, n, average, df), "trigram": tri, "cosine": F.coalesce(cos.cast("double"), F.lit(0.0))}
    return corpus.select("pos", "id", *[_round(c, digits).alias(s) for s, c in cols.items()]), n


def scored(corpus: DataFrame, query: str, cosine_of=None, weights: SignalWeights = SignalWeights(), digits: int | None = None) -> DataFrame:
    """Every row with its raw signals, ranks and normalised ``score`` (null where no included signal is positive)."""
    rows, n = _signals(corpus, query, cosine_of, digits)
    rows = rows.persist()
    top = rows.agg(*[F.max(s).alias(s) for s in SIGNALS]).first()
    present = {s: bool(top[s] is not None and top[s] > 0) for s in SIGNALS}
    used = [s for s in SIGNALS if present[s] and weights.of(s) > 0]
    for s in SIGNALS:
        if s not in used:
            rows = rows.withColumn(f"rank_{s}", F.lit(None).cast("int"))
        elif n <= WINDOW_ROWS:
            rows = rows.withColumn(f"rank_{s}", rank_positive(F.col(s)))
        else:
            rows = global_rank(rows, s, f"rank_{s}")
    fused, ceiling = fuse_ranks({s: F.col(f"rank_{s}") for s in SIGNALS}, weights, present)
    return rows.withColumn("score", F.when(ceiling > 0, fused / ceiling).otherwise(F.when(fused.isNotNull(), F.lit(0.0))))


def _empty(corpus: DataFrame) -> DataFrame:
    return corpus.limit(0).select("pos", "id", F.lit(0.0).alias("score"), *[F.lit(0.0).alias(s) for s in SIGNALS])


def top_matches(corpus: DataFrame, query: str, limit: int = 20, cosine_of=None, weights: SignalWeights = SignalWeights(), digits: int | None = None) -> DataFrame:
    """pos, id, score, bm25, trigram, cosine of the best ranked rows, at most ``limit``; rows no signal ranks are left out."""
    if limit <= 0:
        return _empty(corpus)
    rows = scored(corpus, query, cosine_of, weights, digits).where("score is not null")
    return rows.select("pos", "id", _round(F.col("score"), digits).alias("score"), *SIGNALS).orderBy(F.col("score").desc(), "pos").limit(limit)


def full_ordering(corpus: DataFrame, query: str, cosine_of=None, weights: SignalWeights = SignalWeights(), digits: int | None = None) -> DataFrame:
    """All rows: ranked ones by score, then the others by position with score 0 and their raw signals; ``place`` from 0."""
    rows = scored(corpus, query, cosine_of, weights, digits).withColumn("_r", _round(F.col("score"), digits))
    rows = rows.select("pos", "id", F.coalesce("_r", F.lit(0.0)).alias("score"), *SIGNALS, F.col("_r").isNull().alias("_tail"))
    return rows.orderBy("_tail", F.col("score").desc(), "pos").drop("_tail")


def multi_query(corpus: DataFrame, postings: DataFrame, queries: DataFrame, limit: int = 20, weights: SignalWeights = SignalWeights(), digits: int | None = 9, trigrams: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` rows for each row of ``queries`` (query_id, query), by keyword and trigram signals.

    Queries meet rows only through shared terms and shared trigrams, by equi-joins with the two inverted indexes; work
    follows the postings of the queries' terms, not queries times rows. Ranks are windows over the rows of one query.
    """
    stats = corpus.agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl")).first()
    n, average = stats.n, stats.avgdl
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
    wanted = postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df")).select("term", idf(F.lit(n), F.col("df")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("doc_len") / (average or 1.0)))
    keyword = wanted.join(df, "term").join(terms, "term").groupBy("query_id", "pos").agg(F.sum(part).alias("bm25"))
    grams = queries.select("query_id", canonical_trigrams(F.col("query")).alias("g")).where(F.size("g") > 0)
    each = grams.select("query_id", F.size("g").alias("n_query"), F.explode("g").alias("tri"))
    index = trigrams if trigrams is not None else trigram_index(corpus)
    shared = index.join(each, "tri").groupBy("query_id", "pos", "field", "size", "n_query").agg(F.count(F.lit(1)).alias("both"))
    dice = F.lit(2.0) * F.col("both") / (F.col("size") + F.col("n_query"))
    fuzzy = shared.groupBy("query_id", "pos").agg((F.lit(5.0) * F.coalesce(F.max(F.when(F.col("field") == "primary", dice)), F.lit(0.0)) + F.coalesce(F.max(F.when(F.col("field") == "body", dice)), F.lit(0.0))).alias("trigram"))
    rows = keyword.join(fuzzy, ["query_id", "pos"], "full_outer").select("query_id", "pos", *[_round(F.coalesce(s, F.lit(0.0)), digits).alias(s) for s in ("bm25", "trigram")])
    whole = Window.partitionBy("query_id")
    rows = rows.withColumns({f"rank_{s}": rank_positive(F.col(s), "query_id") for s in ("bm25", "trigram")} | {f"has_{s}": F.max(s).over(whole) > 0 for s in ("bm25", "trigram")})
    fused, ceiling = fuse_ranks({s: F.col(f"rank_{s}") for s in ("bm25", "trigram")}, weights, {s: F.col(f"has_{s}") for s in ("bm25", "trigram")})
    rows = rows.withColumn("score", _round(fused / ceiling, digits)).where("score is not null")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pos")
    top = rows.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < limit)
    return top.join(corpus.select("pos", "id"), "pos").select("query_id", "rank", "pos", "id", "score", "bm25", "trigram")
