"""The facade: build once, search in retrieval or selection mode."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from enum import Enum
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import build_corpus
from ..operators.ranker import full_ordering, top_matches
from ..operators.ranking import SignalWeights
from ..sources.items import check_items
from .diagnostics import EmbeddingUnavailable, Sink, ignore
from .selection import DEFAULT_CANDIDATES, DEFAULT_PREAMBLE, ModelSession, SelectionConfig, SelectionTier, SelectionUnavailable


class TextEmbedding(Protocol):
    """Texts to vectors of ``dimension`` floats, in order; may raise. Must be picklable to embed a table."""

    dimension: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class EmbedderAdapter:
    """Any callable from texts to vectors as an embedder."""

    def __init__(self, dimension: int, call: Callable[[Sequence[str]], Sequence[Sequence[float]]]):
        self.dimension, self._call = dimension, call

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        return self._call(texts)


def embed_rows(rows: DataFrame, embedder: TextEmbedding, tolerant: bool = False) -> DataFrame:
    """id, embedding, expected_text for ``rows`` (id, text), a batch of rows at a time on the executors.

    A batch with a wrong number of vectors, or an error, raises; with ``tolerant`` its rows have null embeddings.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            try:
                vectors = [[float(x) for x in v] for v in embedder.embed(pdf["text"].tolist())]
                if len(vectors) != len(pdf):
                    raise ValueError(f"{len(vectors)} vectors for {len(pdf)} texts")
            except Exception:
                if not tolerant:
                    raise
                vectors = [None] * len(pdf)
            yield pd.DataFrame({"id": pdf["id"], "embedding": vectors, "expected_text": pdf["text"]})

    return rows.select("id", "text").mapInPandas(run, "id string, embedding array<float>, expected_text string")


class Mode(Enum):
    RETRIEVAL = "retrieval"
    SELECTION = "selection"
    AUTO = "auto"


def with_blocks(corpus: DataFrame, hits: DataFrame) -> DataFrame:
    """Ranked rows with the verbatim text, joined after the cut."""
    rows = hits.join(corpus.select("id", F.col("text").alias("block")), "id", "left")
    return rows.select("pos", "id", F.coalesce("block", F.lit("")).alias("block"), "score", F.struct("bm25", "trigram", "cosine").alias("signals")).orderBy(F.col("score").desc(), "pos")


class Searcher:
    """Search over a table of items (see ``sources.items``). No session is configured unless one is given.

    ``digits`` rounds scores before they are ranked, so that ties don't depend on how sums are ordered.
    """

    def __init__(
        self,
        items: DataFrame,
        embedder: TextEmbedding | None = None,
        session: Callable[[str], ModelSession] | None = None,
        weights: SignalWeights = SignalWeights(),
        preamble: str = DEFAULT_PREAMBLE,
        candidate_limit: int = DEFAULT_CANDIDATES,
        mode: Mode = Mode.AUTO,
        sink: Sink = ignore,
        digits: int | None = None,
    ):
        corpus = build_corpus(items)
        if embedder is not None:
            found = embed_rows(corpus, embedder).select("id", F.col("embedding").alias("_e"))
            corpus = corpus.join(found, "id", "left").withColumn("embedding", F.col("_e")).select(*corpus.columns)
        self.corpus = corpus.persist()
        self.count = check_items(self.corpus)  # embeds now: an error is raised here
        self.embedder, self.weights, self.mode, self.sink, self.digits = embedder, weights, mode, sink, digits
        self.tier = None
        if session is not None:
            config = SelectionConfig(lambda prefix, _grammar: session(prefix), preamble, candidate_limit=candidate_limit)
            self.tier = SelectionTier(self.corpus, config, self._ordering, sink)

    def _query_vector(self, query: str) -> list[float] | None:
        if self.weights.cosine <= 0:
            return None
        try:
            vector = list(self.embedder.embed([query])[0]) if self.embedder is not None else None
        except Exception:
            vector = None
        if not vector:
            self.sink(EmbeddingUnavailable())
            return None
        return vector

    def _ordering(self, query: str) -> DataFrame:
        if not self.count:
            return self.corpus.select("pos", "id", *[F.lit(0.0).alias(c) for c in ("score", "bm25", "trigram", "cosine")])
        return full_ordering(self.corpus, query, self._query_vector(query), self.weights, self.digits)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """The best rows: by retrieval, or as the configured model selects."""
        if self.mode is Mode.SELECTION or (self.mode is Mode.AUTO and self.tier is not None):
            if self.tier is None:
                raise SelectionUnavailable("selection needs a session")
            return self.tier.search(query, limit)
        if limit <= 0 or not self.count:
            return with_blocks(self.corpus, top_matches(self.corpus, query, 0))
        return with_blocks(self.corpus, top_matches(self.corpus, query, limit, self._query_vector(query), self.weights, self.digits))


def format_matches(rows: DataFrame) -> DataFrame:
    """One text line for each row with rank, id, score and signals."""
    return rows.select("rank", F.format_string("%d. %s  score=%.3f  [bm25=%.3f trigram=%.3f cosine=%.3f]", F.col("rank") + 1, "id", "score", "bm25", "trigram", "cosine").alias("line"))


def report(rows: DataFrame) -> str:
    """All lines of a (limited) result, or a note that there are none."""
    lines = [r.line for r in format_matches(rows).orderBy("rank").collect()]
    return "\n".join(lines) if lines else "(no matches)"
