"""The optional step that lets a model pick final ids from a catalog or its best candidates.

Only a catalog that fits the prefix budget, or at most ``candidate_limit`` candidates, ever reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .diagnostics import RetrievalCut, Sink, UnknownSelectedId, ignore

DEFAULT_CAPACITY = 32_000
DEFAULT_CANDIDATES = 24
DEFAULT_PREAMBLE = (
    "You choose among the items listed below. Answer with the ids of the smallest set of items that serves the request, "
    "ordered as they would be used. Use only ids from the list, and an empty list of ids if no item is of use."
)


class SelectionUnavailable(RuntimeError):
    """Selection was asked for, but no model session is configured."""


class SelectionShapeError(ValueError):
    """A model's answer is not an object with a list of string ids."""


class ModelSession(Protocol):
    """A conversation with a model: answers a prompt with text, and can be forked for the next prompt."""

    def respond(self, prompt: str) -> str: ...

    def fork(self) -> ModelSession: ...


class BaseSession:
    """A session whose fork is itself."""

    def respond(self, prompt: str) -> str:
        raise NotImplementedError

    def fork(self) -> BaseSession:
        return self


def decode(raw: str) -> list[str]:
    """The ids of a model's JSON answer."""
    try:
        ids = json.loads(raw)["ids"]
    except (ValueError, KeyError, TypeError) as e:
        raise SelectionShapeError("an answer must be a JSON object with ids") from e
    if not isinstance(ids, list) or not all(isinstance(i, str) for i in ids):
        raise SelectionShapeError("ids must be a list of strings")
    return ids


def id_enum_grammar(ids: list[str]) -> str:
    """JSON schema of an answer: distinct ids out of ``ids``, no more than there are."""
    listed = {"type": "array", "items": {"type": "string", "enum": list(ids)}, "uniqueItems": True, "maxItems": len(ids)}
    return json.dumps({"type": "object", "properties": {"ids": listed}, "required": ["ids"]})


def prefix_text(preamble: str, summaries: list[str]) -> str:
    return preamble + "\n\n# Candidates\n" + "\n\n".join(summaries)


def prefix_length(corpus: DataFrame, preamble: str) -> DataFrame:
    """One row: the length of the prefix of the whole catalog, without building it."""
    fixed = len(prefix_text(preamble, []))
    return corpus.agg((F.coalesce(F.sum(F.length("summary")), F.lit(0)) + 2 * F.greatest(F.count(F.lit(1)) - 1, F.lit(0)) + fixed).cast("long").alias("length"))


class PrefixTooLong(ValueError):
    """A catalog's prefix is beyond the budget and is not built."""


def assemble_prefix(corpus: DataFrame, preamble: str, capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """One row: the prefix with all summaries by position. Its length is taken first; beyond ``capacity`` it isn't built."""
    length = prefix_length(corpus, preamble).first().length
    if length > capacity:
        raise PrefixTooLong(f"a prefix of {length} characters is beyond {capacity}")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "summary"))), lambda s: s["summary"]), "\n\n")
    return corpus.agg(F.concat(F.lit(prefix_text(preamble, [])), joined).alias("prefix"))


def match_ids(corpus: DataFrame, ranking: DataFrame, ids: list[str], limit: int, allowed: set[str] | None = None) -> DataFrame:
    """Accepted ids in the model's order with text, score and signals: known, allowed, each once, at most ``limit``.

    ``ranking`` has id, score and signals of all candidates. Repeats and unknown ids take no place.
    """
    chosen = corpus.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "at int, id string")
    first = chosen.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("at"))).where("_n = 1").drop("_n")
    if allowed is not None:
        first = first.where(F.col("id").isin(sorted(allowed))) if allowed else first.limit(0)
    rows = first.join(corpus.select("id", F.col("text").alias("block")), "id").join(ranking.select("id", "score", "bm25", "trigram", "cosine"), "id", "left")
    kept = rows.withColumn("rank", F.row_number().over(Window.orderBy("at")) - 1).where(F.col("rank") < limit)  # at most len(ids) rows
    return kept.select("rank", "id", "block", "score", "bm25", "trigram", "cosine")


@dataclass(frozen=True)
class SelectionConfig:
    """A session factory (preamble and grammar to a session), the preamble, and the two budgets (negative: 0)."""

    model: Callable[[str, str], ModelSession]
    preamble: str = DEFAULT_PREAMBLE
    capacity: int = DEFAULT_CAPACITY
    candidate_limit: int = DEFAULT_CANDIDATES

    def __post_init__(self) -> None:
        object.__setattr__(self, "capacity", max(0, self.capacity))
        object.__setattr__(self, "candidate_limit", max(0, self.candidate_limit))


@dataclass
class SelectionTier:
    """Selection over a corpus; ``ranking`` gives the full ordering of a query (pos, id, score, signals)."""

    corpus: DataFrame
    config: SelectionConfig
    ranking: Callable[[str], DataFrame]
    sink: Sink = ignore
    _root: ModelSession | None = field(default=None, init=False)
    _fits: tuple[bool, int] | None = field(default=None, init=False)

    def _within(self) -> tuple[bool, int]:
        if self._fits is None:
            length = prefix_length(self.corpus, self.config.preamble).first().length
            self._fits = (length <= self.config.capacity, self.corpus.count())
        return self._fits

    def _root_session(self) -> ModelSession:
        if self._root is None:
            rows = self.corpus.select("pos", "id", "summary").orderBy("pos").collect()  # within the budget
            self._root = self.config.model(prefix_text(self.config.preamble, [r.summary for r in rows]), id_enum_grammar([r.id for r in rows]))
        return self._root

    def search(self, intent: str, limit: int = 20) -> DataFrame:
        """Rows that the model picked, in its order; empty for a limit of 0 or less."""
        if limit <= 0:
            return self._none()
        fits, considered = self._within()
        if fits:
            answer = self._root_session().fork().respond(intent)
            return self._accept(decode(answer), limit, None, self.ranking(intent))
        ranked = self.ranking(intent)
        best = ranked.limit(self.config.candidate_limit).select("id").collect() if self.config.candidate_limit else []
        kept = [r.id for r in best]
        self.sink(RetrievalCut(considered, len(kept)))
        if not kept:
            return self._none()
        summaries = {r.id: r.summary for r in self.corpus.where(F.col("id").isin(kept)).select("id", "summary").collect()}
        session = self.config.model(prefix_text(self.config.preamble, [summaries[i] for i in kept if i in summaries]), id_enum_grammar(kept))
        return self._accept(decode(session.respond(intent)), limit, set(kept), ranked)

    def _none(self) -> DataFrame:
        return match_ids(self.corpus, self.corpus.select("id", *[F.lit(0.0).alias(c) for c in ("score", "bm25", "trigram", "cosine")]), [], 0)

    def _accept(self, ids: list[str], limit: int, allowed: set[str] | None, ranked: DataFrame) -> DataFrame:
        known = {r.id for r in self.corpus.where(F.col("id").isin(ids)).select("id").collect()} if ids else set()
        seen, taken = set(), 0
        for i in ids:  # unknown ids are told until the limit is reached
            if taken >= limit:
                break
            if i in seen:
                continue
            seen.add(i)
            if i not in known or (allowed is not None and i not in allowed):
                self.sink(UnknownSelectedId(i))
            else:
                taken += 1
        return match_ids(self.corpus, ranked, ids, limit, allowed)
