"""A small catalog and a runner that shows what searches over it give."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.items import create_items
from .searcher import Searcher, report

#: Ten things that can be done to five kinds of things: fifty rows.
ACTIONS = {
    "archive": "moves old {} to cold storage", "audit": "lists who changed {} and when", "clone": "copies {} under a new name", "export": "writes {} to a file that other programs read",
    "import": "reads {} from a file of another program", "lock": "keeps {} from being changed", "merge": "joins two {} into one", "restore": "brings back deleted {}", "share": "lets another person see {}",
    "trim": "shortens {} that have grown too long",
}
KINDS = ("calendars", "invoices", "photoAlbums", "reports", "work_logs")
QUERIES = ("bring back a deleted invoice", "photoAlbum", "shorten reports", "who changed the calendar")


def demo_items(spark: SparkSession) -> DataFrame:
    rows = [{"id": f"{action}.{kind}", "primary_text": f"{action}.{kind}", "text": text.format(kind), "group": kind} for action, text in ACTIONS.items() for kind in KINDS]
    return create_items(spark, rows)


def run_demo(searcher: Searcher, queries: Iterable[str] = QUERIES, limit: int = 5) -> str:
    """A heading and the report of the best rows for each query; works in retrieval and in selection mode."""
    parts = []
    for q in queries:
        rows = searcher.search(q, limit)
        if "rank" not in rows.columns:  # retrieval: at most ``limit`` rows, numbered by their order
            found = rows.select("id", "score", "signals.*").collect()
            rows = searcher.corpus.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(found)], "rank int, id string, score double, bm25 double, trigram double, cosine double")
        parts.append(f"> {q}\n{report(rows.withColumn('score', F.coalesce('score', F.lit(0.0))))}")
    return "\n\n".join(parts)


def main() -> None:
    from ..session import session

    print(run_demo(Searcher(demo_items(session("local[2]")), digits=9)))


if __name__ == "__main__":
    main()
