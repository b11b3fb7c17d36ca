"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from statistics import median

QUERIES = ("top_matches", "bm25_score", "multi_query_search", "hybrid_score", "tokenize_documents", "corpus_build", "cosine_topk", "rrf_fuse", "changelog_replay")


def stored_search(spark, sf_dir: str) -> float:
    """Seconds of one hybrid search over documents whose corpus is stored already."""
    from pyspark.sql import functions as F

    from quillrank.queries.common import DOC_QUERY
    from quillrank.session import shared_dir
    from quillrank.sources.items import document_items
    from quillrank.streaming.changelog import StreamingCorpus

    corpus = StreamingCorpus(spark, f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}")
    corpus.apply(document_items(spark, sf_dir).select(F.col("pos").alias("seq"), F.lit("add").alias("op"), "id", "primary_text", "text", "summary", "group"), 0)
    runs = []
    for _ in range(4):  # the first warms up
        start = time.perf_counter()
        corpus.search(DOC_QUERY, 20).collect()
        runs.append(time.perf_counter() - start)
    return round(median(runs[1:]), 3)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from quillrank import registry
    from quillrank.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    known, took = registry.queries(), {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(QUERIES)).split(","):
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "2"))):  # the first warms up
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        took[name] = round(median(runs[1:] or runs), 3)
    stored = stored_search(spark, sf_dir) if "BENCH_QUERIES" not in os.environ else None
    print(json.dumps({"metric": "sum of the medians of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "stored_search": stored, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
