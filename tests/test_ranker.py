import pytest
from pyspark.sql import functions as F

from quillrank.operators.corpus import add_items, build_corpus, postings, remove_group, remove_ids, set_embeddings
from quillrank.operators.ranker import full_ordering, multi_query, top_matches
from quillrank.operators.ranking import SignalWeights, global_rank, rank_positive, rrf_fuse, rrf_normalize
from quillrank.sources.items import create_items, empty_items

OPS = [
    {"id": "publish", "text": "sends build artifacts to the package registry"},
    {"id": "undo", "text": "restores the previous version"},
    {"id": "health", "text": "prints current version and uptime"},
    {"id": "bounce", "text": "cycles one worker process"},
    {"id": "resize", "text": "changes worker process count"},
]
LOG = [
    {"id": "r1", "text": "lexer could not read the settings file", "group": "job-1"},
    {"id": "r2", "text": "retry of upload after connection reset", "group": "job-1"},
    {"id": "r3", "text": "saved the settings file to storage", "group": "job-1"},
    {"id": "s1", "text": "lexer warned about mixed tabs", "group": "job-2"},
    {"id": "s2", "text": "linked the binary with no errors", "group": "job-2"},
]


@pytest.fixture(scope="module")
def ops(spark):
    return build_corpus(create_items(spark, OPS)).persist()


@pytest.fixture(scope="module")
def log(spark):
    return build_corpus(create_items(spark, LOG)).persist()


def hits(df):
    return [(r.id, round(r.score, 6), round(r.bm25, 6), round(r.trigram, 6)) for r in df.collect()]


def test_goldens(ops):
    assert hits(top_matches(ops, "publish")) == [("publish", 1.0, 2.331196, 5.0)]
    assert hits(top_matches(ops, "version")) == [("undo", 1.0, 0.927822, 0.322581), ("health", 0.983607, 0.863291, 0.277778)]
    assert hits(top_matches(ops, "worker process")) == [("bounce", 1.0, 1.855645, 0.685714), ("resize", 0.983607, 1.855645, 0.631579), ("undo", 0.483871, 0.0, 0.052632)]
    assert hits(top_matches(ops, "registrry")) == [("publish", 1.0, 0.0, 0.2)]


def test_weights_and_absent_signals(ops):
    only = SignalWeights(trigram=0)
    assert hits(top_matches(ops, "publish", weights=only)) == [("publish", 1.0, 2.331196, 5.0)]
    assert hits(top_matches(ops, "registrry", weights=only)) == []


def test_empty_query_and_limits(ops):
    for q in ("", "qxzjvk"):
        assert hits(top_matches(ops, q)) == []
        assert [(r.id, r.score) for r in full_ordering(ops, q).collect()] == [(o["id"], 0.0) for o in OPS]
    assert hits(top_matches(ops, "version", limit=0)) == []
    assert hits(top_matches(ops, "version", limit=-1)) == []


def test_cosine(spark, ops):
    given = dict(zip((o["id"] for o in OPS), (0.5, -0.2, 0.0, 0.9, 0.5), strict=True))
    column = F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col("id"))
    assert [(r.id, round(r.score, 6)) for r in top_matches(ops, "qxzjvk", cosine_of=column).collect()] == [("bounce", 1.0), ("publish", 0.983607), ("resize", 0.967742)]
    tail = full_ordering(ops, "qxzjvk", cosine_of=column).collect()[3:]
    assert [(r.id, r.score, r.cosine) for r in tail] == [("undo", 0.0, -0.2), ("health", 0.0, 0.0)]
    got = [(r.id, round(r.score, 6)) for r in top_matches(ops, "version", cosine_of=column).collect()]
    assert got == [("undo", 0.666667), ("health", 0.655738), ("bounce", 0.333333), ("publish", 0.327869), ("resize", 0.322581)]


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_tie_break(spark, order):
    rows = [{"id": "pair-a", "text": "gearbox " * 20 + "spare"}, {"id": "gearbox", "text": "other spare words only"}]
    got = hits(top_matches(build_corpus(create_items(spark, [rows[i] for i in order])), "gearbox"))
    assert [h[0] for h in got] == [rows[i]["id"] for i in order]
    assert {h[1] for h in got} == {0.991803}


def test_primary_field(spark):
    rows = [
        {"id": "1", "primary_text": "Net.fetchWithBackoff", "text": "func fetchWithBackoff() computes the fetch backoff"},
        {"id": "2", "primary_text": "Util.run", "text": "notes fetchWithBackoff once"},
    ]
    assert hits(top_matches(build_corpus(create_items(spark, rows)), "fetchWithBackoff")) == [("1", 1.0, 0.885643, 5.059829), ("2", 0.983607, 0.621777, 0.744186)]


def test_log_and_changes(spark, log):
    q = "lexer settings file"
    assert hits(top_matches(log, q)) == [("r1", 1.0, 2.48139, 0.603774), ("r3", 0.983607, 1.750937, 0.489796), ("s1", 0.967742, 0.929808, 0.186047), ("r2", 0.47619, 0.0, 0.075472)]
    assert hits(top_matches(remove_group(log, "job-1"), q)) == [("s1", 1.0, 0.715668, 0.186047)]
    want = [("r1", 1.0, 1.332158, 0.603774), ("r3", 0.983607, 0.940007, 0.489796), ("s1", 0.967742, 0.499176, 0.186047)]
    gone = spark.createDataFrame([("r2",), ("s2",), ("nobody",)], "id string")
    assert hits(top_matches(remove_ids(log, gone), q)) == want
    step, added = add_items(build_corpus(create_items(spark, LOG[:2])), create_items(spark, LOG, start=10))
    assert sorted(r.id for r in added.collect()) == ["r3", "s1", "s2"]
    assert hits(top_matches(remove_ids(step, gone), q)) == want


def test_guarded_embedding(spark, log):
    found = spark.createDataFrame([("r1", [1.0, 0.0], LOG[0]["text"]), ("r2", [1.0], "an older text")], "id string, embedding array<float>, expected_text string")
    got = {r.id: r.embedding for r in set_embeddings(log, found).collect()}
    assert got["r1"] == [1.0, 0.0] and got["r2"] is None and len(got) == 5


def test_empty_corpus(spark):
    corpus = build_corpus(empty_items(spark))
    assert top_matches(corpus, "x").collect() == [] and full_ordering(corpus, "x").collect() == []


def test_duplicate_ids(spark):
    got = build_corpus(create_items(spark, [{"id": "a", "text": "first"}, {"id": "a", "text": "second"}])).collect()
    assert [r.text for r in got] == ["first"]


def test_batch_equals_single(spark, log):
    queries = spark.createDataFrame([(1, "lexer settings file"), (2, "upload"), (3, ""), (4, "lexr")], "query_id long, query string")
    items = create_items(spark, LOG)
    got = multi_query(log, postings(items), queries, limit=20, digits=None).collect()
    for qid, q in ((1, "lexer settings file"), (2, "upload"), (3, ""), (4, "lexr")):
        mine = [(r.id, round(r.score, 6), round(r.bm25, 6), round(r.trigram, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == qid]
        assert mine == hits(top_matches(log, q))


def test_rrf(spark):
    lists = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 1, 1.0), (1, 0, 1, 1.0), (1, 1, 0, 1.0)], "list int, rank int, doc int, weight double")
    assert {r.doc: r.score for r in rrf_fuse(lists).collect()} == pytest.approx({0: 1 / 60 + 1 / 61, 1: 1 / 60 + 1 / 61})
    zero = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 1, 0.0)], "list int, rank int, doc int, weight double")
    assert {r.doc: r.score for r in rrf_fuse(zero).collect()} == pytest.approx({0: 1 / 60, 1: 0.0})
    assert {r.score for r in rrf_normalize(rrf_fuse(zero), [0.0, 0.0]).collect()} == {0.0}


def test_global_rank_equals_window(spark):
    rows = spark.range(500).select(F.col("id").alias("pos"), ((F.col("id") * 37) % 23 - 3).cast("double").alias("s"))
    a = {r.pos: r.k for r in global_rank(rows, "s", "k").collect()}
    b = {r.pos: r.k for r in rows.withColumn("k", rank_positive(F.col("s"))).collect()}
    assert a == b


SCRIPTS = ["", "fetchRow parseXMLNode can't a.'b .x.", "Größe_maxWert naïve ÀÉîõ İstanbul ŒUVREs", "Cafés élan", "한국어 текст Ελλάς ΣΑΣ", "a’b “quoted” — 5€ ½ cup xª", "tail\U0001f468‍\U0001f469x", "same same\r\nsame", "ﬁne ĲSSEL ŉa ſharp ŐűŐ"]


def scripts(spark):
    return create_items(spark, [{"id": str(k), "primary_text": SCRIPTS[-k - 1] or "none", "text": t} for k, t in enumerate(SCRIPTS)])


def test_precompute_equals_expressions(spark):
    """The corpus comes from arrays of characters, but for other scripts; tokens and sets are those of the expressions."""
    from quillrank.functions.text import canonical_trigrams, tokenize

    want = scripts(spark).select("id", *[f(F.col(c)).alias(n) for c, k in (("primary_text", "p"), ("text", "b")) for f, n in ((tokenize, f"{k}t"), (canonical_trigrams, f"{k}g"))])
    made = build_corpus(scripts(spark))
    assert "HashAggregate" not in made._jdf.queryExecution().toString() and "MapInArrow" in made._jdf.queryExecution().toString()
    got = {r.id: r for r in made.collect()}
    for r in want.collect():
        assert got[r.id].doc_len == len(r.pt) + len(r.bt) and got[r.id].primary_tri == r.pg and got[r.id].body_tri == r.bg
        assert got[r.id].wtf == {t: 5.0 * r.pt.count(t) + r.bt.count(t) for t in {*r.pt, *r.bt}}
        assert got[r.id].summary == got[r.id].text == SCRIPTS[int(r.id)]


@pytest.mark.parametrize("query", ["same café x", "текст größe", "quoted cup", ""])
def test_query_corpus_scores_as_the_whole(spark, query):
    """One query keeps a few numbers a row in place of all terms and trigrams of the text."""
    from quillrank.operators.corpus import query_corpus

    slim = query_corpus(scripts(spark), query)
    assert not {"text", "summary", "primary_tri", "body_tri"} & set(slim.columns)
    assert full_ordering(slim, query, digits=9).collect() == full_ordering(build_corpus(scripts(spark)), query, digits=9).collect()


def test_document_frequencies_move_terms_only(spark):
    from quillrank.operators.corpus import document_frequencies

    found = document_frequencies(scripts(spark))
    want = postings(scripts(spark)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 1


@pytest.mark.parametrize("name", ["bm25_score", "hybrid_score", "top_matches"])
def test_single_queries_keep_no_trigrams(spark, name):
    from quillrank import registry

    from .conftest import SF

    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    spark.catalog.clearCache()
    assert "body_tri" not in plan and "body_both" in plan


def test_postings_are_counted_row_by_row(spark):
    found = postings(scripts(spark))
    assert not {"Exchange", "Aggregate"} & set(found._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    whole = {r.id: r.wtf for r in build_corpus(scripts(spark)).collect()}
    assert {(r.id, r.term): r.tf for r in found.collect()} == {(k, t): n for k, m in whole.items() for t, n in m.items()}


def test_batch_search_equals_multi_query(spark, monkeypatch):
    """The batch keeps no row for a pair of a query and a text, and gives what the joins give; ties and copies too."""
    from quillrank.operators import batch_ranker

    words = ["lexer", "settings", "file", "upload", "größe", "retry", "текст", "mixed", "tabs", "storage"]
    texts = [" ".join(words[(k * j + j) % 10] for j in range(1, 2 + k % 17)) for k in range(400)]
    items = create_items(spark, [{"id": f"d{k}", "primary_text": f"job-{k % 3}", "text": t} for k, t in enumerate(texts)])
    queries = spark.createDataFrame([(1, "lexer settings file"), (2, "upload текст"), (3, ""), (4, "lexr job"), (5, "größe"), (6, None)], "query_id long, query string")
    monkeypatch.setattr(batch_ranker, "BLOCK", 4)
    for limit, weights in ((3, SignalWeights()), (20, SignalWeights(bm25=2.0, trigram=0.5)), (5, SignalWeights(trigram=0.0))):
        want = multi_query(build_corpus(items), postings(items), queries, limit, weights).collect()
        got = batch_ranker.batch_search(items, queries, limit, weights)
        key = lambda r: (r.query_id, r["rank"], r.pos, r.id, round(r.score, 8), round(r.bm25, 8), round(r.trigram, 8))
        assert sorted(map(key, got.collect())) == sorted(map(key, want)) and len(want) >= 4 * limit
    assert batch_ranker.list_depth(10, [1.0, 1.0], 9) == 80 and batch_ranker.list_depth(10, [1.0, 1.0], 0) is None
