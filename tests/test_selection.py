"""The selection step and the facade, with scripted sessions."""

import json

import pytest
from pyspark.sql import functions as F

from quillrank.operators.corpus import build_corpus
from quillrank.plans import selection as P
from quillrank.plans.diagnostics import EmbeddingUnavailable, RetrievalCut, UnknownSelectedId
from quillrank.plans.searcher import EmbedderAdapter, Mode, Searcher, report
from quillrank.sources.items import InvalidItems, check_items, create_items, empty_items

CATALOG = [{"id": i, "text": f"text of {i}", "summary": f"sum {i}"} for i in "abcde"]


class Session:
    """Answers with fixed ids and keeps what it was told; forks are counted."""

    def __init__(self, raw, prefix="", grammar=""):
        self.raw, self.prefix, self.grammar, self.asked, self.forks = raw, prefix, grammar, [], 0

    def respond(self, prompt):
        self.asked.append(prompt)
        return self.raw

    def fork(self):
        self.forks += 1
        return self


class Model:
    """A session factory that keeps its sessions."""

    def __init__(self, *ids, raw=None):
        self.raw, self.made = raw if raw is not None else json.dumps({"ids": list(ids)}), []

    def __call__(self, prefix, grammar=""):
        self.made.append(Session(self.raw, prefix, grammar))
        return self.made[-1]


@pytest.fixture(scope="module")
def corpus(spark):
    return build_corpus(create_items(spark, CATALOG)).persist()


def ordering(corpus):
    """Item a with a score of 0.9, then the others as in the catalog with 0."""

    def rank(_):
        score = F.when(F.col("id") == "a", 0.9).otherwise(0.0)
        return corpus.select("pos", "id", score.alias("score"), *[F.lit(0.0).alias(c) for c in ("bm25", "trigram", "cosine")]).orderBy("pos")

    return rank


def tier(corpus, model, told=None, **config):
    return P.SelectionTier(corpus, P.SelectionConfig(model, "Choose.", **config), ordering(corpus), told.append if told is not None else lambda _: None)


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_over_budget_keeps_to_the_candidates(corpus):
    told, model = [], Model("a", "c")
    got = tier(corpus, model, told, capacity=1, candidate_limit=2).search("x")
    assert ids(got) == ["a"] and told == [RetrievalCut(5, 2), UnknownSelectedId("c")]
    assert [r.score for r in got.collect()] == [0.9]
    assert model.made[0].prefix == "Choose.\n\n# Candidates\nsum a\n\nsum b"
    assert json.loads(model.made[0].grammar)["properties"]["ids"]["items"]["enum"] == ["a", "b"]
    assert model.made[0].forks == 0


def test_repeats_take_no_place(corpus):
    told = []
    assert ids(tier(corpus, Model("a", "a", "b"), told, capacity=1, candidate_limit=2).search("x", 2)) == ["a", "b"]
    assert told == [RetrievalCut(5, 2)]


def test_each_over_budget_search_has_its_own_session(corpus):
    model = Model("a")
    t = tier(corpus, model, capacity=1)
    t.search("x"), t.search("y")
    assert [s.asked for s in model.made] == [["x"], ["y"]]


def test_empty_catalog_over_budget_asks_no_model(spark):
    empty, told, model = build_corpus(empty_items(spark)), [], Model("a")
    assert ids(tier(empty, model, told, capacity=1).search("x")) == []
    assert told == [RetrievalCut(0, 0)] and model.made == []


def test_no_candidates_ask_no_model(corpus):
    told, model = [], Model("a")
    assert ids(tier(corpus, model, told, capacity=1, candidate_limit=0).search("x")) == []
    assert told == [RetrievalCut(5, 0)] and model.made == []


def test_capacity_is_exact(corpus):
    length = len(P.prefix_text("Choose.", [c["summary"] for c in CATALOG]))
    assert P.prefix_length(corpus, "Choose.").first().length == length
    for capacity, cut in ((length, []), (length - 1, [RetrievalCut(5, 5)])):
        told, model = [], Model("e")
        assert ids(tier(corpus, model, told, capacity=capacity).search("x")) == ["e"]
        assert told == cut and model.made[0].forks == (not cut)
    assert P.assemble_prefix(corpus, "Choose.", length).first().prefix == P.prefix_text("Choose.", [c["summary"] for c in CATALOG])
    with pytest.raises(P.PrefixTooLong):
        P.assemble_prefix(corpus, "Choose.", length - 1)


def test_root_session_is_made_once_and_forked(corpus):
    model = Model("b", "a", "b", "zz", "c")
    told = []
    t = tier(corpus, model, told)
    got = t.search("first", 2)
    assert ids(got) == ["b", "a"] and [r.block for r in got.orderBy("rank").collect()] == ["text of b", "text of a"]
    assert told == []  # the limit was reached before the unknown id
    assert ids(t.search("second")) == ["b", "a", "c"] and told == [UnknownSelectedId("zz")]
    assert len(model.made) == 1 and model.made[0].forks == 2 and model.made[0].asked == ["first", "second"]
    assert json.loads(model.made[0].grammar)["properties"]["ids"]["maxItems"] == 5
    assert ids(t.search("none", 0)) == [] and ids(t.search("none", -3)) == [] and model.made[0].forks == 2


def test_base_session_forks_to_itself():
    session = P.BaseSession()
    assert session.fork() is session
    with pytest.raises(NotImplementedError):
        session.respond("x")


def test_negative_budgets_are_zero_and_the_preamble_is_neutral():
    config = P.SelectionConfig(Model(), capacity=-5, candidate_limit=-1)
    assert (config.capacity, config.candidate_limit) == (0, 0)
    assert "items" in config.preamble and "ids" in config.preamble


@pytest.mark.parametrize("raw", ["no json", "[]", "{}", '{"ids": "a"}', '{"ids": [1]}', "3"])
def test_answers_of_another_shape_are_errors(corpus, raw):
    with pytest.raises(P.SelectionShapeError):
        P.decode(raw)
    with pytest.raises(P.SelectionShapeError):
        tier(corpus, Model(raw=raw)).search("x")


def test_modes(spark):
    rows, model = create_items(spark, CATALOG), Model("d")
    assert [r.id for r in Searcher(rows).search("text of b").collect()][0] == "b"
    assert ids(Searcher(rows, session=model).search("anything")) == ["d"]
    assert [r.id for r in Searcher(rows, session=model, mode=Mode.RETRIEVAL).search("text of b").collect()][0] == "b"
    with pytest.raises(P.SelectionUnavailable):
        Searcher(rows, mode=Mode.SELECTION).search("x")
    assert Searcher(empty_items(spark)).search("x").collect() == []


def test_errors_of_a_session_reach_the_caller(spark):
    class Down(P.BaseSession):
        def respond(self, prompt):
            raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="down"):
        Searcher(create_items(spark, CATALOG), session=lambda _: Down()).search("x")


def test_embedders(spark):
    rows, told = create_items(spark, CATALOG), []
    vector = lambda texts: [[float("b" in t.split()), 1.0] for t in texts]
    found = Searcher(rows, EmbedderAdapter(2, vector), sink=told.append)
    best = found.search("b").collect()[0]
    assert best.id == "b" and best.signals.cosine > 0.99 and told == []
    calls = []

    def once(texts):  # rows are embedded on the executors; the query fails on the driver
        calls.append(texts)
        raise RuntimeError("down")

    found.embedder = EmbedderAdapter(2, once)
    assert [r.signals.cosine for r in found.search("text of b").collect()] == [0.0] * 5
    assert told == [EmbeddingUnavailable()] and len(calls) == 1
    with pytest.raises(Exception, match="down"):
        Searcher(rows, EmbedderAdapter(2, once))
    with pytest.raises(Exception, match="vectors for"):
        Searcher(rows, EmbedderAdapter(2, lambda texts: [[1.0, 2.0]] * (len(texts) + 1)))


def test_items_are_checked(spark):
    assert check_items(create_items(spark, CATALOG)) == 5 and check_items(empty_items(spark)) == 0
    bad = ([{"id": "a", "text": "", "pos": 1}, {"id": "b", "text": "", "pos": 1}], [{"id": "a", "text": "", "embedding": [1.0]}, {"id": "b", "text": "", "embedding": [1.0, 2.0]}])
    for rows in bad:
        with pytest.raises(InvalidItems):
            Searcher(create_items(spark, rows))
    with pytest.raises(InvalidItems):
        check_items(create_items(spark, CATALOG).withColumn("id", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        create_items(spark, [{"id": "a", "text": "", "colour": "red"}])
    only = create_items(spark, [{"id": "a", "text": "body"}]).first()
    assert (only.primary_text, only.summary, only.group, only.embedding) == ("a", "body", None, None)


def test_report(spark):
    got = Searcher(create_items(spark, CATALOG), session=Model("b", "c")).search("x")
    assert report(got).splitlines()[0].startswith("1. b  score=")
    assert report(got.limit(0)) == "(no matches)"


def test_demo(spark):
    from quillrank.plans.demo import QUERIES, demo_items, run_demo

    rows = demo_items(spark)
    assert check_items(rows) == 50
    shown = run_demo(Searcher(rows, digits=9)).split("\n\n")
    assert [s.splitlines()[0] for s in shown] == [f"> {q}" for q in QUERIES]
    assert all(2 <= len(s.splitlines()) <= 6 for s in shown)
    assert shown[0].splitlines()[1].startswith("1. restore.invoices") and "photoAlbums" in shown[1].splitlines()[1]
    assert run_demo(Searcher(rows, session=Model("lock.reports", "nobody")), ["x"]).splitlines()[1].startswith("1. lock.reports")
