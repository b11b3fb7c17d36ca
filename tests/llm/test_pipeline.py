"""The pipeline's stages on rows with nulls, repeats, very long texts and more columns, and each against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillrank.llm import common, mixing, quality, simhash
from quillrank.llm.components import components

from ..conftest import SF
from .test_operators import LONG, edge

FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def odd(spark):
    """Plain documents among rows without id, text or source, repeated rows and a very long text."""
    plain = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    return edge(spark, [*plain, *plain[:5], (None, None), (None, plain[9][1]), (None, "a@b.co is mine"), (700, ""), (701, None), (702, LONG), (703, "mail a@b.co now and then"), (703, "mail a@b.co now and then")])


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, odd, k):
    name, stage = P.STAGES[k]
    before = odd.collect()
    out = stage(spark, odd, SF)
    rows = out.collect()
    texts = {r.text or "" for r in before}
    if k < 4:
        assert out.columns == odd.columns
    if k == 0:
        assert {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in before}
        model = quality.train(odd, spark.read.parquet(f"{SF}/labels.parquet"))
        import numpy as np

        fine = lambda t: model.score(np.array([quality.features(t)]))[0] >= model.at
        assert len(rows) == sum(fine(r.text) for r in before)
    if k == 1:
        assert len({r.text or "" for r in rows}) == len(rows) and all((r.text or "") in texts for r in rows)
        assert sum(not (r.text or "").split() for r in rows) == 1
    if k == 2:
        assert len(rows) == len(before) and not any("a@b.co" in (r.text or "") for r in rows)
        assert sum(r.text is None for r in rows) == sum(r.text is None for r in before)
    if k == 3:
        taken = mixing.digest(odd).agg(F.sum(F.size("shards"))).first()[0]
        assert len(rows) == taken and {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in before}
    if k == 4:
        size = lambda t: len((t or "").split())
        assert sum(r.words for r in rows) == sum(size(r.text) for r in before) == sum(size(r.text) for r in rows)
    empty = odd.limit(0)
    assert stage(spark, empty, SF).count() == 0


def test_run_leaves_one_stage(spark, tmp_path, monkeypatch):
    """Of what the run writes, the input of the last stage stays until the result is read."""
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    assert P.run(spark, SF).count()
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["stage"]


def test_run_is_its_stages(spark):
    """The whole run: no piece of a document that an earlier stage drops, and no personal data of the simple kinds left."""
    rows = P.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} < set(docs)
    words, bins = {}, {}
    for r in rows:
        assert len(r.text.split()) == r.words <= 2048
        bins[r.bin] = bins.get(r.bin, 0) + r.words
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
    assert max(bins.values()) <= 2048
    again = P.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.bin, r.text) for r in rows) == sorted((r.doc_id, r.piece, r.bin, r.text) for r in again)


def test_near_dedup_against_brute_force(spark):
    """Components of the five-word Jaccard likeness of 0.8 over all pairs of a table's texts."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(3)
    more = []
    for d, text in rows[:40]:
        w = text.split()
        at = rng.randrange(len(w))
        more.append((10_000 + d, " ".join(w[:at] + ["new", "words"] + w[at:])))
    rows += more
    sets = []
    for _, t in rows:
        w = [x.lower() for x in t.split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    least = {k: d for k, (d, _) in enumerate(rows)}
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in rows:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    want = {d for k, (d, _) in enumerate(rows) if least[k] == d}
    got = P.STAGES[1][1](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert {r.doc_id for r in got} == want and len(want) < len(rows) - 20


def test_near_dedup_links_by_simhash(spark, monkeypatch):
    """Without the candidates of shingle minima, texts within 4 bits of a fingerprint are still found, and compared whole."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + d, text + " end") for d, text in rows if len(text.split()) > 200]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {t: simhash.majority(simhash.runs(t)) for _, t in rows}
    root = {t: t for t in fp}
    for x in fp:  # components over all pairs
        near = {root[y] for y in fp if (fp[x] ^ fp[y]).bit_count() <= 4}
        root = {t: min(near) if r in near else r for t, r in root.items()}
    marked = simhash.with_sketch(table).distinct()
    links = components(simhash.close(marked.selectExpr("th as node", "fp").distinct(), 4, len(fp)))
    assert links.count() == len(fp) - len(set(root.values())) > 50
    monkeypatch.setattr(simhash, "candidates", lambda nodes, likeness: spark.createDataFrame([], "a long, b long"))
    kept = {r.doc_id for r in P.STAGES[1][1](spark, table, SF).collect()}
    assert sum(d >= 10_000 for d, _ in rows) > 50 and all(d < 10_000 or (fp[t] ^ fp[t.removesuffix(" end")]).bit_count() > 4 for d, t in rows if d in kept)
