import json
import random

import pytest
from pyspark.sql import functions as F

from quillrank.plans.diagnostics import EmbeddingUnavailable
from quillrank.plans.searcher import EmbedderAdapter
from quillrank.streaming.changelog import CHANGE_SCHEMA, CorruptCorpus, StreamingCorpus, change_stream, replay, replay_serial

FIELDS = CHANGE_SCHEMA.names


def log_df(spark, rows):
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in rows], CHANGE_SCHEMA)


def simulate(rows):
    live = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        if r["op"] == "add":
            live.setdefault(r["id"], r)
        elif r["op"] == "remove_id":
            live.pop(r["id"], None)
        else:
            live = {k: v for k, v in live.items() if v.get("group") != r["group"] or v.get("group") is None}
    return sorted((r["id"], r["seq"]) for r in live.values())


def random_log(seed, fixed):
    rng = random.Random(seed)
    rows = []
    for seq in range(120):
        i = rng.randrange(12)
        op = rng.choice(["add", "add", "add", "remove_id", "remove_group"])
        group = f"g{i % 3}" if fixed else rng.choice(["g0", "g1", None])
        if op == "remove_group":
            rows.append({"seq": seq, "op": op, "group": f"g{rng.randrange(3)}"})
        else:
            rows.append({"seq": seq, "op": op, "id": f"k{i}", "text": f"text {seq}", "group": group})
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_simulation(spark, seed):
    rows = random_log(seed, True)
    assert sorted((r.id, r.seq) for r in replay(log_df(spark, rows)).collect()) == simulate(rows)
    rows = random_log(seed, False)
    assert sorted((r.id, r.seq) for r in replay_serial(log_df(spark, rows)).collect()) == simulate(rows)


def test_versions_and_search(spark, tmp_path):
    seen = []
    corpus = StreamingCorpus(spark, str(tmp_path / "c"), sink=seen.append)
    assert corpus.is_empty() and corpus.search("x").collect() == [] and seen == []
    rows = [{"seq": k, "op": "add", "id": f"i{k}", "text": f"alpha number{k}", "group": f"g{k % 2}"} for k in range(6)]
    corpus.apply(log_df(spark, rows))
    before = corpus.version()
    corpus.apply(log_df(spark, [{"seq": 10, "op": "remove_group", "group": "g0"}, {"seq": 11, "op": "add", "id": "i1", "text": "other"}, {"seq": 12, "op": "remove_id", "id": "nobody"}]))
    assert corpus.count() == 3 and corpus.snapshot(before).count() == 6
    assert [r.id for r in corpus.search("number3").collect()][0] == "i3"
    assert sorted(r.id for r in corpus.search("alpha").collect()) == ["i1", "i3", "i5"]
    assert len(corpus.search("alpha", version=before).collect()) == 6
    assert seen == [EmbeddingUnavailable()] * 3


def test_stream_with_embedder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    embed = EmbedderAdapter(2, lambda texts: [[float(len(t)), 1.0] for t in texts])
    corpus = StreamingCorpus(spark, str(tmp_path / "c"), embed, seen.append)
    (folder / "a.json").write_text("\n".join(json.dumps({"seq": k, "op": "add", "id": f"i{k}", "text": "word " * (k + 1)}) for k in range(3)))
    corpus.follow(change_stream(spark, str(folder)), str(tmp_path / "cp")).awaitTermination()
    assert corpus.count() == 3
    assert all(r.cosine > 0 for r in corpus.search("nothing like it").select("signals.*").collect()) and seen == []
    (folder / "b.json").write_text(json.dumps({"seq": 5, "op": "remove_id", "id": "i0"}))
    corpus.follow(change_stream(spark, str(folder)), str(tmp_path / "cp")).awaitTermination()
    assert corpus.count() == 2
    corpus.set_embeddings(spark.createDataFrame([("i1", [9.0, 9.0], "stale"), ("i2", [7.0, 7.0], "word " * 3)], "id string, embedding array<float>, expected_text string"))
    got = {r.id: r.embedding for r in corpus.snapshot().collect()}
    assert got["i1"] != [9.0, 9.0] and got["i2"] == [7.0, 7.0]


def test_failing_embedder_leaves_nulls(spark, tmp_path):
    def fail(texts):
        raise RuntimeError("down")

    seen = []
    corpus = StreamingCorpus(spark, str(tmp_path / "c"), EmbedderAdapter(2, fail), seen.append)
    corpus.apply(log_df(spark, [{"seq": 1, "op": "add", "id": "a", "text": "red fox"}]))
    assert corpus.snapshot().where(F.col("embedding").isNull()).count() == 1
    assert [r.id for r in corpus.search("fox").collect()] == ["a"] and seen == [EmbeddingUnavailable()]


def test_batches_write_what_they_change(spark, tmp_path):
    """Random logs in batches against the simulation, over compactions; old versions stay readable until they are vacuumed."""
    path = str(tmp_path / "c")
    rows = random_log(5, False)
    corpus = StreamingCorpus(spark, path, most_segments=3)
    for batch in range(5):
        assert corpus.apply(log_df(spark, [r for r in rows if r["seq"] // 24 == batch]), batch)
        live = simulate([r for r in rows if r["seq"] < 24 * (batch + 1)])
        assert sorted((r.id, r.pos) for r in corpus.snapshot().collect()) == live
        if batch == 1:
            early, seen = corpus.version(), live
    assert not corpus.apply(log_df(spark, rows), 4)
    assert sorted((r.id, r.pos) for r in corpus.snapshot(early).collect()) == seen
    assert corpus.vacuum(1) > 0 and corpus.vacuum(1) == 0
    assert sorted((r.id, r.pos) for r in corpus.snapshot().collect()) == live
    with pytest.raises(ValueError):
        corpus.snapshot(early)


def test_a_writer_that_dies_loses_nothing(spark, tmp_path):
    path = tmp_path / "c"
    corpus = StreamingCorpus(spark, str(path))
    corpus.apply(log_df(spark, [{"seq": 1, "op": "add", "id": "a", "text": "red"}]), 0)
    version = corpus.version()
    (path / "rows-dead").mkdir()  # written, not committed
    (path / "version-000000000002.json").write_text('{"segm')  # torn
    again = StreamingCorpus(spark, str(path))
    assert again.version() == version and again.count() == 1
    again.apply(log_df(spark, [{"seq": 2, "op": "add", "id": "b", "text": "blue"}]), 1)
    assert again.count() == 2 and again.version() > version
    torn = tmp_path / "t"
    torn.mkdir()
    (torn / "rows-x").mkdir()
    with pytest.raises(CorruptCorpus):
        StreamingCorpus(spark, str(torn))


def test_late_write_back_of_one_id_twice(spark, tmp_path):
    corpus = StreamingCorpus(spark, str(tmp_path / "c"))
    corpus.apply(log_df(spark, [{"seq": k, "op": "add", "id": f"i{k}", "text": "t"} for k in range(3)]), 0)
    corpus.set_embeddings(spark.createDataFrame([("i1", [1.0], "t"), ("i1", [2.0], "t"), ("i2", [5.0], "old"), ("i2", None, "t")], "id string, embedding array<float>, expected_text string"))
    assert sorted((r.id, r.embedding) for r in corpus.snapshot().collect()) == [("i0", None), ("i1", [2.0]), ("i2", None)]


def test_many_rounds_of_adds_and_evictions(spark, tmp_path):
    """Twenty rounds that add five rows and evict from the third on what the round two before had added, half by group."""
    corpus, live, seq = StreamingCorpus(spark, str(tmp_path / "c"), most_segments=4), set(), 0
    for n in range(20):
        rows = [{"seq": (seq := seq + 1), "op": "add", "id": f"r{n}-{k}", "text": f"round {n}", "group": f"g{n}"} for k in range(5)]
        live |= {r["id"] for r in rows}
        if n >= 2:
            old = [{"seq": (seq := seq + 1), "op": "remove_group", "group": f"g{n - 2}"}] if n % 2 else [{"seq": (seq := seq + 1), "op": "remove_id", "id": f"r{n - 2}-{k}"} for k in range(5)]
            rows += old
            live -= {f"r{n - 2}-{k}" for k in range(5)}
        corpus.apply(log_df(spark, rows), n)
    assert {r.id for r in corpus.snapshot().collect()} == live and corpus.count() == 10


def test_shared_folder_where_none_is_named():
    """The setting counts; without it the context's folder; without that a local one, which the context keeps."""
    from types import SimpleNamespace

    from quillrank.session import shared_dir

    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = f"{path}/one"

    conf, context = {"spark.checkpoint.dir": "hdfs://a/b/"}, Context()
    session = SimpleNamespace(conf=conf, sparkContext=context)
    assert shared_dir(session) == "hdfs://a/b"
    conf.clear()
    first = shared_dir(session)
    assert first.endswith("quillrank-checkpoints/one") and shared_dir(session) == first == context.folder
