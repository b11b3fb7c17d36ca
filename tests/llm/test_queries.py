"""The registered queries of the training-data operators against brute force on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quillrank.llm import queries as Q
from quillrank.llm import mixing, slots, vector_join

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")


#: Classifiers are held against the largest of the small tables: the smallest has 19 held-out labels.
LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels():
    return pd.read_parquet(f"{LARGE}/labels.parquet")


def run(spark, name):
    out = Q.queries()[name](spark, SF).toPandas()
    return out.set_index(out.columns[0]).sort_index()


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, docs):
    got = run(spark, "op1_simhash")
    fp = {d: plain_fingerprint(t) for d, t in docs.text.items()}
    assert got.fingerprint.to_dict() == {d: f"{x:016x}" for d, x in fp.items()}
    least = {d: d for d in fp}
    for _ in range(len(fp)):
        new = {a: min(least[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 4) for a in fp}
        if new == least:
            break
        least = new
    assert got.component_id.to_dict() == least


def plain_targets(sizes, order):
    """The law of the contract, one source over its limit at a time."""
    weight = {x: (3, 1, 2)[k % 3] for k, x in enumerate(order)}
    fixed = {}
    while True:
        rest = [x for x in order if x not in fixed]
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
        goal = {x: left * weight[x] / sum(weight[y] for y in rest) for x in rest}
        over = [x for x in rest if goal[x] > 2 * sizes[x] + 1e-9]
        if not over:
            return fixed | goal
        fixed |= {x: 2.0 * sizes[x] for x in over}


def test_mixing(spark, docs):
    got = run(spark, "op2_split_tree")
    sizes = docs.text.map(lambda t: len(WORD.findall(t)))
    assert got["size"].to_dict() == sizes.to_dict()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.groupby(docs.source)
    of_source = sizes.groupby(docs.source).sum()
    assert (by.source_size.first() == of_source).all()
    want = plain_targets(of_source.to_dict(), sorted(of_source.index))
    assert all(abs(by.target.first()[x] - w) < 1e-6 * max(1, w) for x, w in want.items())
    assert ((by.taken.sum() - by.target.first()).abs() <= by["size"].max()).all()
    assert got.taken.to_dict() == run(spark, "op2_split_tree").taken.to_dict()


def test_mixed_shards(spark):
    """Rows come as often as they are taken, each shard shuffled by itself and none much larger than another."""
    table = spark.read.parquet(f"{LARGE}/documents.parquet")
    rows = mixing.shard_rows(table).select("doc_id", "mix_shard", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).toPandas()
    taken = mixing.digest(table).toPandas().set_index("doc_id")
    times = rows.doc_id.value_counts()
    assert times.to_dict() == {d: len(x) for d, x in taken.shards.items() if len(x)}
    assert rows.groupby("doc_id").mix_shard.apply(sorted).to_dict() == {d: sorted(x) for d, x in taken.shards.items() if len(x)}
    size = rows.groupby("mix_shard").size()
    assert len(size) == 16 and size.max() < 1.3 * size.min()
    one = rows[rows.mix_shard == 3].sort_values("at").doc_id
    assert abs(one.reset_index(drop=True).corr(pd.Series(range(len(one))))) < 0.2


def test_order_minhash(spark, docs):
    got = run(spark, "op3_order_minhash")
    ids = sorted(docs.index, reverse=True)
    for i, d in enumerate(ids):
        text, half = docs.text[d], len(docs.text[d]) // 2
        edited = text[: len(text) - half] + docs.text[ids[(i + 1) % len(ids)]][:half]
        assert got.n_chars[d] == len(text)
        assert got.edited_sha256[d] == hashlib.sha256(edited.encode()).hexdigest()
    assert (got.near_edited > got.near_next).mean() > 0.97
    same = defaultdict(set)
    for d in ids:
        same[docs.text[d]].add(got.fingerprint[d])
    assert all(len(x) == 1 for x in same.values())


@pytest.mark.parametrize(("name", "label", "least"), [("op4_bradley_terry", "quality", 0.97), ("op10_bigru", "toxic", 0.97)])
def test_classifiers(spark, labels, name, label, least):
    """Held-out accuracy."""
    got = Q.queries()[name](spark, LARGE).toPandas().set_index("doc_id").sort_index()
    assert (got.held_out == [held(d) for d in got.index]).all()
    assert got.score.between(0, 1).all()
    assert ((got.score >= (0.3 if label == "quality" else 0.5)) == (got.predicted == 1)).all()
    test = labels[labels.doc_id.map(held)]
    assert (got.predicted[test.doc_id].to_numpy() == test[label].to_numpy()).mean() >= least


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(Q.vocabulary("byte_bpe_50k.json"))
    plain.no_padding()
    plain.no_truncation()
    got = run(spark, "op5_prefix_tokens")
    for d, text in docs.text.items():
        n = len(plain.encode(text, add_special_tokens=False).ids)
        assert (got.n_tokens[d], got.n_bytes[d], got.over_limit[d]) == (n, len(text.encode()), n > 1024)


def test_packing(spark, docs):
    got = Q.queries()["op6_best_fit"](spark, SF).toPandas()
    assert (got.groupby("bin").words.sum() <= 2048).all()
    assert got.groupby("doc_id").words.sum().to_dict() == docs.text.map(lambda t: len(WORD.findall(t))).to_dict()
    part = got.assign(source=docs.source[got.doc_id].to_numpy(), text=docs.text[got.doc_id].to_numpy())
    part = part[part.words < 2048]
    assert (part.groupby(["bin", "source"]).size() <= 4).all()
    assert (part[part.words > 0].groupby(["bin", "text"]).doc_id.nunique() <= 1).all()


def test_vectors(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    want = con.execute(Q.oracle_sql()["op7_pigeonhole"]).df().set_index("vec_id").sort_index()
    got = run(spark, "op7_pigeonhole")
    assert got[want.columns].to_dict() == want.to_dict()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_at_every_number_of_axes(spark, kind):
    """Clusters of near copies, copies, repeated and null ids, and a hot label, against brute force; chunks of 16 rows."""
    rng = np.random.default_rng(4)
    seeds = rng.standard_normal((12, 16))
    rows = []
    for k in range(240):
        v = seeds[k % 12] + rng.standard_normal(16) * (0.0 if k % 5 == 0 else 0.03 + 0.12 * (k % 3))
        rows.append((None if k % 40 == 7 else k - k % 2 if k % 30 == 1 else k, v.astype(np.float32).tolist(), 1 if k % 3 else k % 4))
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    x = np.array([r[1] for r in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    link = (unit @ unit.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(link, False)
    least = np.array([10**9 if r[0] is None else r[0] for r in rows])
    for _ in rows:
        least = np.array([min(least[k], least[link[k]].min(initial=10**9)) for k in range(len(rows))])
    want = sorted((-1 if r[0] is None else r[0], int(link[k].sum()), int(least[k])) for k, r in enumerate(rows))
    assert sum(w[1] > 0 for w in want) > 100
    for axes in (None, 0, 1, 2, 3):
        got = vector_join.linked(frame, axes=axes, chunk=16).collect()
        assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, 10**9 if r.component_id is None else r.component_id) for r in got) == want


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(only(s)) <= 19 and luhn(only(s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(only(s)) <= 15),
}


def only(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    twice = [2 * int(c) if i % 2 else int(c) for i, c in enumerate(reversed(s))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def base(text):
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if fine(m.group())] for k, (p, fine) in BASE.items()}


def test_pii(spark, docs):
    got = run(spark, "op8_contextual_pii")
    for d, text in docs.text.items():
        found = base(text)
        assert [got[f"n_{k}"][d] for k in BASE] == [len(x) for x in found.values()]
        all_ = [s for k in BASE for s in found[k]]
        assert got.base_sha256[d] == hashlib.sha256(",".join(all_).encode()).hexdigest()
        assert set(all_) <= set(got.spans[d].split(",")) | {""}


def test_shards(spark, docs):
    """Size, checksum, shard and place of every row, recomputed."""
    got = run(spark, "op9_virtual_slots")
    size = {d: len(t.encode()) + 1 for d, t in docs.text.items()}
    crc = {d: zlib.crc32(t.encode()) for d, t in docs.text.items()}
    assert got["size"].to_dict() == size and got.text_crc32.to_dict() == crc and set(got.law) == {"key"}
    sixteen = slots.SlotMap.first(16)
    vslot = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) % 4096 for d in docs.index}
    assert got.vslot.to_dict() == vslot
    assert got["shard"].to_dict() == {d: sixteen.of_slot[v] for d, v in vslot.items()}
    assert got.grown_shard.to_dict() == {d: sixteen.grow().of_slot[v] for d, v in vslot.items()}
    for _, part in got.groupby("shard"):
        order = sorted(part.index, key=lambda d: (vslot[d], d))
        assert part.slot.to_dict() == {d: k for k, d in enumerate(order)}
        assert part.vslot_bytes.to_dict() == {d: sum(size[x] for x in docs.index if vslot[x] == vslot[d]) for d in part.index}
    moved = got[got.grown_shard != got["shard"]]
    assert (moved.grown_shard == 16).all()


def test_shards_of_many_rows_without_an_id(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(None if k % 2 else k, f"text {rng.randrange(3000)}") for k in range(20_000)]
    first = slots.SlotMap.first(4)
    got = slots.shard(spark.createDataFrame(rows, "doc_id long, text string"), first).toPandas()
    assert sorted(got.text_crc32) == sorted(zlib.crc32(t.encode()) for _, t in rows)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got[got.doc_id.isna()]["shard"].nunique() == 1


def test_rebalance_of_a_stored_map(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    first = slots.SlotMap.first(8)
    slots.save_map(first, spark, path)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    new = slots.rebalance(table, path)
    assert slots.load_map(spark, path) == new and slots.load_map(spark, path, first.version) == first
    load = lambda m: slots.shard(table, m).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert load(new).max() - load(new).min() < load(first).max() - load(first).min()
    assert slots.rebalance(table, path) == new


def test_names_and_oracles():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in Q.queries()] == list(range(1, 11))
    assert set(Q.oracle_sql()) <= set(Q.queries())
