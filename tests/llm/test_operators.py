"""General interfaces, edge rows, and the pipeline's stages."""

import random

import numpy as np
import pytest

from quillrank.llm import mixing, order_minhash, packing, pii, prefix_tokens, quality, simhash, slots, toxicity, vector_join
from quillrank.llm import queries as Q
from quillrank.llm.components import components

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root long, size long, cell string, bin int, kind string"
LONG = "lorem ipsum dolor sit amet 12 " * 40_000
ROWS = [(1, None), (2, ""), (3, "   \t\n"), (None, "some words here"), (5, "some words here"), (5, "some words here"), (6, LONG), (7, None), (8, "a@b.co é́😀 +1 (555) 010-2000 10.0.0.1"), (None, None), (9, "x")]
LABELS = "doc_id long, quality int, toxic int"


def edge(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, None, "s" if (d or 0) % 2 else None, None, 1, 2, "c", 3, "k") for d, t in rows], SCHEMA)


def per_row(spark):
    docs = edge(spark)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (None, 1, 1), (8, None, None)], LABELS)
    first = slots.SlotMap.first(16)
    return {
        "simhash": lambda d: simhash.near_duplicates(d), "mixing": lambda d: mixing.digest(d), "order": lambda d: order_minhash.fingerprints(d),
        "quality": lambda d: quality.score(d, quality.train(docs, labels)), "tokens": lambda d: prefix_tokens.token_counts(d, Q.vocabulary("byte_bpe_50k.json")),
        "pii": lambda d: pii.digest(d), "slots": lambda d: slots.shard(d, first, first.grow()), "toxic": lambda d: toxicity.score(d, toxicity.train(docs, labels, steps=5)),
    }


@pytest.mark.parametrize("name", ["simhash", "mixing", "order", "quality", "tokens", "pii", "slots", "toxic"])
def test_edge_rows(spark, name):
    """A row for each row: nulls, empty and very long texts, repeated rows, clashing columns, and no rows at all."""
    f = per_row(spark)[name]
    got = f(edge(spark)).collect()
    key = lambda ids: sorted((-1 if i is None else i) for i in ids)
    assert key(r.doc_id for r in got) == key(d for d, _ in ROWS)
    assert f(edge(spark, [])).count() == 0


def test_packing_edge_rows(spark):
    got = packing.pack(edge(spark)).toPandas()
    assert got.words.sum() == mixing.digest(edge(spark)).toPandas()["size"].sum()
    assert (got.groupby("bin").words.sum() <= 2048).all()
    assert packing.pack(edge(spark, [])).count() == 0


def test_packed_texts(spark):
    """Every piece has the words that its row says, and a document's pieces are its words in order."""
    rows = [(d, t) for d, t in ROWS] + [(20, "w " * 2048), (21, "  a\n" + "word, " * 2049 + " "), (21, "other"), (22, "x" * 3000)]
    docs = edge(spark, rows)
    packed = packing.pack(docs).collect()
    got = packing.packed_texts(docs).collect()
    key = lambda r: (r.doc_id or -1, r.n_words, r.piece, r.bin)
    assert sorted(map(key, packed)) == sorted(map(key, got))
    texts = {}
    for r in got:
        assert len(r.text.split()) == r.words
        texts.setdefault((r.doc_id, r.n_words), {})[r.piece] = r.text
    for d, t in rows:
        assert any(" ".join(x[k] for k in sorted(x)).split() == (t or "").split() for (i, _), x in texts.items() if i == d)
    assert packing.packed_texts(edge(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    assert packing.best_fit([6, 5, 4, 3], ["a", "b", "c", "d"], [None] * 4, 10, 1) == [0, 1, 0, 1]
    assert packing.best_fit([6, 5, 4], ["a", "b", "a"], [None] * 3, 10, 1) == [0, 1, 1]
    assert packing.best_fit([6, 4], ["a", "b"], ["k", "k"], 10, 2) == [0, 1]


def test_best_fit_against_a_search_of_all_bins():
    rng = random.Random(9)
    for limit in (1, 2, 4):
        sizes = [rng.choice([0, rng.randint(1, 100), rng.randint(1, 20)]) for _ in range(400)]
        sources = [rng.choice([None, "a", "a", "a", "b", "c"]) for _ in sizes]
        clusters = [rng.choice([None, rng.randrange(60)]) for _ in sizes]
        bins, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = []
            for b, members in enumerate(bins):
                left = 100 - sum(sizes[m] for m in members)
                clash = clusters[i] is not None and any(clusters[m] == clusters[i] for m in members)
                crowd = sources[i] is not None and sum(sources[m] == sources[i] for m in members) >= limit
                if left >= sizes[i] and not clash and not crowd:
                    fits.append((left, b))
            want[i] = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([])
            bins[want[i]].append(i)
        assert packing.best_fit(sizes, sources, clusters, 100, limit) == want


def test_vector_edge_rows(spark):
    v = [1.0] + [0.0] * 7
    rows = [(1, v, 1), (2, [x * 3 for x in v], 1), (3, v, 2), (4, None, 1), (5, [0.0] * 8, 1), (6, [float("nan")] * 8, 1), (7, v, None), (8, [None] * 8, 1), (9, [], 1), (10, [1.0, 0.1] + [0.0] * 6, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_join.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[10] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9))
    assert vector_join.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_grid_finds_all_links_at_any_width(spark, monkeypatch):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(6)})
    least = {x: x for x in fps}
    for _ in fps:
        least = {a: min(least[b] for b in fps if (a ^ b).bit_count() <= 4) for a in fps}
    want = {x for x in fps if least[x] != x}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    groups = {}
    for c in (2, 3, 4):
        monkeypatch.setattr(simhash, "agreeing", lambda n, bits, c=c: c)
        found = components(simhash.links(frame, chunk=16))
        groups[c] = {(r.node, r.root) for r in found.collect()}
    assert groups[2] == groups[3] == groups[4]
    assert len(groups[2]) == len(want)


def test_deduplicate_near_copies(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    texts = [rng.choices(vocabulary, k=300) for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i in range(20):  # three edited words: 15 of 296 shingles, a likeness of 0.9
        t = list(texts[i])
        for at in rng.sample(range(300), 3):
            t[at] = "edited"
        rows.append((100 + i, " ".join(t)))
    rows += [(200 + i, " ".join(texts[i])) for i in range(20, 40)]
    kept = {r.doc_id for r in simhash.deduplicate(edge(spark, rows)).collect()}
    assert set(range(40)) <= kept
    assert len(kept - set(range(40))) <= 1
    assert simhash.deduplicate(edge(spark, [])).count() == 0
    assert simhash.deduplicate(edge(spark)).count() == 5  # one without words, one of the repeated text, and three others


def test_deduplicate_finds_appended_cut_and_short_copies(spark):
    """Against brute force over the five-word shingles: copies with a passage inserted, appended or cut, at many lengths."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    texts = []
    for n in (10, 15, 20, 40, 100, 300, 1500):
        for k in range(12):
            t = rng.choices(vocabulary, k=n)
            more, at = rng.choices(vocabulary, k=max(1, n * (4 + k) // 80)), rng.randrange(n)
            texts += [t, (t + more, t[: n - len(more)], t[len(more) :], t[:at] + more + t[at:])[k % 4]]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    least = list(range(len(texts)))
    for _ in range(3):
        least = [min(least[b] for b, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)) for x in sets]
    want = {i for i, x in enumerate(least) if x == i}
    assert 50 < len(texts) - len(want)
    assert {r.doc_id for r in simhash.deduplicate(edge(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()} == want


def test_contextual_patterns_find_unseen_identifiers(spark):
    seen = [(i, f"filler {i} reach me at mailbox user{i}@host{i}.example.com today") for i in range(12)]
    unseen = [(100 + i, f"filler {i} reach me at mailbox odd{i}@localhost today") for i in range(3)]
    got = {r.doc_id: (r.n_email, r.spans) for r in pii.digest(edge(spark, seen + unseen)).collect()}
    for d, text in unseen:
        at = text.index("odd")
        assert got[d] == (0, f"email:{at}:{text.index(' today')}")
    assert all(got[d][0] == 1 for d, _ in seen)


def test_contexts_hold_numbers_and_other_identifiers(spark):
    """A number among the two words before an identifier, one straight before it, and a name glued to it."""
    for how in ("user {} email {} now", "filler by code {} {} now", "item {} mail={} now"):
        seen = [(i, how.format(i + 10, f"user{i}@host{i}.example.com")) for i in range(12)]
        unseen = [(100 + i, how.format(i + 50, f"odd{i}@localhost")) for i in range(3)]
        got = {r.doc_id: r.spans for r in pii.digest(edge(spark, seen + unseen)).collect()}
        for d, text in unseen:
            assert got[d] == f"email:{text.index('odd')}:{text.index(' now')}"


def test_contextual_recall_and_precision(spark):
    """Unseen identifiers behind twenty contexts that seeds share, among as many tokens of like shape behind contexts of their own."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    hints, others = [f"{word()} {word()}" for _ in range(20)], [f"{word()} {word()}" for _ in range(20)]
    make = {"email": (lambda k: f"u{k}@h{k}.example.org", lambda k: f"u{k}@intranet"), "phone": (lambda k: f"+49 30 {rng.randint(10**6, 10**7)}", lambda k: f"030-{rng.randint(10**6, 10**7)}")}
    rows, planted, decoys = [], set(), 0
    for h, hint in enumerate(hints):
        seed, unseen = make["email" if h % 2 else "phone"]
        rows += [(1000 * h + k, f"{word()} {hint} {seed(k)} {word()}") for k in range(12)]
        for k in range(12, 18):
            text, value = f"{word()} {hint} ", unseen(k)
            rows.append((1000 * h + k, text + value + f" {word()}"))
            planted.add((1000 * h + k, f"{'email' if h % 2 else 'phone'}:{len(text)}:{len(text) + len(value)}"))
    for h, other in enumerate(others):  # like shapes, no seeds behind the same words
        for k in range(18):
            rows.append((100_000 + 1000 * h + k, f"{word()} {other} {make['email' if h % 2 else 'phone'][1](k)} {word()}"))
            decoys += 1
    got = pii.digest(edge(spark, rows)).collect()
    base = {r.doc_id: r.n_email + r.n_ip + r.n_card + r.n_phone for r in got}
    added = {(r.doc_id, s) for r in got if r.spans and not base[r.doc_id] for s in r.spans.split(",")}
    assert len(planted) == 120 and decoys == 360
    assert len(added & planted) >= 0.95 * len(planted) and len(added & planted) >= 0.95 * len(added)


def test_long_texts_of_identifiers(spark):
    """Work in proportion to the text: a hundred thousand tokens and spans in one text."""
    text = "a1@b.co 10.0.0.1 é 12 " * 25_000
    row = pii.digest(edge(spark, [(1, text)])).collect()[0]
    assert (row.n_email, row.n_ip) == (25_000, 25_000)
    spans = row.spans.split(",")
    assert len(spans) == 50_000 and spans[24_999] == f"email:{22 * 24_999}:{22 * 24_999 + 7}" and spans[-1] == f"ip:{22 * 24_999 + 8}:{22 * 24_999 + 16}"
    assert pii.redact(edge(spark, [(1, text)])).collect()[0].text == "[EMAIL] [IP] é 12 " * 25_000


def test_redact_over_parts_and_overlaps(spark):
    """Spans at, over and between the borders of the parts that a text is cut into; overlapping kinds are one cut."""
    rng = random.Random(4)
    values = ["a@b.co", "10.0.0.1", "+1 555 010 2000", "4111 1111 1111 1111", "+4111111111111111"]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 12)):
            parts += ["é😀x"[rng.randrange(3)] * rng.choice([0, 1, 5, 254, 255, 256, 257, 600]), rng.choice(values)]
        rows.append((d, " ".join(parts)))
    spans = {r.doc_id: r.spans for r in pii.digest(edge(spark, rows)).collect()}
    got = {r.doc_id: r.text for r in pii.redact(edge(spark, rows)).collect()}
    for d, text in rows:
        cuts = []
        for start, end, kind in sorted((int(s), int(e), pii.KINDS.index(k)) for k, s, e in (x.split(":") for x in spans[d].split(",") if x)):
            if cuts and cuts[-1][1] > start:
                cuts[-1][1] = max(cuts[-1][1], end)
            else:
                cuts.append([start, end, kind])
        out, at = "", 0
        for start, end, kind in cuts:
            out, at = out + text[at:start] + f"[{pii.KINDS[kind].upper()}]", end
        assert got[d] == out + text[at:]


def test_redact(spark):
    rows = [(1, "mail a@b.co now"), (2, "nothing"), (3, None), (4, "é 10.0.0.1 and +1 (555) 010-2000.")]
    got = {r.doc_id: r.text for r in pii.redact(edge(spark, rows)).collect()}
    assert got == {1: "mail [EMAIL] now", 2: "nothing", 3: None, 4: "é [IP] and [PHONE]."}


def test_prefix_counts_are_exact():
    from tokenizers import Tokenizer

    path = Q.vocabulary("byte_bpe_50k.json")
    plain, mine = Tokenizer.from_file(path), prefix_tokens.counter(path)
    for text in ("Hello  world, it's 2024!\n\n  x", "naïve café 😀 don't", "   lead", "a<|endoftext|>b"):
        counts = mine.prefix_counts(text)
        assert counts == [len(plain.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        for budget in range(counts[-1] + 1):
            assert mine.longest_prefix(text, budget) == max(k for k in range(len(text) + 1) if counts[k] <= budget)


def test_prefix_counts_of_awkward_strings():
    """Contractions, spaces of all kinds, control characters, marks and special strings in random order, every prefix and budget."""
    from tokenizers import Tokenizer

    path, rng = Q.vocabulary("byte_bpe_50k.json"), random.Random(1)
    plain, mine = Tokenizer.from_file(path), prefix_tokens.counter(path)
    parts = [*"\x1c\x1f\x85\xa0\u2003\u3000\ufeff\u200b\u0301abre'vlst  \n\t12é😀ñ.,!", "'re", "'ll", "'ve", "  ", " the", "<|endoftext|>"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randint(1, 30)))
        counts = [len(plain.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert mine.prefix_counts(text) == counts and mine.total(text) == counts[-1]
        for budget in range(0, counts[-1] + 1, 3):
            assert mine.total_and_fit(text, budget) == (counts[-1], max(k for k in range(len(text) + 1) if counts[k] <= budget))


def test_long_pieces_take_time_in_proportion():
    mine = prefix_tokens.counter(Q.vocabulary("byte_bpe_50k.json"))
    for text in ("abcde" * 60_000, "'" * 300_000, " " * 300_000 + "a"):
        assert mine.total_and_fit(text, 100)[1] == mine.longest_prefix(text, 100) >= 100


def test_long_runs_of_letters_are_read_whole():
    run = "".join(chr(0x4E00 + k) for k in range(1000))
    words = toxicity.tokens(f"a {run} b {'_'.join(['poison', 'apple'] * 20)} c_d")
    assert max(map(len, words)) <= 64 and words[-1] == "c_d" and words.count("poison") == 20
    assert {run[k : k + 5] for k in range(996)} <= {w[k : k + 5] for w in words for k in range(len(w) - 4)}
    scorer = toxicity.Scorer(toxicity.initial())
    a, b = scorer.windows([run * 3, run + run[:500] + "xyzzy" + run[500:] + run])
    assert len(a) == len(b) == len(toxicity.window_starts(len(toxicity.tokens(run * 3)))) > 1 and (a != b).any()
    changed = run[:500] + "x" * 8 + run[508:]
    a, b = scorer.windows([run, changed])
    assert (a != b).any()
    assert (toxicity.char_buckets([run])[1] == 3 * 1000 - 3).all()


def test_order_minhash_follows_order_and_edits():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    for n in (300, 5000):
        a, b = rng.choices(words, k=n), rng.choices(words, k=n // 3)
        text, other = " ".join(a), " ".join(b)
        sig = order_minhash.signature
        assert order_minhash.likeness(sig(text), sig(text)) == 1
        assert order_minhash.likeness(sig(text), sig(order_minhash.edit(text, other))) > order_minhash.likeness(sig(text), sig(other)) + 0.02
    assert order_minhash.likeness(sig(""), sig("")) == 1


def test_slot_maps(spark, tmp_path):
    m = slots.SlotMap.first(5)
    grown = m.grow()
    assert all(b in (a, 5) for a, b in zip(m.of_slot, grown.of_slot, strict=True)) and grown.version == m.version + 1
    heavy = {s: 1000 if s == 0 else 1 for s in range(slots.SLOTS)}
    load = lambda x: np.bincount(x.of_slot, weights=[heavy[s] for s in range(slots.SLOTS)])
    assert np.ptp(load(m.rebalance(heavy))) < np.ptp(load(m))
    slots.save_map(m, spark, str(tmp_path / "map"))
    slots.save_map(grown, spark, str(tmp_path / "map"))
    assert slots.load_map(spark, str(tmp_path / "map")) == grown


def test_pipeline_stages(spark):
    """Each stage keeps the columns of documents; each stage's result against its own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = P.materialise(stage(spark, docs, SF), "test")
        if k < len(P.STAGES) - 1:
            assert out.columns == columns, name
        rows = out.collect()
        if k < 2:
            assert all(seen[r.doc_id] == r.text for r in rows) and len({r.doc_id for r in rows}) == len(rows)
        if k == 1:
            texts = [r.text for r in rows]
            assert len(set(texts)) == len(texts)
        if k == len(P.STAGES) - 1:
            assert out.groupBy("bin").sum("words").where("`sum(words)` > 2048").count() == 0
        docs = out


def test_labels_of_vectors_may_be_strings(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None), (5, [1.0, 0.01], "a")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (2, 1)}


def test_sample_of_labelled_rows_is_bounded(spark):
    """An id that many rows share is one row of the sample; ids without a label, held out or null are none."""
    from quillrank.llm.common import is_held_out
    from quillrank.llm.samples import labelled

    docs = edge(spark, [(1, f"text {k}") for k in range(50)] + [(d, f"t{d}") for d in range(2, 60)] + [(None, "x")] * 9)
    labels = spark.createDataFrame([(d, d % 2, None) for d in range(1, 40)] + [(1, 0, None), (None, 1, None), (50, None, 1)], LABELS)
    got = labelled(docs, labels, "quality", 8).collect()
    assert len(got) == 16 and len({r.doc_id for r in got}) == 16 and not any(is_held_out(r.doc_id) for r in got)
    every = {r.doc_id: (r.text, r.label) for r in labelled(docs, labels, "quality", 1000).collect()}
    assert set(every) == {d for d in range(1, 40) if not is_held_out(d)} and every.get(1, ("text 0", 1)) == ("text 0", 1)


def test_quality_is_fitted_on_all_labelled_rows(spark):
    """The weights are at the least loss of all pairs, the bar at the quantile of all rows, brute force says."""
    from quillrank.llm.common import is_held_out

    rng = random.Random(4)
    rows = [(d, " ".join(f"w{int(rng.gauss(20 + 4 * (d % 2), 6))}" for _ in range(rng.randint(4, 12)))) for d in range(15_600)]
    labels = spark.createDataFrame([(d, d % 2, None) for d, _ in rows], LABELS)
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    x = {v: np.array([quality.features(t) for d, t in rows if d % 2 == v and not is_held_out(d)]) for v in (0, 1)}
    assert min(len(x[0]), len(x[1])) > 6000
    raw = np.sort(model.raw(np.concatenate([x[0], x[1]])))
    assert model.bar == (raw[len(x[0]) - 1] + raw[len(x[0])]) / 2
    z = {v: model.standard(x[v]) for v in x}
    s = {v: z[v] @ model.weight for v in x}
    wrong = [1 / (1 + np.exp(a - s[0])) for a in s[1]]
    pairs = len(x[0]) * len(x[1])
    gradient = (sum(wrong) @ z[0] - np.array([w.sum() for w in wrong]) @ z[1]) / pairs
    pull = np.full(len(model.weight), 1e-3)
    pull[len(quality.FEATURES) : quality.WIDTH] = 1e-2
    assert np.abs(gradient + pull * model.weight).max() < 1e-4 < 0.05 < np.abs(model.weight).max()
