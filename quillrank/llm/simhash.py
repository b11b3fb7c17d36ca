"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints, so a range join of the vectors at distance ``bits`` finds every
link. The join is a grid join: the segments are cut into ``bits + c`` groups, of which two vectors within ``bits`` must
agree wholly in at least c, so each fingerprint is filed under the counts of every c groups; in a cell the whole
Manhattan distance is taken first, and only what passes is compared bit by bit. c is 2 for a few million fingerprints
and grows with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import spanning
from .common import discard, materialise, parts, slices
from .components import components

SEED = 42


def fingerprint(text: str | bytes | None, words: int = 4) -> int:
    """Majority bit vector of the XXH64 hashes of all shingles; 0 for a text without words."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    found = raw.lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(found) - words + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, th (hash of the text) and fp (the fingerprint's 64 bits as a signed long), a row for each of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, words) for t in b.column(2).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "th", "fp"])

    text = F.col(text_col).cast("string")
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("th"), text.alias("text"))
    return kept.mapInArrow(run, "doc_id long, th long, fp long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: the bit counts of the 32 two-bit segments, each in its two bits of a uint64."""
    fp = fp.astype(np.uint64)
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


_TWO = np.uint64(0x5555555555555555)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of two arrays of packed count vectors; every field is 0, 1 or 2."""
    hx, hy = (x >> np.uint64(1)) & _TWO, (y >> np.uint64(1)) & _TWO  # count 2
    ox, oy = (x | (x >> np.uint64(1))) & _TWO, (y | (y >> np.uint64(1))) & _TWO  # count 1 or 2
    return np.bitwise_count(hx ^ hy) + np.bitwise_count(ox ^ oy)


def _group_masks(groups: int) -> list[int]:
    cuts = [round(32 * g / groups) for g in range(groups + 1)]
    return [sum(3 << (2 * s) for s in range(lo, hi)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def agreeing(n: int, bits: int) -> int:
    """How many of ``bits`` plus that many groups must agree in a cell: the least work for n fingerprints.

    Any choice finds every link. More groups give more, narrower cells: a row is filed once for each, and the rows that
    meet in one by chance fall by the 1.5 bits that a segment's count carries. A comparison costs a hundredth of a filing.
    """
    work = lambda c: comb(bits + c, c) * (1 + 0.01 * n / 2 ** (48 * c / (bits + c)))
    return min(range(2, 7), key=work)


def links(nodes: DataFrame, bits: int = 4, chunk: int = 2048) -> DataFrame:
    """Edges (a, b) that span the components of the distinct fingerprints ``fp`` of ``nodes`` that differ in at most ``bits`` bits.

    Every such pair meets in a cell of the grid.
    """
    c = agreeing(nodes.count(), bits)
    masks = _group_masks(bits + c)
    cells = [sum(masks[i] for i in chosen) for chosen in combinations(range(bits + c), c)]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = segment_counts(b.column(0).to_numpy().view(np.uint64))
            for n, m in enumerate(cells):
                key = (counts & np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
                key = (key * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(n)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0), b.column(0)], names=["cell", "node", "fp"])

    def near(c: dict) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        fp = c["fp"].view(np.uint64)
        counts = segment_counts(fp)

        def within(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            hit = manhattan(counts[i], counts[j]) <= bits
            at = np.flatnonzero(hit)
            hit[at] = np.bitwise_count(fp[i[at]] ^ fp[j[at]]) <= bits
            return hit

        return within

    return spanning(nodes.select("fp").mapInArrow(file, "cell long, node long, fp long"), ["fp"], near, chunk)


#: Of the MINIMA least shingle hashes of a text, BANDS groups of ROWS are cells in which texts meet. A likeness of four
#: fifths misses all of them once in 3e5 pairs, one of 0.85 once in 9e7.
BANDS, ROWS, MINIMA = 24, 4, 128
KEYS, SIGNATURE = tuple(f"k{i}" for i in range(BANDS)), tuple(f"s{i}" for i in range(MINIMA // 32))
_RANKINGS = np.random.default_rng(SEED).integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def runs(text: str | bytes | None, words: int = 5) -> np.ndarray:
    """The hashes of all runs of ``words`` words, in text order; one of the whole text where it has fewer, 0 where none."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    found = raw.lower().split()
    if not found:
        return np.zeros(1, np.uint64)
    hash_of = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(found)}
    one = np.fromiter((hash_of[w] for w in found), np.uint64, len(found))
    n = max(1, len(one) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(one))):  # the order of the words counts
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + one[k : k + n]
    return out


def shingles(text: str | bytes | None, words: int = 5) -> np.ndarray:
    """The ascending distinct hashes of ``runs``."""
    return np.unique(runs(text, words))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of ``KEYS`` and the 64-bit values of ``SIGNATURE``, two bits of each minimum, for a text's shingle hashes."""
    least = np.full(MINIMA, ~np.uint64(0))
    for at in range(0, len(hashes), 256):
        x = hashes[None, at : at + 256] * _RANKINGS[:, None]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, x.min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    pairs = ((least >> np.uint64(8)) & np.uint64(3)).reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return keys, np.bitwise_or.reduce(pairs, axis=1)


def alike(x: np.ndarray, y: np.ndarray, likeness: float) -> bool:
    """Whether the Jaccard likeness of two arrays of distinct hashes is at least ``likeness``."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= likeness * (len(x) + len(y) - both) - 1e-9


def candidates(nodes: DataFrame, likeness: float, chunk: int = 2048) -> DataFrame:
    """Edges that span the components of texts that share a cell and may be ``likeness`` alike, by size and signature.

    ``nodes`` has longs node, size (number of shingles), ``KEYS`` and ``SIGNATURE``. The signature may be at most
    five deviations below what that likeness gives.
    """
    same = likeness + (1 - likeness) / 4  # two bits of different minima agree once in four
    most = MINIMA * (1 - same) + 5 * (MINIMA * same * (1 - same)) ** 0.5
    names = ["cell", "node", "size", *SIGNATURE]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(BANDS):
                yield pa.RecordBatch.from_arrays([b.column(k), *b.columns[BANDS:]], names=names)

    def near(c: dict) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        size, mark = c["size"], np.stack([c[x] for x in SIGNATURE], axis=1).view(np.uint64)

        def within(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            hit = np.minimum(size[i], size[j]) >= likeness * np.maximum(size[i], size[j]) - 1e-9
            at = np.flatnonzero(hit)
            differ = mark[i[at]] ^ mark[j[at]]
            hit[at] = np.bitwise_count((differ | (differ >> np.uint64(1))) & _TWO).sum(axis=1) <= most
            return hit

        return within

    filed = nodes.select(*KEYS, "node", "size", *SIGNATURE).mapInArrow(file, ", ".join(f"{x} long" for x in names))
    return spanning(filed, ["size", *SIGNATURE], near, chunk, 16384)


def close(nodes: DataFrame, bits: int, n: int) -> DataFrame:
    """Edges (a, b) that span the components of the ``n`` texts ``node`` whose fingerprints ``fp`` differ in at most ``bits`` bits.

    Texts with equal fingerprints are linked through the shared fingerprint, as in ``near_duplicates``.
    """
    prints = materialise(nodes.select("fp").distinct().coalesce(parts(n)), "fingerprints")
    roots = components(links(prints, bits), n)
    rooted = materialise(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root")).coalesce(parts(n)), "rooted")
    for done in (prints, roots):
        discard(done)
    out = rooted.join(rooted.groupBy("root").agg(F.min("node").alias("b")), "root").where("node != b").select(F.col("node").alias("a"), "b")
    out._quill_path = rooted._quill_path  # for discard()
    return out


def verified(texts: DataFrame, words: int, likeness: float, chunk: int = 1024) -> DataFrame:
    """Edges that span the components of texts of one group whose shingles are ``likeness`` alike, compared whole.

    ``texts`` has longs node and cell (the group) and the text. A pair that is linked already is not compared again.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t, words).view(np.int64) for t in b.column(2).cast(pa.binary()).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "cell", "sets"])

    def near(c: dict) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        ends, values = c["sets"].offsets.to_numpy(), c["sets"].values.to_numpy()
        size = np.diff(ends)

        def within(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            hit = np.minimum(size[i], size[j]) >= likeness * np.maximum(size[i], size[j]) - 1e-9
            for k in np.flatnonzero(hit):
                x, y = i[k], j[k]
                hit[k] = alike(values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]], likeness)
            return hit

        return within

    rows = materialise(texts.select("node", "cell", "text").mapInArrow(cut, "node long, cell long, sets array<long>"), "shingles")
    out = spanning(rows, ["sets"], near, chunk, 1024)
    out._quill_path = rows._quill_path  # for discard()
    return out


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id that links reach, itself included).

    One row for each row of ``docs``. A null text is like an empty one: fingerprint zero, linked like any other. Rows
    with equal fingerprints are linked through their shared fingerprint and never expanded into pairs. Null ids stay;
    their component is the smallest id that is not null, or null where there is none. An empty table gives no rows;
    columns other than the two named are ignored.
    """
    n = docs.count()
    marked = materialise(with_fingerprint(docs, words, id_col, text_col).coalesce(parts(n)), "simhash")
    nodes = materialise(marked.select("fp").distinct().coalesce(parts(n)), "fingerprints")
    roots = components(links(nodes, bits), n)
    # two written tables: a fingerprint that many rows share makes a join that adaptive execution can split
    rooted = marked.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    rows = materialise(rooted.coalesce(parts(n)), "rooted")
    for done in (marked, nodes, roots):
        discard(done)
    least = materialise(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")).coalesce(parts(n)), "least")
    return rows.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_sketch(docs: DataFrame, words: int = 5) -> DataFrame:
    """Columns doc_id, th (hash of the text), size (number of shingles), fp (SimHash) and the sketch, a row for each of ``docs``."""
    names = ["doc_id", "th", "size", "fp", *KEYS, *SIGNATURE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size, fp, got = [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                every = runs(t, words)
                distinct = np.unique(every)
                size.append(len(distinct))
                fp.append(majority(every))
                got.append(np.concatenate(sketch(distinct)))
            got, fp = np.array(got, np.uint64).view(np.int64), np.array(fp, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(fp), *[pa.array(x) for x in np.ascontiguousarray(got.T)]], names=names)

    text = F.col("text").cast("string")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("th"), text.alias("text"))
    return kept.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def deduplicate(docs: DataFrame, words: int = 5, likeness: float = 0.8, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of each component the one with the smallest id (ties: the least hash of the text).

    Texts are linked when the Jaccard likeness of their sets of ``words``-word shingles is at least ``likeness``. Candidates
    are the texts whose SimHash fingerprints of the shingles differ in at most ``bits`` bits, by the grid of segment counts,
    and, as fingerprints of texts so little alike mostly differ in more, those that share shingle minima (``BANDS`` and
    ``ROWS`` suit likenesses of about 0.8 and up); in each component of candidates the shingles are compared whole. A row with a null id stays only where its component has no other; of rows
    equal in id and text one stays. Null texts are empty, and texts without words are one component. Ids, hashes and,
    of candidates, shingles are grouped; the texts are filtered by them.
    """
    most = parts(docs.count())
    marked = materialise(with_sketch(docs, words).coalesce(most), "sketches")
    nodes = materialise(marked.groupBy(F.col("th").alias("node"), "size", "fp", *KEYS, *SIGNATURE).agg(F.min("doc_id").alias("one")).coalesce(most), "nodes")
    n = nodes.count()
    linked = close(nodes, bits, n)
    near = components(candidates(nodes, likeness).unionByName(linked), n)
    discard(linked)
    groups = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    asked = materialise(nodes.select("node", "one").join(groups, "node").withColumnRenamed("root", "cell").coalesce(most), "candidates")
    text = F.col("text").cast("string")
    mine = (text_hash(text) == F.col("node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("one"))
    texts = docs.select("doc_id", "text").join(asked, mine).select("node", "cell", text.alias("text"))
    found = verified(texts.coalesce(most), words, likeness)
    roots = components(found, n)
    rows = marked.select("doc_id", "th").join(roots.withColumnRenamed("node", "th"), "th", "left").select("doc_id", "th", F.coalesce("root", "th").alias("root"))
    each = rows.groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")).alias("k"))
    keep = materialise(first.select(F.col("k.doc_id").alias("_keep_id"), F.col("k.th").alias("_keep_th"), F.col("k.n").alias("_keep_n")).coalesce(most), "keepers")
    for done in (marked, nodes, near, asked, found, roots):
        discard(done)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_keep_id")) & (text_hash(F.col("text").cast("string")) == F.col("_keep_th"))
    out = docs.join(keep.where("_keep_n = 1"), same, "left_semi")
    repeated = keep.where("_keep_n > 1")
    if repeated.isEmpty():
        return out
    return out.unionByName(docs.join(repeated, same).dropDuplicates(["_keep_id", "_keep_th"]).select(*docs.columns))
