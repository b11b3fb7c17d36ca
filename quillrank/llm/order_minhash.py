"""Document fingerprints by Order MinHash.

Order MinHash (Marcais et al., "Locality-sensitive hashing for the edit distance", 2019) numbers the occurrences of each
k-mer, ranks the pairs (k-mer, number) by a hash, keeps the least few and hashes them in text order: two texts then share
an entry with a probability that follows their edit distance, which sets of k-mers alone do not. Here one hash serves all
``sketches`` entries: its high bits deal the pairs to entries and its low bits rank them, so a text is hashed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

_M1, _M2, _GOLD, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))

_PLACE = np.uint64(26)  # bits of a position


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def signature(text: str, k: int = 8, sketches: int = 64, each: int = 2) -> np.ndarray:
    """``sketches`` (a power of two) entries of 32 bits; 0: no k-mer fell to the entry. A text shorter than ``k`` is one k-mer."""
    out = np.zeros(sketches, np.uint64)
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(h):
        return out.astype(np.uint32)
    width, short = 1, min(k, len(h))
    h *= _GOLD
    while width < short:  # hashes of windows of 1, 2, 4, ... and the last step to k
        step = min(width, short - width)
        left = h[:-step] * _STEP
        left += h[step:]
        left ^= left >> np.uint64(32)
        h, width = left, width + step
    n = len(h)
    # occurrence numbers: sort by the hash's high bits and then by position, in one word; as many bits at any length
    same, at = _mix(h) >> _PLACE, np.arange(n, dtype=np.uint64)
    if n < 1 << int(_PLACE):
        packed = (same << _PLACE) | at
        packed.sort()
        same, at = packed >> _PLACE, packed & ((np.uint64(1) << _PLACE) - np.uint64(1))
    else:
        at = np.argsort(same, kind="stable").astype(np.uint64)
        same = same[at]
    begin = np.flatnonzero(same[1:] != same[:-1]) + 1
    runs = np.diff(begin, prepend=0, append=n)
    pairs = same * _GOLD
    if len(runs) < n:
        pairs += (np.arange(n) - np.repeat(np.concatenate([[0], begin]), runs)).astype(np.uint64) * _M2
    pairs = _mix(pairs)
    shift = np.uint64(65 - sketches.bit_length())  # the high bits are the entry, the others the rank
    wanted = 4 * each + 12  # of each entry; only if one is left with too few are all pairs ranked
    if n > wanted * sketches:
        few = (pairs & ((np.uint64(1) << shift) - np.uint64(1))) < np.uint64((1 << int(shift)) * wanted * sketches // n)
        if np.bincount((pairs[few] >> shift).astype(np.int64), minlength=sketches).min() >= each:
            pairs, at = pairs[few], at[few]
    order = np.argsort(pairs)
    pairs, at = pairs[order], at[order]
    first = np.searchsorted(pairs, np.arange(sketches, dtype=np.uint64) << shift)
    size = np.minimum(np.diff(first, append=len(pairs)), each)
    index = first[:, None] + np.arange(each)
    there = np.arange(each) < size[:, None]
    index = np.where(there, index, 0)
    place = np.where(there, at[index], np.uint64(1 << 63))
    chosen = np.take_along_axis(np.where(there, pairs[index], np.uint64(0)), np.argsort(place, axis=1, kind="stable"), axis=1)
    for p in range(each):
        out = _mix(out * np.uint64(31) + chosen[:, p])
    return np.where(size > 0, np.maximum(out & np.uint64(0xFFFFFFFF), np.uint64(1)), np.uint64(0)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries among those that either text fills; 1 for two empty texts."""
    used = (a != 0) | (b != 0)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def fingerprint(text: str, **how: int) -> str:
    return signature(text, **how).astype(">u4").tobytes().hex()


def edit(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) that are not above the id, by binary search in a literal array."""
    n, steps = len(bounds), []
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    table = F.lit(bounds)
    add = lambda lo, s: lo + F.when((lo + s <= n) & (F.element_at(table, F.least(lo + s, F.lit(n))) <= doc_id), s).otherwise(0)
    return F.aggregate(F.lit(steps), F.lit(0), add) if n else F.lit(0)


def fingerprints(docs: DataFrame, k: int = 8, sketches: int = 64, each: int = 2, rows_per_range: int = 128, most_ranges: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs``.

    The next document is the one with the next smaller id (equal ids: by a hash of the text; null ids last); after the
    last comes the first, and a document alone is its own next one. Null texts are empty. Equal texts have equal
    fingerprints. An empty table gives no rows; other columns are ignored. Texts are shuffled once, into ranges of ids;
    an id (or null) that many rows share has ranges of its own, by hash. The first document of each range is sent to the
    range before it as well, and ranges are read as streams, two texts at a time.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = kept.where("doc_id is not null").select("doc_id")
    n = kept.count()
    ranges = max(1, min(most_ranges, n // rows_per_range))
    marks = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("p")).first().p if ranges > 1 else []
    often = {x for x, y in zip(marks or [], (marks or [])[1:], strict=False) if x == y}  # more than a range's share of the rows
    bounds = sorted({*(marks or []), *(x + 1 for x in often)})
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(_bucket(F.col("doc_id"), bounds))
    heads = kept.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).collect()  # a row for each bucket
    heads.sort(key=lambda r: -r.bucket)  # in text order: largest ids first, nulls last
    size = len(bounds) + 2
    first_range, cuts, head_of, done = [0] * size, [1] * size, [None] * size, 0
    for r in heads:
        first_range[r.bucket + 1], head_of[r.bucket + 1] = done, r.head
        if r.head == r.least:  # one id, or none
            cuts[r.bucket + 1] = max(1, -(-r.n * ranges // n))
        done += cuts[r.bucket + 1]
    of = lambda table: F.element_at(F.lit(table), F.col("bucket") + 2)
    high = (F.shiftright("hash", 40) + (1 << 23)) * of(cuts)  # 24 bits
    keyed = kept.withColumn("hash", F.xxhash64("text")).withColumn("bucket", bucket)
    keyed = keyed.withColumn("range", of(first_range) + F.shiftright(high, 24).cast("int"))
    is_head = F.when(F.col("bucket") == -1, True).otherwise(F.col("doc_id") == of([-1 if x is None else x for x in head_of]))
    firsts = keyed.where(is_head).groupBy("range").agg(F.first("doc_id").alias("doc_id"), F.min(F.struct("hash", "text")).alias("t"))
    firsts = materialise(firsts, "firsts")  # a document for each range
    there = sorted(r.range for r in firsts.select("range").collect())
    before = [0] * max(1, done)
    for i, r in enumerate(there):
        before[r] = there[i - 1]
    lent = firsts.select(F.element_at(F.lit(before), F.col("range") + 1).alias("range"), F.lit(1).alias("role"), "doc_id", F.col("t.text").alias("text"))
    spread = keyed.select("range", F.lit(0).alias("role"), "doc_id", "text", "hash").unionByName(lent.withColumn("hash", F.lit(0).cast("long")))
    dealt = spread.repartition("range").sortWithinPartitions("range", "role", F.col("doc_id").desc_nulls_last(), "hash", "text").drop("hash")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = lambda s: s.astype(">u4").tobytes().hex()
        last = None  # range, id, text, signature of a document that waits for the next one
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in slices(batches):
            rows = []
            for at, role, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                sig = signature(text, k, sketches, each)
                if last is not None and last[0] == at:
                    _, doc0, text0, sig0 = last
                    edited = edit(text0, text)
                    sig1 = sig0 if edited == text0 else signature(edited, k, sketches, each)
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    rows.append((doc0, len(text0), digest, hexed(sig0), hexed(sig1), likeness(sig0, sig1), likeness(sig0, sig)))
                last = None if role else (at, doc, text, sig)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)

    return dealt.mapInArrow(run, schema)
