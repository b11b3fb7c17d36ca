"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Bins are ordered by residual. A bin carries a bitmap of the duplicate clusters in it and ``source_limit`` bitmaps of its
sources (a source's bit moves up one bitmap with each of its documents). A document goes to the tightest bin that fits:
the search starts at the successor of its size among the residuals and goes on past bins whose bitmaps conflict, until a
compatible one is found or a new bin is opened. Two members of a cluster never share a bin, nor do more than
``source_limit`` documents of a source. Documents are packed in groups of about ``group_rows`` rows that a hash deals, so
groups are packed side by side and each holds a mixture of all sources.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, word_count


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, source_limit: int) -> list[int]:
    """The bin of each item, items in order of falling size (ties: as given). Null sources and clusters conflict with nothing."""
    bits: dict = {}
    bit = lambda kind, x: 0 if x is None else 1 << bits.setdefault((kind, x), len(bits))
    seen = Counter(c for c in clusters if c is not None)
    open_: list[tuple[int, int]] = []  # (residual, bin), ascending
    of_source: list[list[int]] = []
    of_cluster: list[int] = []
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, sbit = sizes[i], bit(0, sources[i])
        cbit = bit(1, clusters[i]) if seen[clusters[i]] > 1 else 0  # a cluster of one conflicts with nothing
        at = bisect_left(open_, (size, -1))
        while at < len(open_):
            b = open_[at][1]
            if not (of_cluster[b] & cbit or of_source[b][-1] & sbit):
                break
            at += 1
        if at < len(open_):
            residual, b = open_.pop(at)
        else:
            residual, b = capacity, len(of_cluster)
            of_cluster.append(0)
            of_source.append([0] * source_limit)
        of_cluster[b] |= cbit
        planes = of_source[b]
        for p in range(source_limit):
            if not planes[p] & sbit:
                planes[p] |= sbit
                break
        insort(open_, (residual - size, b))
        out[i] = b
    return out


def pack(docs: DataFrame, capacity: int = 2048, source_limit: int = 4, group_rows: int = 4096, cluster_col: str | None = None) -> DataFrame:
    """doc_id, n_words, piece, start_word, words, bin, th (hash of the text): where every word of every row of ``docs`` is packed.

    A row of more than ``capacity`` words fills bins of its own with its whole pieces; the rest, or a shorter row, is an
    item of the packing. Without ``cluster_col``, rows with equal texts are a cluster. Null texts are empty; an empty
    row is an item of 0 words; null ids stay; null sources and clusters conflict with nothing; repeated rows are packed
    as often as they are there. An empty table gives no rows; other columns are ignored. Only ids, sizes and hashes are
    shuffled. A group that repeats of one row make larger than twice ``group_rows`` is packed in parts of that size.
    """
    text = F.col("text").cast("string")
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.when(F.length(text) > 0, F.hex(F.xxhash64(text)))
    spread = F.xxhash64(F.lit(5), F.col("doc_id"), text)
    n = docs.count()
    groups = max(1, -(-n // group_rows))
    th = F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.select(
        F.pmod(spread, F.lit(groups)).cast("long").alias("grp"), F.xxhash64(spread).alias("ord"), F.col("doc_id").cast("long").alias("doc_id"),
        word_count(text).alias("n_words"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"), th.alias("th"),
    )
    rows = rows.repartition("grp").sortWithinPartitions("grp", "ord", "doc_id")
    most = 2 * group_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group, used = None, 0  # bins of the group so far

        def flush() -> pa.RecordBatch:
            names = ["doc_id", "n_words", "piece", "start_word", "words", "bin", "th"]
            nonlocal used
            first, items = (group << 36) + used, []
            for r in held:
                full, rest = divmod(r[3], capacity)
                if rest or not full:
                    items.append((rest, r[4], r[5], r, full))
            bins = best_fit([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], capacity, source_limit)
            whole = max(bins, default=-1) + 1
            out = [(x[3][2], x[3][3], x[4], x[4] * capacity, x[0], first + b, x[3][6]) for x, b in zip(items, bins, strict=True)]
            for r in held:
                for piece in range(r[3] // capacity):
                    out.append((r[2], r[3], piece, piece * capacity, capacity, first + whole, r[6]))
                    whole += 1
            used += whole
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (r[0] != group or len(held) >= most):
                    yield flush()
                    used = used if r[0] == group else 0
                    held = []
                group = r[0]
                held.append(r)
        if held:
            yield flush()

    return rows.mapInArrow(run, "doc_id long, n_words long, piece long, start_word long, words long, bin long, th long")


def packed_texts(docs: DataFrame, capacity: int = 2048, **how) -> DataFrame:
    """``pack`` of ``docs`` and, for each row of it, the text of the piece: the packed corpus itself.

    A row of one piece keeps its text as it is; pieces of a longer row are its words with the white space before each.
    Rows of ``docs`` that are equal in id and text have the same pieces. Nulls are as in ``pack``; a null text is empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = pack(docs, capacity, **how)
    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_text")).withColumn("_th", F.xxhash64("_text")).dropDuplicates(["_id", "_th"])

    def pieces(words: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / capacity).cast("int")), lambda k: F.array_join(F.slice(words, k * capacity + 1, F.lit(capacity)), ""))
        return F.when(F.size(words) > capacity, parts).otherwise(F.array(F.col("_text")))

    words = F.regexp_extract_all("_text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.when(F.octet_length("_text") <= capacity, F.array("_text")).otherwise(let(words, pieces))  # so short a text is one piece
    split = whole.select("_id", "_th", F.posexplode(cut).alias("_piece", "_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")) & (F.col("piece") == F.col("_piece"))
    return packed.join(split, same).select(*[c for c in packed.columns if c != "th"], F.col("_text").alias("text"))
