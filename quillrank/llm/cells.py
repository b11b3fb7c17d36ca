"""Joins of all rows that share a cell, cut into blocks of bounded size.

A cell is a key that two rows must share to be compared. Most cells hold a row or two; a hot one may hold a third of
the table. ``blocks`` deals the rows of a cell with more than ``chunk`` rows by a hash into chunks, and each pair of
chunks is a block of its own, for joins that must see every pair. ``spanning`` serves joins that need components alone,
and compares as few chunks as those need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import components, forest

#: Up to so many large cells, their sizes are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CELLS = 100_000


def blocks(rows: DataFrame, cell: str, spread: str, chunk: int) -> DataFrame:
    """``rows`` with long columns ``block`` (rows of a block are to be compared) and ints ``ci``, ``cj``, ``mine``.

    ``mine`` is the row's chunk. In a block with ci == cj all pairs count; in others only pairs between chunk ci and cj.
    ``cell`` is a long column; rows whose cell no other row shares stay, and cost nothing. ``spread`` is a long column
    whose hash deals rows into chunks.
    """
    large = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk).select(cell, F.ceil(F.col("_n") / chunk).cast("int").alias("_k"))
    large = large.persist()
    few = large.limit(BROADCAST_CELLS + 1).count()
    if not few:
        large.unpersist()
        zero = F.lit(0)
        return rows.select("*", F.col(cell).alias("block"), zero.alias("ci"), zero.alias("cj"), zero.alias("mine"))
    joined = rows.join(F.broadcast(large) if few <= BROADCAST_CELLS else large, cell, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    mine = F.pmod(F.xxhash64(F.lit(7), F.col(spread)), F.col("_k").cast("long")).cast("int")
    joined = joined.withColumn("mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    ci, cj = F.least("mine", "_other"), F.greatest("mine", "_other")
    out = joined.withColumn("ci", ci).withColumn("cj", cj).drop("_other")
    block = F.when(F.col("_k") == 1, F.col(cell)).otherwise(F.xxhash64(F.col(cell), F.col("ci"), F.col("cj")))
    return out.withColumn("block", block).drop("_k")


def stars(c: dict[str, np.ndarray], near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.RecordBatch | None:
    """Edges that span the components of the pairs of rows of one block for which ``near`` holds.

    Rows are compared with the next one of their block, then the next but one, and so on. Pairs that are linked already
    are not asked, and a block is left as soon as it is one component, so a group of copies takes a few rounds.
    """
    nodes, at = np.unique(c["node"], return_inverse=True)
    root = np.arange(len(nodes))
    a = b = root[:0]
    block = c["block"]
    new = np.concatenate([[True], block[1:] != block[:-1]])
    run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    i, d = np.arange(len(block)), 1
    while True:
        i = i[i < len(block) - d]
        i = i[run[i] == run[i + d]]
        if not len(i):
            break
        x = i[root[at[i]] != root[at[i + d]]]
        if len(x):
            x = x[near(x, x + d)]
        if len(x):
            a, b = forest(np.concatenate([a, at[x]]), np.concatenate([b, at[x + d]]))
            root[a] = b
        if d & (d - 1) == 0:
            roots = root[at]
            i = i[(np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts))[run[i]]]
        d += 1
    return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"]) if len(a) else None


#: So many rows of a large cell, chosen by a hash, stand in all its chunks.
PIVOTS = 16


def spanning(rows: DataFrame, columns: list[str], near: Callable[[dict[str, np.ndarray]], Callable[[np.ndarray, np.ndarray], np.ndarray]], chunk: int, least: int = 65536) -> DataFrame:
    """Edges (a, b) that span the components of the pairs of ``rows`` that share a cell and are near.

    ``rows`` has longs cell and node, and ``columns``; ``near`` makes a test of index pairs from a batch's columns. A cell
    of up to ``chunk`` rows is one block, and all its pairs count. The rows of a larger one are dealt into chunks, with a
    few of them in every chunk, which links what is alike at once. Only where that leaves more than one component are the
    rows outside of the largest compared with all others, chunk by chunk, so that no link is lost; pairs inside a
    component are not asked again.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_block(batches, ["block"], lambda c: stars(c, near(c)), least)

    def compared(blocks_: DataFrame) -> DataFrame:
        return blocks_.select("block", "node", *columns).repartition("block").sortWithinPartitions("block", "node").mapInArrow(join, "a long, b long")

    count = F.count(F.lit(1)).alias("_n")
    large = rows.groupBy("cell").agg(count).where(F.col("_n") > chunk).persist()
    few = large.limit(BROADCAST_CELLS + 1).count()
    if not few:
        large.unpersist()
        return compared(rows.withColumn("block", F.col("cell")))
    sent = (lambda df: F.broadcast(df)) if few <= BROADCAST_CELLS else (lambda df: df)
    marked = rows.join(sent(large), "cell", "left")
    small = marked.where("_n is null").withColumn("block", F.col("cell"))
    hot = materialise(marked.where("_n is not null").select("cell", "_n", "node", *columns), "hot")
    chunks, dealt = F.ceil(F.col("_n") / chunk).cast("long"), F.xxhash64(F.lit(7), F.col("node"))
    mine = F.pmod(dealt, chunks)
    pivot = F.pmod(F.xxhash64(F.lit(8), F.col("node")), F.col("_n")) < PIVOTS
    everywhere = F.when(pivot, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(mine))
    first = hot.withColumn("_c", F.explode(everywhere)).withColumn("block", F.xxhash64("cell", "_c"))
    edges = materialise(compared(small.select("block", "node", *columns).unionByName(first.select("block", "node", *columns))), "spans")
    roots = components(edges)
    tagged = hot.join(roots.withColumnRenamed("root", "_root"), "node", "left").withColumn("_root", F.coalesce("_root", "node"))
    sizes = tagged.groupBy("cell", "_root").agg(count).groupBy("cell").agg(F.max(F.struct("_n", "_root")).alias("_most"), F.sum("_n").alias("_all"))
    rest = F.col("_all") - F.col("_most._n")
    open_ = sizes.where(rest > 0).select("cell", F.col("_most._root").alias("_top"), F.ceil(rest / chunk).cast("long").alias("_r")).persist()
    if not open_.isEmpty():
        # blocks of a chunk of the rest with a chunk of the largest component, or with another of the rest; nodes are roots
        ask = tagged.join(sent(open_), "cell")
        other = F.col("_root") != F.col("_top")
        part = F.pmod(dealt, F.col("_r"))
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        with_top = F.when(other, F.transform(upto(chunks), lambda k: F.xxhash64("cell", F.lit(1), part, k))).otherwise(F.transform(upto(F.col("_r")), lambda k: F.xxhash64("cell", F.lit(1), k, mine)))
        with_rest = F.when(other, F.transform(upto(F.col("_r")), lambda k: F.xxhash64("cell", F.lit(2), F.least(part, k), F.greatest(part, k)))).otherwise(F.array().cast("array<long>"))
        more = ask.withColumn("block", F.explode(F.concat(with_top, with_rest))).select("block", F.col("_root").alias("node"), *columns)
        found = materialise(compared(more), "spans")
        edges = edges.unionByName(found)
    for done in (large, open_):
        done.unpersist()
    for done in (hot, roots):
        discard(done)
    return edges


def by_block(batches: Iterator[pa.RecordBatch], keys: list[str], each: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None], least: int = 65536) -> Iterator[pa.RecordBatch]:
    """Feed ``each`` with column arrays that hold whole runs of ``keys`` (the input is sorted by them), many runs at once."""
    held: list[pa.RecordBatch] = []

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        out = {}
        for name in table.column_names:
            col = table.column(name).combine_chunks()
            out[name] = col.to_numpy(zero_copy_only=False) if not pa.types.is_nested(col.type) and not pa.types.is_binary(col.type) else col
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[-1].as_py() for k in keys]
        same = np.ones(table.num_rows, dtype=bool)
        for k, v in zip(keys, last, strict=True):
            same &= table.column(k).to_numpy() == v
        cut = int(np.argmax(same)) if same.all() else int(table.num_rows - np.argmin(same[::-1]))
        if cut:
            out = each(columns(table.slice(0, cut)))
            if out is not None and out.num_rows:
                yield out
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        out = each(columns(pa.Table.from_batches(held)))
        if out is not None and out.num_rows:
            yield out
