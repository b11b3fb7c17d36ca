"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's rows are dealt by a hash into blocks, and its blocks have a fixed random order. A source's target is a quota
of blocks of that order: whole passes over all blocks, then blocks until the target, the last one in part. A binary tree
over the output shards splits the vector of quotas: at each node the left half's blocks are drawn from a multivariate
hypergeometric law, so quotas are met exactly and every shard holds what a uniform shuffle of all blocks would give it.
A leaf's counts say which stretch of each source's order a shard draws; stretches are disjoint, and rows are shuffled
inside their shard by a hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

BLOCKS = 1024
#: Up to so many blocks of all sources, their placement is broadcast; beyond, it is joined by a shuffle.
BROADCAST = 200_000
#: A stretch of an output shard's order has about so many rows.
STRETCH = 4096


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take from each source: ``share`` of all words by weight, none above ``most`` times its source.

    Sources take the weights in code point order, null last, repeating. What exceeds a limit is shared by weight among
    the sources still below theirs, until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if given[s] > most * sizes[s]]
        if not over:
            return out | given
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
        left = max(left, 0.0)
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources); every column sums to its quota, every row to an even share."""
    rng = np.random.default_rng(seed)

    def split(quota: np.ndarray, k: int) -> list[np.ndarray]:
        if k == 1:
            return [quota]
        left = k // 2
        take = int(quota.sum()) * left // k
        drawn, rest, need = np.zeros_like(quota), int(quota.sum()), take
        for i, q in enumerate(quota):  # marginal by marginal; numpy's own sampler limits the total
            rest -= int(q)
            drawn[i] = rng.hypergeometric(int(q), rest, need) if need and (int(q) or rest) else 0
            need -= int(drawn[i])
        return split(drawn, left) + split(quota - drawn, k - left)

    return np.stack(split(quotas.astype(np.int64), shards)) if shards > 0 else np.zeros((0, len(quotas)), np.int64)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 11, blocks: int = BLOCKS, size: Column | None = None) -> DataFrame:
    """``docs`` with ``_mix_size``, ``_mix_source_size``, ``_mix_target`` and ``_mix_shards`` (one shard for each time the row is taken).

    ``size`` defaults to the number of words of ``text``. A row is taken at most ``ceil(most)`` times. One row for each
    source comes to the driver; blocks are at most ``blocks`` for each source. A null source is a source of its own;
    null texts and ids are fine; a source without words has target 0; an empty table gives no rows. Rows equal in id and
    text fall to one block. The same table and seed give the same mix, however it is partitioned.
    """
    source = F.col("source").cast("string")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("-"))
    row_hash = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    words = size if size is not None else word_count(F.col("text").cast("string"))
    keyed = docs.withColumns({"_mix_key": key, "_mix_hash": row_hash}).withColumn("_mix_block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_mix_hash")), F.lit(blocks)).cast("int"))
    base = keyed.withColumn("_mix_size", words)
    table = base.groupBy("_mix_key", "_mix_block").agg(F.sum("_mix_size").alias("n")).persist()
    totals = {r["_mix_key"]: (int(r.n or 0), int(r.b)) for r in table.groupBy("_mix_key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("b")).collect()}
    names = {k: (k[1:] if k[0] == "=" else None) for k in totals}
    sizes = {names[k]: n for k, (n, _) in totals.items()}
    goal = targets(sizes, weights, share, most)
    keys = sorted(totals)
    spark = docs.sparkSession
    plan = []
    for k in keys:
        n, t = totals[k][0], goal[names[k]]
        passes = int(t // n) if n else 0
        plan.append((k, n, float(t), passes, float(t - passes * n) if n else 0.0))
    per_source = spark.createDataFrame(plan, "_mix_key string, _mix_source_size long, _mix_target double, passes int, residue double")
    order = Window.partitionBy("_mix_key").orderBy(F.xxhash64(F.lit(seed + 2), F.col("_mix_key"), F.col("_mix_block")), "_mix_block")
    ranked = (  # a window over at most ``blocks`` rows of a source
        table.join(F.broadcast(per_source), "_mix_key")  # one row for each source
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("drawn", (F.col("before") < F.col("residue")).cast("int"))
        .persist()
    )
    extra = {r["_mix_key"]: int(r.d or 0) for r in ranked.groupBy("_mix_key").agg(F.sum("drawn").alias("d")).collect()}
    quotas = np.array([totals[k][1] * p + extra.get(k, 0) for k, (_, _, _, p, _) in zip(keys, plan, strict=True)], np.int64)
    ends = np.cumsum(split_tree(quotas, shards, seed), axis=0) if keys else np.zeros((shards, 0), np.int64)
    stretches = spark.createDataFrame([(k, totals[k][1], [int(x) for x in ends[:, i]]) for i, k in enumerate(keys)], "_mix_key string, n_blocks long, ends array<long>")
    shard_of = lambda p: F.size(F.filter("ends", lambda e: e <= p.cast("long") * F.col("n_blocks") + F.col("place"))).cast("int")
    reaches = (F.col("drawn") == 1) & (F.col("before") + F.col("n") >= F.col("residue"))
    placed = ranked.join(F.broadcast(stretches), "_mix_key").select(
        "_mix_key", "_mix_block", "_mix_source_size", "_mix_target",
        F.transform(F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.expr("cast(array() as array<int>)")), shard_of).alias("_mix_whole"),
        F.when(F.col("drawn") == 1, shard_of(F.col("passes"))).alias("_mix_last"),
        F.when(reaches, F.col("residue") - F.col("before")).alias("_mix_left"),
    )
    # of the one block of a source that reaches the target, rows whose middle is still below it; only there is an order
    # of rows needed, and only hashes and sizes are sent to find the last hash taken
    edge = keyed.join(F.broadcast(placed.where("_mix_left is not null").select("_mix_key", "_mix_block", "_mix_left")), ["_mix_key", "_mix_block"])
    equal = edge.withColumn("_mix_size", words).groupBy("_mix_key", "_mix_left", "_mix_hash").agg(F.sum("_mix_size").alias("n"))
    run = F.sum("n").over(Window.partitionBy("_mix_key").orderBy("_mix_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bars = equal.withColumn("run", run).where(F.col("run") - F.col("n") / 2 < F.col("_mix_left")).groupBy("_mix_key").agg(F.max("_mix_hash").alias("_mix_bar"))
    edges = materialise(placed.join(F.broadcast(bars), "_mix_key", "left"), "mix")  # bars: a row for each source
    table.unpersist()
    ranked.unpersist()
    joined = base.join(F.broadcast(edges) if sum(b for _, b in totals.values()) <= BROADCAST else edges, ["_mix_key", "_mix_block"])
    last = F.col("_mix_last").isNotNull() & (F.col("_mix_left").isNull() | F.coalesce(F.col("_mix_hash") <= F.col("_mix_bar"), F.lit(False)))
    taken = F.when(last, F.concat("_mix_whole", F.array("_mix_last"))).otherwise(F.col("_mix_whole"))
    return joined.withColumn("_mix_shards", taken).drop("_mix_key", "_mix_block", "_mix_whole", "_mix_last", "_mix_left", "_mix_hash", "_mix_bar")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` once for each time they are taken, in the order of ``shard_rows``."""
    return shard_rows(docs, **how).drop("mix_shard")


def shard_rows(docs: DataFrame, seed: int = 11, shards: int = 16, **how) -> DataFrame:
    """The mix as output shards: columns of ``docs`` and ``mix_shard``, shuffled inside each shard.

    A shard is a sequence of stretches, each of them whole and in order in one partition.
    """
    names = docs.columns
    bits = max(6, (docs.count() // (shards * STRETCH)).bit_length())
    out = mix(docs, seed=seed, shards=shards, **how).select(*names, F.posexplode("_mix_shards").alias("_mix_draw", "mix_shard"))
    shuffled = F.xxhash64(F.lit(seed + 3), F.col("doc_id"), F.col("text"), F.col("_mix_draw"))
    out = out.withColumn("_mix_order", shuffled)
    stretch = F.shiftright(F.col("_mix_order"), 64 - bits)  # a shard's order is cut into stretches, each sorted by itself
    return out.repartition("mix_shard", stretch).sortWithinPartitions("mix_shard", "_mix_order").drop("_mix_draw", "_mix_order")


def digest(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) for every row of ``docs``."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("text").cast("string").alias("text"))
    out = mix(kept, **how)
    return out.select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.size("_mix_shards")).cast("long").alias("taken"), F.col("_mix_shards").alias("shards"),
    )
