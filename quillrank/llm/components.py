"""Connected components over edge tables, without collecting them anywhere.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
Each step takes a minimum per node by a map-side-combined aggregate and joins it back, so that a hub's edges are never
gathered in one window; the join is one that adaptive execution may split when a hub makes it skewed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, parts


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node of its component) that span the components of the edges (a[i], b[i])."""
    if not len(a):
        return a[:0], b[:0]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            break
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:  # pointer jumping
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _star(edges: DataFrame, large: bool, used: list[DataFrame], most: int) -> DataFrame:
    """One step; what it has written goes to ``used``."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written: a join of two scans is one that adaptive execution can split
    low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(most), "least")
    used.append(low)
    out = both.join(low, "u")
    if large:
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _sign(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """Columns ``node``, ``root``: the smallest node of its component, for every node of an edge but the roots.

    ``edges`` has long columns a and b; loops, repeats and either direction are fine; nulls are ignored. An empty table
    gives an empty table. ``nodes``, if known, is how many there are, and decides in how many parts the edges are written
    at first. Rounds grow with the logarithm of the number of nodes.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    apart = edges.where("a != b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = materialise(apart if nodes is None else apart.coalesce(parts(nodes)), "edges")
    sign = _sign(now)
    while sign[0]:
        used, most = [now], parts(sign[0])
        after = materialise(_star(_star(now, True, used, most), False, used, most).coalesce(most), "stars")
        for done in used:
            discard(done)
        was, now, sign = sign, after, _sign(after)
        if was == sign:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._quill_path = now._quill_path  # for discard()
    return out
