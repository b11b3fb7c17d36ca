"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t are within squared distance 2 - 2t. Vectors are rotated onto the principal axes of a sample
and cut into blocks, and the squared distance is shared among the blocks in proportion to their variance: a pair within
the whole must be within the share of at least one block. Each block is range-joined: pairs within its share, found by
one product of augmented block vectors, are candidates, and the union of the blocks' candidates is verified by the exact
cosine. A grid over ``axes`` axes of each block keeps vectors that are far apart in it from meeting: a vector is at home
in one cell and visits the cells within the block's radius. The number of axes follows from the number of vectors; any
number finds all links. With none, the vectors of a label meet once, for all blocks together, in chunks.

Counts need no list of pairs: tasks give sums of links for each vector and edges that span the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import blocks, by_block
from .common import materialise
from .components import components, forest

SLACK = 1e-9


def rotation(dim: int, sample: np.ndarray | None, parts: int) -> tuple[np.ndarray, list[slice], np.ndarray]:
    """Rotation (dim x dim), the blocks' columns and the blocks' shares (sum 1).

    Axes are dealt to blocks by falling variance, so each block leads with a wide one. Without a sample the rotation is
    a fixed random one and shares follow the numbers of axes.
    """
    parts = max(1, min(parts, dim))
    if sample is None or len(sample) < 2:
        axes, _ = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
        variance = np.ones(dim)
    else:
        variance, axes = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim))
        variance, axes = np.maximum(variance[::-1], 1e-6), axes[:, ::-1]
    order = [np.arange(dim)[p::parts] for p in range(parts)]
    ends = np.cumsum([len(o) for o in order])
    share = np.array([variance[o].sum() for o in order])
    return axes[:, np.concatenate(order)], [slice(int(e - len(o)), int(e)) for e, o in zip(ends, order, strict=True)], share / share.sum()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def linked(vectors: DataFrame, cosine: float = 0.98, parts: int = 4, axes: int | None = None, sample_rows: int = 4096, chunk: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Only vectors of one label (not null; labels that are no integers by a 64-bit hash) and one length are compared. Null, zero or empty vectors, and those with a null
    or non-finite component, link with nothing: no links, their own component. Equal vectors of a label (equal 128-bit
    hashes) are one node of the join and link with each other by count. Null ids stay, with a null component unless a
    linked vector has an id. An empty table gives no rows; other columns are ignored. The rotation is fitted on at most
    ``sample_rows`` vectors, and they and the number of vectors decide ``axes`` where it isn't given: both decide the
    work, not the result.
    """
    single = "array<float>" in vectors.select("embedding").dtypes[0][1]
    values = F.col("embedding").cast("array<float>" if single else "array<double>")
    whole = vectors.select("label").dtypes[0][1] in ("tinyint", "smallint", "int", "bigint")
    label = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v"), label.alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)))
    rows = rows.withColumns({f"h{k}": F.when(F.col("ok"), F.xxhash64(F.lit(k), "label", "v")) for k in (1, 2)})
    grouped = rows.where("ok").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("first"))
    nodes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")  # written, so ids stay
    dims = [r.d for r in nodes.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    edges = None
    for dim in dims:  # a table has one length, seldom two
        found = materialise(_join(nodes.where(F.size("v") == dim), dim, cosine, parts, axes, sample_rows, chunk), "links")
        edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    roots = components(edges.where("n is null").select("a", "b"))
    sums = edges.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    known = nodes.select("node", "h1", "h2", "m", "first").join(roots, "node", "left").join(sums, "node", "left")
    known = known.select("h1", "h2", "m", "first", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(least, "root").select("h1", "h2", (F.col("m") - 1 + F.col("n")).alias("n_links"), "component_id")
    out = rows.select("vec_id", "ok", "h1", "h2").join(known, ["h1", "h2"], "left")
    root = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    kept = F.coalesce(F.col("vec_id") == root, F.lit(False))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.when(F.col("ok"), kept).otherwise(True).alias("kept"))


def _cells(y: np.ndarray, cut: slice, axes: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home, and lowest and highest visited cell, on each of the first ``axes`` axes of a block; cells are three radii wide."""
    z = y[:, cut][:, :axes] / (3 * radius)
    return tuple(np.floor(z + s / 3).astype(np.int64) for s in (0, -1, 1))


def best_axes(sample: np.ndarray, cuts: list[slice], radius: np.ndarray, n: int, squares: float, chunk: int) -> int:
    """The number of grid axes with the least work for n rotated vectors, ``squares`` the sum of the labels' squared numbers.

    A filed row costs as much as some 500 comparisons in a block. How often rows meet is taken from the sample's cells.
    """
    filing = 500.0
    best, least = 0, filing * (n + squares / chunk) + len(cuts) * squares / 2
    for axes in range(1, min(6, *(c.stop - c.start for c in cuts)) + 1):
        visits = meets = 0.0
        for cut, r in zip(cuts, radius, strict=True):
            home, low, high = _cells(sample, cut, axes, r)
            visits += float((1 + (high != low)).prod(axis=1).mean())
            inside = np.ones((len(home), len(home)), bool)
            for k in range(axes):
                inside &= (low[:, k][:, None] <= home[:, k]) & (home[:, k] <= high[:, k][:, None])
            meets += float(inside.mean())
        work = filing * (n * visits + squares * meets / chunk) + squares * meets
        if work < least:
            best, least = axes, work
    return best


def _join(nodes: DataFrame, dim: int, cosine: float, parts: int, axes: int | None, sample_rows: int, chunk: int) -> DataFrame:
    """Rows (a, b, null): edges that span components; rows (a, null, n): links of node a, copies counted."""
    got = nodes.select("v").limit(sample_rows).collect()  # decides the work alone
    sample = np.array([r.v for r in got], np.float64)
    sample /= np.abs(sample).max(axis=1, keepdims=True)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    turn, cuts, share = rotation(dim, sample, parts)
    budget = (2 - 2 * cosine) * share
    radius = np.sqrt(budget) + SLACK
    if axes is None:
        per_label = nodes.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"))
        n, squares = per_label.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        axes = best_axes((sample @ turn)[:1024], cuts, radius, n, squares, chunk)
    axes = min(axes, *(c.stop - c.start for c in cuts))
    kind = nodes.select("v").dtypes[0][1]
    names = ["cell", "part", "home", "label", "node", "m", "v"]

    def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled vectors in double precision, their norms, and the rotated unit vectors."""
        v = v / np.abs(v).max(axis=1, keepdims=True)
        norm = np.linalg.norm(v, axis=1)
        return v, norm, (v / norm[:, None]) @ turn

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            label = b.column(0).to_numpy().astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            y = unit(_matrix(b.column(1), dim))[2] if axes else None
            for p, cut in enumerate(cuts if axes else cuts[:1]):
                home, low, high = _cells(y, cut, axes, radius[p]) if axes else (np.zeros((b.num_rows, 0), np.int64),) * 3
                for corner in range(1 << axes):
                    up = (corner >> np.arange(axes)) & 1 == 1
                    at = np.where(up, high, low)
                    take = np.flatnonzero(((high != low) | ~up).all(axis=1))  # an axis reaches two cells at most
                    key = label[take] + np.uint64(p)
                    for k in range(axes):
                        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + at[take, k].view(np.uint64)
                    key ^= key >> np.uint64(29)
                    index = pa.array(take)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(take), p, np.int32)), pa.array((at == home).all(axis=1)[take]), b.column(0).take(index), b.column(3).take(index), b.column(2).take(index), b.column(1).take(index)],
                        names=names,
                    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(c: dict, lo: int, hi: int, total: np.ndarray) -> list[np.ndarray]:
            """Adds the links of the rows lo to hi, one cell or two of its chunks, to ``total``; edges that span them."""
            p, ci, cj = int(c["part"][lo]), int(c["ci"][lo]), int(c["cj"][lo])
            node, m, mine, home = c["node"][lo:hi], c["m"][lo:hi], c["mine"][lo:hi], c["home"][lo:hi].astype(bool)
            v, norm, y = unit(_matrix(c["v"].slice(lo, hi - lo), dim))
            asked = [p] if axes else range(len(cuts))
            z = {q: y[:, cuts[q]].astype(np.float32) for q in asked}
            half = {q: ((x * x).sum(axis=1) / 2)[:, None] for q, x in z.items()}
            left = {q: np.hstack([x, -half[q], np.ones_like(half[q])]) for q, x in z.items()}
            right = {q: np.hstack([x, np.ones_like(half[q]), -half[q]]) for q, x in z.items()}
            spans: list[np.ndarray] = []

            def verify(i: np.ndarray, j: np.ndarray) -> None:
                d = (y[i] - y[j]) ** 2
                within = [d[:, cut].sum(axis=1) <= budget[q] + SLACK for q, cut in enumerate(cuts)]
                # on the grid a pair counts in the first block that it is within; without, it comes once
                ok = within[p] & ~np.any(within[:p], axis=0) if axes and p else within[p] if axes else np.any(within, axis=0)
                ok &= np.einsum("ij,ij->i", v[i], v[j]) / (norm[i] * norm[j]) >= cosine
                i, j = i[ok], j[ok]
                total[lo:hi] += np.bincount(i, weights=m[j], minlength=hi - lo).astype(np.int64)
                if not axes:
                    total[lo:hi] += np.bincount(j, weights=m[i], minlength=hi - lo).astype(np.int64)
                if len(i):
                    was = spans or [node[:0], node[:0]]
                    spans[:] = forest(np.concatenate([was[0], node[i]]), np.concatenate([was[1], node[j]]))

            for own, other in ((ci, cj), (cj, ci))[: 1 if ci == cj or not axes else 2]:
                hs, vs = np.flatnonzero(home & (mine == own)), np.flatnonzero(mine == other)
                for s in range(0, len(hs), 512):
                    h, w = hs[s : s + 512], vs[s:] if ci == cj and not axes else vs
                    near = np.zeros((len(h), len(w)), bool)
                    for q in asked:
                        near |= left[q][h] @ right[q][w].T >= -budget[q] / 2 - 1e-5
                    i, j = np.nonzero(near)
                    i, j = h[i], w[j]
                    apart = i < j if ci == cj and not axes else node[i] != node[j]
                    i, j = i[apart], j[apart]
                    for k in range(0, len(i), 16384):
                        verify(i[k : k + 16384], j[k : k + 16384])
            return spans

        def each(c: dict) -> pa.RecordBatch | None:
            new = np.zeros(len(c["block"]), bool)
            new[0] = True
            for k in ("block", "ci", "cj", "label", "part"):
                new[1:] |= c[k][1:] != c[k][:-1]
            starts = np.flatnonzero(new)
            total = np.zeros(len(new), np.int64)
            spans = [s for lo, hi in zip(starts, np.append(starts[1:], len(new)), strict=True) if hi - lo > 1 and (s := group(c, lo, hi, total))]
            some = np.flatnonzero(total)
            if not len(some):
                return None
            a, b = (np.concatenate(x) for x in zip(*spans, strict=True))
            none = lambda n: pa.nulls(n, pa.int64())
            columns = [pa.array(np.concatenate([c["node"][some], a])), pa.concat_arrays([none(len(some)), pa.array(b)]), pa.concat_arrays([pa.array(total[some]), none(len(a))])]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

        yield from by_block(batches, ["block", "ci", "cj", "label", "part"], each, least=16384)

    filed = nodes.select("label", "v", "m", "node").mapInArrow(file, f"cell long, part int, home boolean, label long, node long, m long, v {kind}")
    dealt = blocks(filed, "cell", "node", chunk).select("block", "ci", "cj", "mine", "label", "part", "home", "node", "m", "v")
    return dealt.repartition("block").sortWithinPartitions("block", "ci", "cj", "label", "part").mapInArrow(join, "a long, b long, n long")
