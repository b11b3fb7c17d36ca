"""Quality scores by Bradley-Terry pairwise ranking.

The chance that document a is preferred to b is modelled as sigmoid(w . (x_a - x_b)), where x are features of the whole
text: shares of characters, words and lines, and hashed frequencies of words and of three-byte grams. w minimises the
logistic loss over all pairs of a document labelled 1 and one labelled 0. The raw score w . x of a text has no natural
zero, so the bar is a quantile of the training scores: the share of label 0 among the labelled rows.

Every labelled document enters the fit and the bar, and none of them comes to the driver: the loss of a row against all of
the other class depends on that class only through the counts of its scores, so each Newton step takes one pass for the
counts and one for the sums of gradient and curvature.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import log, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, is_held_out, materialise, parts, slices

_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_MARKS = np.frombuffer(b"*#%&$~^=+<>@\\/_", np.uint8).astype(int)
_ENDS = np.frombuffer(b".,;:?", np.uint8).astype(int)

#: Names of the features, in order.
FEATURES = (
    "upper", "bang", "pipe", "marks", "digits", "ends", "newlines", "high_bytes", "word_length", "longest", "distinct", "repeat_next", "top_word", "pairs", "lines", "short_lines", "size",
    "marked_words", "upper_words", "line_repeats",
)
#: Buckets of the hashed words, and as many of the hashed grams.
HASHED = 128
WIDTH = len(FEATURES) + 2 * HASHED


def hashed(raw: bytes, seen: Counter) -> np.ndarray:
    """Square roots of the shares of words and of three-byte grams, letter case aside, that fall to each bucket."""
    words = np.zeros(HASHED)
    np.add.at(words, np.fromiter((crc32(w.lower()) % HASHED for w in seen), np.int64, len(seen)), np.fromiter(seen.values(), np.float64, len(seen)))
    code = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    grams = np.zeros(HASHED)
    if len(code) > 2:
        h = (code[:-2] << np.uint32(16) | code[1:-1] << np.uint32(8) | code[2:]) * np.uint32(0x9E3779B1)
        grams = np.bincount((h >> np.uint32(25)).astype(np.uint8), minlength=HASHED) / (len(code) - 2)
    return np.sqrt(np.concatenate([words / max(1, words.sum()), grams]))


def features(text: str | None) -> np.ndarray:
    """``FEATURES`` and the hashed frequencies of a text; all 0 for a text without words."""
    raw = (text or "").encode()
    words = raw.split()
    n, m = len(raw), len(words)
    if not m:
        return np.zeros(WIDTH)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = count[_UPPER].sum(), count[_LOWER].sum()
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    length = [len(w) for w in words]
    top = seen.most_common(1)[0][1]
    shares = np.array([
        upper / max(1, upper + lower), count[33] / m, count[124] / m, count[_MARKS].sum() / m, count[_DIGIT].sum() / n, count[_ENDS].sum() / m, len(lines) / m, count[128:].sum() / n,
        sum(length) / m / 10, log1p(max(length)), log(len(seen)) / log(m + 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, top / (m + 5), (pairs + 1) / m, log1p(len(lines)) / 5,
        sum(len(x) < 30 for x in lines) / len(lines), log1p(m) / 5, sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:?!|" for w in words) / m,
        sum(w.isupper() for w in words) / m, 1 - len(set(lines)) / len(lines),
    ])
    return np.concatenate([shares, hashed(raw, seen)])


def expand(x: np.ndarray) -> np.ndarray:
    """Features, and the square roots of the shares, which tell small ones apart."""
    return np.concatenate([x, np.sqrt(np.abs(x[:, : len(FEATURES)]))], axis=1)


#: Raw scores are multiples of this.
STEP = 2.0**-20


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bar: float  # the raw score that is mapped to ``at``
    at: float = 0.3

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Expanded features in deviations from the mean; in single precision first, as the fit reads them."""
        return ((expand(x.astype(np.float32).astype(float)) - self.mean) / self.scale).clip(-8, 8)

    def steps(self, x: np.ndarray) -> np.ndarray:
        """The raw score in whole steps of ``STEP``, which do not depend on what rows are multiplied at once."""
        return np.rint(self.standard(x) @ self.weight / STEP).astype(np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x) * STEP

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1); ``at`` or more exactly where the raw score reaches the bar."""
        out = 1 / (1 + np.exp(-(self.raw(x) - self.bar + log(self.at / (1 - self.at))).clip(-40, 40)))
        return np.where(self.raw(x) >= self.bar, np.maximum(out, self.at), np.minimum(out, np.nextafter(self.at, 0)))


#: Nodes of the grid on which scores are counted; a score is shared between its two neighbours, so what is read off the
#: grid errs by a square of its spacing (1e-5 of a pair's chance at scores of a few hundred).
NODES = 16385
#: The curvature of pairs is kept on these scores. It shapes the steps; where they end is up to the gradient.
COARSE = np.arange(-32, 33, 0.5)
#: Lengths of a Newton step, of which the best is taken.
LENGTHS = (1.0, 0.5, 0.25, 0.0625)


def total(rows: DataFrame, each: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``each`` (features, labels) over all of ``rows``, added up on the executors; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sum(each(b.column(1).flatten().to_numpy().reshape(-1, WIDTH), b.column(0).to_numpy()) for b in slices(batches, 4096))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sum(np.frombuffer(x.as_py()) for b in batches for x in b.column(0))

    got = rows.select("label", "x").mapInArrow(run, "total binary").repartition(2).mapInArrow(add, "total binary").toArrow()
    found = [np.frombuffer(x.as_py()) for x in got["total"]]
    return np.sum(found, axis=0) if found else None


def _sum(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    out = None
    for x in found:
        out = np.array(x, float) if out is None else np.add(out, x, out=out)
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["total"])


def shared(values: np.ndarray, nodes: np.ndarray, weights: np.ndarray | float = 1.0) -> np.ndarray:
    """Counts of ``values`` on equally spaced nodes, each value shared between its two neighbours; beyond the ends, at the end."""
    at = ((values - nodes[0]) / (nodes[1] - nodes[0])).clip(0, len(nodes) - 1)
    low = np.minimum(at.astype(np.int64), len(nodes) - 2)
    up = at - low
    return np.bincount(low, (1 - up) * weights, len(nodes)) + np.bincount(low + 1, up * weights, len(nodes))


def against(counts: np.ndarray, nodes: np.ndarray, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each node the sum over all counts of ``of`` (the node less the count's node)."""
    n = len(nodes)
    kernel = of(np.arange(1 - n, n) * (nodes[1] - nodes[0]))
    size = 1 << (3 * n).bit_length()
    return np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel, size), size)[n - 1 : 2 * n - 1]


def chance(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-d.clip(-700, 700)))


def fit(rows: DataFrame, at: float = 0.3, rounds: int = 30) -> QualityModel:
    """The least mean logistic loss of all pairs of ``rows`` (label 0 or 1, x the features), and the bar.

    Newton's steps, each of the length with the least loss, until a step promises less than 1e-9. The bar is at the
    quantile of the scores that is the share of label 0. With one class only there are no pairs: all weights are 0, and
    every text is on the side of that class (without any rows: accepted).
    """

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        e = expand(x.astype(float))
        return np.concatenate([[(y == 1).sum(), (y == 0).sum()], e.sum(axis=0), (e * e).sum(axis=0)])

    wide = WIDTH + len(FEATURES)
    got = total(rows, moments)
    good, bad = (int(got[0]), int(got[1])) if got is not None else (0, 0)
    mean, scale = np.zeros(wide), np.ones(wide)
    if good + bad:
        mean = got[2 : 2 + wide] / (good + bad)
        scale = np.sqrt(np.maximum(0, got[2 + wide :] / (good + bad) - mean**2)) + 1e-3
    # rounded, as are the weights: the order in which parts are added leaves no trace
    model = QualityModel(mean.astype(np.float32).astype(float), scale.astype(np.float32).astype(float), np.zeros(wide), 1.0 if bad else -1.0, at)
    if not good or not bad:
        return model
    pull = np.full(wide, 1e-3)
    pull[len(FEATURES) : WIDTH] = 1e-2  # of the many hashed features none may carry much alone
    pairs = float(good) * bad
    nodes = np.linspace(-1, 1, NODES)
    counts = np.stack([shared(np.zeros(1), nodes, n) for n in (bad, good)])
    loss = log(2)
    for _ in range(rounds):
        gradient, curve = slope(rows, model, nodes, counts, pairs)
        gradient += pull * model.weight
        move = -np.linalg.solve(curve + np.diag(pull), gradient)
        if -(gradient @ move) < 1e-9:
            break
        nodes, each = tried(rows, model, move)
        losses = []
        for length, c in zip(LENGTHS, each, strict=True):
            w = model.weight + length * move
            losses.append(float(c[1] @ against(c[0], nodes, lambda d: np.logaddexp(0, -d))) / pairs + float(pull @ (w * w)) / 2)
        best = int(np.argmin(losses))
        if losses[best] >= loss:
            break
        loss, counts = losses[best], each[best]
        model = replace(model, weight=np.rint((model.weight + LENGTHS[best] * move) * 2.0**24) / 2.0**24)
    return replace(model, bar=bar(rows, model, bad))


def slope(rows: DataFrame, model: QualityModel, nodes: np.ndarray, counts: np.ndarray, pairs: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean loss of all pairs, given the ``counts`` (label 0, label 1) of the model's scores."""
    wrong = np.stack([against(counts[1], nodes, chance), -against(counts[0], nodes, lambda d: chance(-d))]) / pairs
    bent = chance(COARSE[:, None] - COARSE)
    bent *= 1 - bent
    held = np.stack([shared(nodes, COARSE, c) for c in counts])
    spread = np.stack([held[1] @ bent, held[0] @ bent]) / pairs
    wide, k = len(model.weight), len(COARSE)

    def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.standard(x)
        s = z @ model.weight
        out = [z.T @ np.where(y == 1, np.interp(s, nodes, wrong[1]), np.interp(s, nodes, wrong[0]))]
        half = z * np.sqrt(np.where(y == 1, np.interp(s, COARSE, spread[1]), np.interp(s, COARSE, spread[0])))[:, None]
        out.append((half.T @ half).ravel())
        place = ((s - COARSE[0]) / (COARSE[1] - COARSE[0])).clip(0, k - 1)
        low = np.minimum(place.astype(np.int64), k - 2)
        row, share = np.arange(len(z)), np.zeros((len(z), k))
        share[row, low], share[row, low + 1] = 1 - (place - low), place - low
        out += [(share[y == v].T @ z[y == v]).ravel() for v in (0, 1)]
        return np.concatenate(out)

    got = total(rows, sums)
    gradient, own, sides = got[:wide], got[wide : wide + wide * wide].reshape(wide, wide), got[wide + wide * wide :].reshape(2, k, wide)
    both = sides[1].T @ bent @ sides[0] / pairs
    return gradient, own - both - both.T


def tried(rows: DataFrame, model: QualityModel, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A grid that holds all scores, and on it the counts (label 0, label 1) of the scores after each of ``LENGTHS``."""
    most = 8 * max(float(np.abs(model.weight + t * move).sum()) for t in LENGTHS) + 1e-3
    nodes = np.linspace(-most, most, NODES)

    def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.standard(x)
        here, there = z @ model.weight, z @ move
        return np.concatenate([shared((here + t * there)[y == v], nodes) for t in LENGTHS for v in (0, 1)])

    return nodes, total(rows, count).reshape(len(LENGTHS), 2, NODES)


def bar(rows: DataFrame, model: QualityModel, low: int) -> float:
    """Half-way between the ``low``-th least raw score of ``rows`` and the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([pa.array(model.steps(b.column(0).flatten().to_numpy().reshape(-1, WIDTH)))], names=["s"])

    found = rows.select("x").mapInArrow(run, "s long")
    count = F.count(F.lit(1)).alias("n")
    head, below = F.shiftright("s", 16), 0
    for h in sorted(found.groupBy(head.alias("h")).agg(count).collect()):
        if below + h.n >= low:
            break
        below += h.n
    for r in sorted(found.where(head == h.h).groupBy("s").agg(count).collect()):
        below += r.n
        if below >= low:
            break
    after = r.s if below > low else found.where(F.col("s") > r.s).agg(F.min("s")).first()[0]
    return (r.s + after) / 2 * STEP


def train(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> QualityModel:
    """Fit on every document with a label that isn't held out, features computed on the executors.

    Null labels and ids are left out; of labels for one id the largest counts, for all rows of that id.
    """
    seen = lambda df: df.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long"))).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = seen(labels.where(F.col("quality").isin(0, 1))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([features(t) for t in b.column(1).to_pylist()], np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "x"])

    # features are joined, not texts: they are smaller, and labels of any number need no broadcast
    marked = seen(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")
    rows = materialise(marked.join(known.hint("merge"), "doc_id").select("label", "x").coalesce(parts(known.count())), "features")
    model = fit(rows, at)
    discard(rows)
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; nothing but the text enters the score.

    Null texts are empty; an empty text has the score of all-zero features; null ids stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.score(np.array([features(t) for t in b.column(1).to_pylist()]))
            held = [is_held_out(d) for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= model.at).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns unchanged, null ids and repeated rows too.

    A null text counts as empty and has the score of all-zero features; an empty table stays empty.
    """
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.score(np.array([features(t) for t in b.column(at).cast(pa.string()).to_pylist()]))
            yield b.filter(pa.array(s >= model.at))

    return docs.mapInArrow(run, schema)
