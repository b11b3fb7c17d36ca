"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is an embedding of the word beside the mean embedding of its character 3- to 5-grams (both hashed), so
that inflections that training never saw are near those it saw. A forward and a backward GRU read a window of words;
attention weighs their states; a logistic unit scores the window. All windows of ``WIDTH`` words at every ``STRIDE``
words are scored, over the whole text. A document's label says only that some of its windows are toxic, so training
takes, in each document, the windows that the network (at first: word counts) finds most toxic, and fits them to the
label. A logistic unit over the sorted window scores then gives the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, is_held_out, materialise, slices
from .samples import labelled

WIDTH, STRIDE = 32, 16
BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 1 << 14, 6, 14, 8, 8
CACHE = 150_000
#: Longer runs of letters are cut into pieces of this length that share ``SHARED`` letters, so that no 5-gram is lost.
LONGEST, SHARED = 64, 4
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """The words of a text; a run beyond ``LONGEST`` letters is cut at underscores, and what is still longer into pieces."""
    words = _TOKEN.findall((text or "").lower())
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [piece for w in words for piece in ([w] if len(w) <= LONGEST else _pieces(w))]


def _pieces(run: str) -> list[str]:
    parts = [x for x in run.split("_") if x] or [run]
    return [x[k : k + LONGEST] for x in parts for k in range(0, max(1, len(x) - SHARED), LONGEST - SHARED)]


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def char_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- to 5-grams of each word between marks, word after word, and how many each has (at least one)."""
    marked = "".join([f"<{w}>" for w in words])
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.repeat(np.cumsum(size), size)
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(code))
    found, owner = [], []
    for n in (3, 4, 5):
        h = np.full(max(0, len(code) - n + 1), n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ (code[k : k + len(h)] * np.uint64(0x9E3779B97F4A7C15))
        inside = at[: len(h)] + n <= end[: len(h)]
        found.append(((h[inside] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owner.append(word[: len(h)][inside])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.bincount(owner, minlength=len(words))


def window_starts(n: int) -> list[int]:
    """Starts of the windows that cover n words, overlapping by half; the last one ends with the text."""
    return list(range(0, max(1, n - WIDTH + STRIDE), STRIDE)) if n else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum_rows(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``index``, ascending, and the sums of their ``rows``."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[starts], np.add.reduceat(rows[order], starts, axis=0)


def _gru(xs: np.ndarray, u: np.ndarray, keep: bool):
    """States over time (T, N, H) for projected inputs (T, N, 3H: update, reset, candidate)."""
    t_n, n, h3 = xs.shape
    hd = h3 // 3
    h = np.zeros((n, hd), xs.dtype)
    states, trace = np.empty((t_n, n, hd), xs.dtype), []
    for t in range(t_n):
        zr = _sigmoid(xs[t, :, : 2 * hd] + h @ u[:, : 2 * hd])
        z, r = zr[:, :hd], zr[:, hd:]
        rh = r * h
        c = np.tanh(xs[t, :, 2 * hd :] + rh @ u[:, 2 * hd :])
        if keep:
            trace.append((h, z, r, rh, c))
        h = h + z * (c - h)
        states[t] = h
    return states, trace


def _gru_back(d_states: np.ndarray, trace: list, u: np.ndarray):
    """Gradients of the projected inputs and of ``u``."""
    t_n, n, hd = d_states.shape
    dx, du, dh = np.zeros((t_n, n, 3 * hd), d_states.dtype), np.zeros_like(u), np.zeros((n, hd), d_states.dtype)
    for t in range(t_n - 1, -1, -1):
        h, z, r, rh, c = trace[t]
        dh = dh + d_states[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)
        drh = dc @ u[:, 2 * hd :].T
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=1)
        dx[t, :, : 2 * hd], dx[t, :, 2 * hd :] = dzr, dc
        du[:, : 2 * hd] += h.T @ dzr
        du[:, 2 * hd :] += rh.T @ dc
        dh = dh * (1 - z) + drh * r + dzr @ u[:, : 2 * hd].T
    return dx, du


@dataclass
class ToxicModel:
    """Dense weights by name, the two embedding tables, and the document unit (weights and bias)."""

    p: dict[str, np.ndarray]
    words: np.ndarray
    chars: np.ndarray
    doc_w: np.ndarray
    doc_b: float

    def inputs(self, vocabulary: list[str]) -> np.ndarray:
        """Input vector of each word; row 0 is the padding, all 0."""
        out = np.zeros((len(vocabulary) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if vocabulary:
            grams, size = char_buckets(vocabulary)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            out[1:, WORD_DIM:] = np.add.reduceat(self.chars[grams], starts, axis=0) / np.sqrt(size)[:, None]
            out[1:, :WORD_DIM] = self.words[[word_bucket(w) for w in vocabulary]]
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """Both directions' input projections (n, 6H)."""
        return np.concatenate([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]], axis=1)

    def forward(self, xs: np.ndarray, there: np.ndarray, keep: bool = False):
        """Logits of windows from projections (T, N, 6H) and the mask of real words (T, N)."""
        p, h3 = self.p, 3 * HIDDEN
        hf, tf = _gru(xs[:, :, :h3], p["uf"], keep)
        hb, tb = _gru(xs[::-1, :, h3:], p["ub"], keep)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        a = np.tanh(h @ p["wa"] + p["ba"])
        e = np.where(there, a @ p["va"], -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, h)
        logit = pooled @ p["o"] + p["bo"][0]
        return (logit, (h, a, alpha, pooled, tf, tb)) if keep else logit

    def backward(self, d_logit: np.ndarray, saved) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense weights but the projections', and of the projections."""
        p, (h, a, alpha, pooled, tf, tb) = self.p, saved
        g = {"o": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["o"]
        d_alpha = np.einsum("nh,tnh->tn", d_pooled, h)
        d_h = alpha[:, :, None] * d_pooled
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", d_e, a)
        d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
        g["wa"] = np.einsum("tnh,tna->ha", h, d_a)
        g["ba"] = d_a.sum(axis=(0, 1))
        d_h = d_h + d_a @ p["wa"].T
        dxf, g["uf"] = _gru_back(d_h[:, :, :HIDDEN], tf, p["uf"])
        dxb, g["ub"] = _gru_back(d_h[::-1, :, HIDDEN:], tb, p["ub"])
        return g, np.concatenate([dxf, dxb[::-1]], axis=2)

    def score(self, windows: np.ndarray) -> float:
        """The document's score from its windows' logits."""
        return float(_sigmoid(np.array(_doc_features(windows) @ self.doc_w + self.doc_b)))


def _doc_features(logits: np.ndarray) -> np.ndarray:
    """Largest, second and fourth largest window logit, and the log of the summed window probabilities; without windows as if all were -6."""
    top = np.sort(np.concatenate([np.clip(logits, -6, 6), np.full(4, -6.0)]))[::-1]
    return np.array([top[0], top[1], top[3], log(0.01 + float(_sigmoid(logits).sum()))])


def initial(seed: int = 1) -> ToxicModel:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"wf": draw(d, 3 * h), "uf": draw(h, 3 * h), "bf": np.zeros(3 * h, np.float32), "wb": draw(d, 3 * h), "ub": draw(h, 3 * h), "bb": np.zeros(3 * h, np.float32)}
    p |= {"wa": draw(2 * h, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": draw(ATTEND), "o": draw(2 * h), "bo": np.zeros(1, np.float32)}
    return ToxicModel(p, (0.1 * rng.standard_normal((BUCKETS, WORD_DIM))).astype(np.float32), (0.1 * rng.standard_normal((BUCKETS, CHAR_DIM))).astype(np.float32), np.array([1.0, 0, 0, 0]), 0.0)


def window_texts(text: str | None, most: int, seed: int = 1) -> list[str]:
    """The windows of a text, words joined by spaces; of more than ``most``, so many drawn at random from the whole text."""
    words = tokens(text)
    starts = window_starts(len(words))
    if len(starts) > most:
        drawn = np.random.default_rng([seed, zlib.crc32((text or "").encode()), len(starts)]).choice(len(starts), most, replace=False)
        starts = [starts[k] for k in np.sort(drawn)]
    return [" ".join(words[s : s + WIDTH]) for s in starts]


def _first_evidence(docs: list[set[str]], y: np.ndarray) -> dict[str, float]:
    """Shrunken log odds of the words, from which windows are chosen at first."""
    with_, without = Counter(), Counter()
    for d, label in zip(docs, y, strict=True):
        (with_ if label else without).update(d)
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    return {w: log((k + 0.2) / n1 / ((without[w] + 0.2) / n0)) if k + without[w] > 2 else 0.0 for w, k in with_.items()}


def fit(texts: list[str], labels: list[int], steps: int = 250, batch: int = 48, seed: int = 1) -> ToxicModel:
    """Train on the windows of whole texts in the given order; the same texts and seed give the same model.

    With one class only (or no rows) the network stays as it began and every document gets a score of 0.1 or 0.9.
    """
    features = lambda m: np.array([_doc_features(s) for s in Scorer(m).windows(texts)])
    return fit_windows([window_texts(t, 1 << 62) for t in texts], labels, features, steps, batch, seed)


#: Windows of a document that one step looks at; each step draws them anew.
LOOK = 24


def fit_windows(windows: list[list[str]], labels: list[int], features: Callable[[ToxicModel], np.ndarray], steps: int = 250, batch: int = 48, seed: int = 1) -> ToxicModel:
    """Train the network on windows of documents, and the document unit on ``features(model)``, a row for each document."""
    model, rng = initial(seed), np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        model.doc_w, model.doc_b = np.zeros(4), log(9) if len(y) and y[0] == 1 else -log(9)
        return model
    vocabulary: dict[str, int] = {}
    ids = []
    for doc in windows:
        rows = np.zeros((len(doc), WIDTH), np.int32)
        for row, text in zip(rows, doc, strict=True):
            found = text.split(" ")
            row[: len(found)] = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]
        ids.append(rows)
    names = list(vocabulary)
    evidence = _first_evidence([{names[k - 1] for k in np.unique(d) if k} for d in ids], y)
    wid = np.array([0] + [word_bucket(w) for w in names])
    grams, n_grams = char_buckets(names)
    n_grams = np.concatenate([[0], n_grams])
    first_gram = np.concatenate([[0], np.cumsum(n_grams)[:-1]])
    gain = np.array([0.0] + [max(0.0, evidence.get(w, 0.0)) for w in names])
    pools = [np.flatnonzero((y == k) & np.array([len(d) > 0 for d in ids])) for k in (0, 1)]
    if not len(pools[0]) or not len(pools[1]):
        model.doc_w, model.doc_b = np.zeros(4), 0.0
        return model
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    ada_w, ada_c = np.full(BUCKETS, 1e-4, np.float32), np.full(BUCKETS, 1e-4, np.float32)
    p = model.p

    def look(i: int) -> np.ndarray:
        """Windows of a document for one step, drawn from all it has; of a toxic one half by the words' evidence."""
        d = ids[i]
        if len(d) <= LOOK:
            return d
        likely = np.argsort(-gain[d].sum(axis=1), kind="stable")[: LOOK // 2 if y[i] else 0]
        rest = np.setdiff1d(np.arange(len(d)), likely)
        return d[np.sort(np.concatenate([likely, rng.choice(rest, LOOK - len(likely), replace=False)]))]

    def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gram buckets of words by number, word after word, and the starts of each word's."""
        n = n_grams[words]
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        return grams[np.repeat(first_gram[words] - starts, n) + np.arange(n.sum())], starts

    def embed(rows: np.ndarray):
        """The words of ``rows`` (ascending), where each stands among them, and their inputs."""
        used, at = np.unique(rows, return_inverse=True)
        x, real = np.zeros((len(used), WORD_DIM + CHAR_DIM), np.float32), np.flatnonzero(used)
        flat, starts = grams_of(used[real])
        x[real, :WORD_DIM] = model.words[wid[used[real]]]
        x[real, WORD_DIM:] = np.add.reduceat(model.chars[flat], starts, axis=0) / np.sqrt(n_grams[used[real]])[:, None]
        return used, at.reshape(rows.shape), x

    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(pool, batch // 2) for pool in pools])
        label, cuts = y[chosen], [look(i) for i in chosen]
        if step <= steps // 4:
            strength = [gain[c].sum(axis=1) for c in cuts]
        else:
            rows = np.concatenate(cuts)
            _, at, x = embed(rows)
            logit = model.forward(model.project(x)[at].transpose(1, 0, 2), (rows > 0).T)
            strength = np.split(logit, np.cumsum([len(c) for c in cuts])[:-1])
        rows, want = [], []
        for c, s, k in zip(cuts, strength, label, strict=True):
            for j in np.argsort(-s, kind="stable")[: 2 if k else 4]:
                if not k or step > steps // 4 or s[j] > 0:
                    rows.append(c[j])
                    want.append(k)
        rows, want = np.array(rows), np.array(want, np.float32)
        used, at, x = embed(rows)
        xs = model.project(x)
        logit, saved = model.forward(xs[at].transpose(1, 0, 2), (rows > 0).T, True)
        weight = np.where(want == 1, 1 / max(1, want.sum()), 1 / max(1, len(want) - want.sum())).astype(np.float32)
        g, d_xs = model.backward((_sigmoid(logit) - want) * weight / 2, saved)
        _, d_proj = _sum_rows(at.T.ravel(), d_xs.reshape(-1, d_xs.shape[2]))  # every used word has a row
        h3 = 3 * HIDDEN
        g["wf"], g["bf"], g["wb"], g["bb"] = x.T @ d_proj[:, :h3], d_proj[:, :h3].sum(axis=0), x.T @ d_proj[:, h3:], d_proj[:, h3:].sum(axis=0)
        d_x = d_proj[:, :h3] @ p["wf"].T + d_proj[:, h3:] @ p["wb"].T
        for k, v in p.items():
            m, s = adam[k]
            m *= 0.9
            m += 0.1 * g[k]
            s *= 0.99
            s += 0.01 * g[k] * g[k]
            v -= (0.01 * m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        real = used > 0
        n = n_grams[used[real]]
        for table, ada, index, grad in (
            (model.words, ada_w, wid[used[real]], d_x[real, :WORD_DIM]),
            (model.chars, ada_c, grams_of(used[real])[0], np.repeat(d_x[real, WORD_DIM:] / np.sqrt(n)[:, None], n, axis=0)),
        ):
            rows_, total = _sum_rows(index, grad)
            ada[rows_] += (total * total).mean(axis=1)
            table[rows_] -= 0.05 * total / np.sqrt(ada[rows_])[:, None]
    f = features(model)
    w, b = np.array([0.5, 0.2, 0.0, 0.2]), 0.0
    for k in range(600):  # the document unit, classes balanced
        d = (_sigmoid(f @ w + b) - y) * np.where(y == 1, 1 / y.sum(), 1 / (len(y) - y.sum())) / 2
        w, b = w - 0.3 * (f.T @ d + 1e-3 * w), b - 0.3 * d.sum()
    model.doc_w, model.doc_b = w, float(b)
    return model


class Scorer:
    """Scores texts with a model; projections of words are kept in a bounded table."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.at: dict[str, int] = {}
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)
        self.table[0] = model.project(np.zeros((1, WORD_DIM + CHAR_DIM), np.float32))[0]

    def _rows(self, words: list[str]) -> np.ndarray:
        at = self.at
        new = [w for w in dict.fromkeys(words) if w not in at]
        if new:
            if len(at) + len(new) > CACHE:
                at.clear()
                new = list(dict.fromkeys(words))
            first = len(at) + 1
            if first + len(new) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), first + len(new)), self.table.shape[1]), np.float32)
                grown[: len(self.table)] = self.table
                self.table = grown
            for k in range(0, len(new), 8192):
                part = new[k : k + 8192]
                self.table[first + k : first + k + len(part)] = self.model.project(self.model.inputs(part)[1:])
            at.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def windows(self, texts: list[str | None]) -> list[np.ndarray]:
        """The logits of all windows of each text, in order."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str], list[int]]] = []  # text, words, starts of windows among them
        most, size = 1 << 15, 0

        def flush() -> None:
            rows = self._rows([w for _, words, _ in held for w in words])
            padded = np.concatenate([rows, np.zeros(WIDTH, np.int64)])
            at, starts, ends = 0, [], []
            for _, words, first in held:
                starts.append(at + np.array(first, np.int64))
                ends.append(np.full(len(first), at + len(words)))
                at += len(words)
            if not starts:
                return
            index = np.concatenate(starts)[:, None] + np.arange(WIDTH)
            cut = np.where(index < np.concatenate(ends)[:, None], padded[np.minimum(index, len(padded) - 1)], 0)
            for (i, _, _), part in zip(held, np.split(self._logits(cut), np.cumsum([len(f) for _, _, f in held])[:-1]), strict=True):
                out[i].append(part)

        for i, t in enumerate(texts):
            words = tokens(t)
            starts = window_starts(len(words))
            for k in range(0, len(starts), most // STRIDE):  # a very long text comes in parts that overlap by a window
                part = starts[k : k + most // STRIDE]
                piece = words[part[0] : part[-1] + WIDTH]
                held.append((i, piece, [x - part[0] for x in part]))
                size += len(piece)
                if size > most:
                    flush()
                    held, size = [], 0
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.float32) for x in out]

    def _logits(self, cut: np.ndarray) -> np.ndarray:
        out = np.empty(len(cut), np.float32)
        for k in range(0, len(cut), 512):
            part = cut[k : k + 512]
            out[k : k + 512] = self.model.forward(self.table[part.T], (part > 0).T)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.model.score(x) for x in self.windows(texts)])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, per_document: int = 256, steps: int = 250) -> ToxicModel:
    """Fit on at most ``per_class`` labelled documents of each class that are not held out.

    The network's windows are gathered on the driver, at most ``per_document`` of a document, drawn from its whole text;
    the document unit is fitted to the scores of all windows, which executors compute.
    """
    sample = materialise(labelled(docs, labels, "toxic", per_class).select("doc_id", "text", "label"), "labelled")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            windows = [window_texts(t, per_document) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(windows, pa.list_(pa.string()))], names=["doc_id", "label", "windows"])

    got = sorted(sample.mapInArrow(cut, "doc_id long, label int, windows array<string>").collect(), key=lambda r: r.doc_id)

    def features(model: ToxicModel) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(model)
            for b in slices(batches):
                found = [_doc_features(x).tolist() for x in scorer.windows(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "f"])

        return np.array([r.f for r in sorted(sample.mapInArrow(run, "doc_id long, f array<double>").collect(), key=lambda r: r.doc_id)])

    model = fit_windows([r.windows for r in got], [r.label for r in got], features, steps)
    discard(sample)
    return model


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows, worst_window (first word of the most toxic one) for every row.

    All overlapping windows of the whole text are scored. Null texts are empty and have no windows: their score is the
    document unit's for windows of logit -6. Null ids stay; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches):
            windows = scorer.windows(b.column(1).to_pylist())
            s = np.array([model.score(x) for x in windows])
            held = [is_held_out(d) for d in b.column(0).to_pylist()]
            worst = [int(np.argmax(x)) * STRIDE if len(x) else None for x in windows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([len(x) for x in windows], pa.int64()), pa.array(worst, pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_windows", "worst_window"],
            )

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_windows long, worst_window long")
