"""The best rows for many queries at a time, without a row for each pair of a query and a text."""

from __future__ import annotations

from collections import defaultdict
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.storagelevel import StorageLevel

from ..functions.batch import BASE, chunks, features, gram_number, prepared
from ..functions.similarity import B, K1
from ..functions.similarity import BODY_WEIGHT, PRIMARY_WEIGHT
from ..functions.text import canonical_trigrams, tokenize
from .corpus import first_by_id
from .ranking import K, SignalWeights

#: Queries that are scored in one pass, and rows that are scored at a time.
BLOCK, ROWS = 512, 256
_NAMES = ("bm25", "trigram")


def list_depth(limit: int, weights: list[float], digits: int | None) -> int | None:
    """How far down either list a row can stand and still come among the best ``limit``; null if rounding allows any place.

    The first ``limit`` rows of the heavier full list score w / (K + limit - 1) at least; a row below the depth in both lists
    scores less than that by more than rounding moves it.
    """
    blur = sum(weights) / K * 10.0**-digits if digits is not None else 0.0
    depth = limit
    for top, low in [(sum(weights), max(weights)), *((w, w) for w in weights)]:
        room = low / (K + limit - 1) - blur
        if room <= 0:
            return None
        depth = max(depth, ceil(top / room - K) + 1)
    return depth


def _vocabulary(found: list[list[str]]) -> dict[str, int]:
    return {t: i for i, t in enumerate(sorted({t for each in found for t in each}))}


def _encoded(rows: DataFrame, terms: dict[str, int], grams: dict[str, int]) -> DataFrame:
    """Each row as the numbers of its terms and trigrams that any query has, with lengths and sizes."""

    def run(batches):
        of_number = np.full(BASE**3, -1, np.int32)
        for g, i in grams.items():
            if (n := gram_number(g)) >= 0:
                of_number[n] = i

        def shared(g) -> bytes:
            at = of_number[g] if isinstance(g, np.ndarray) else np.array([grams.get(x, -1) for x in g], np.int32)
            return np.sort(at[at >= 0]).tobytes()

        for whole in batches:
            for batch in chunks(whole):
                made = defaultdict(list)
                for p, b in zip(*features(batch), strict=True):
                    tf = {}
                    for field, w in ((p, PRIMARY_WEIGHT), (b, BODY_WEIGHT)):
                        for t in field.tokens or ():
                            if (i := terms.get(t)) is not None:
                                tf[i] = tf.get(i, 0.0) + w
                    ids = sorted(tf)
                    made["doc_len"].append(len(p.tokens or ()) + len(b.tokens or ()))
                    made["sizes"].append(np.array([len(p.grams), len(b.grams)], np.int32).tobytes())
                    made["terms"].append(np.array(ids, np.int32).tobytes())
                    made["tf"].append(np.array([tf[i] for i in ids], np.float64).tobytes())
                    made["primary"].append(shared(p.grams))
                    made["body"].append(shared(b.grams))
                yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("id"), *[pa.array(v, pa.int32() if k == "doc_len" else pa.binary()) for k, v in made.items()]], ["pos", "id", *made])

    return prepared(rows, "pos", "id").mapInArrow(run, "pos long, id string, doc_len int, sizes binary, terms binary, tf binary, primary binary, body binary")


def _frequencies(encoded: DataFrame, n_terms: int) -> np.ndarray:
    def run(batches):
        n = np.zeros(n_terms, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
            n += np.bincount(found, minlength=n_terms)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["term", "n"])

    df = np.zeros(n_terms)
    for term, n in encoded.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        df[term] = n
    return df


class _Scorer:
    """Both signals of rows for a block of queries, given as numbers of terms and trigrams."""

    def __init__(self, terms: list[list[int]], grams: list[list[int]], idf: np.ndarray, n_grams: int, average: float, digits: int | None):
        self.n, self.average, self.digits, self.seen = len(terms), average, digits, {}
        self.idf, self.n_grams = idf, np.array([len(g) for g in grams])
        self.term_at, self.has_term = self._matrix(terms, len(idf), np.float64)
        self.gram_at, self.has_gram = self._matrix(grams, n_grams, np.float32)

    @staticmethod
    def _matrix(lists: list[list[int]], n: int, kind) -> tuple[np.ndarray, np.ndarray]:
        """Places of the numbers that the block has, and a 1 for each that a query has."""
        place = np.full(n, -1, np.int32)
        known = sorted({i for each in lists for i in each})
        place[known] = np.arange(len(known))
        has = np.zeros((len(known), len(lists)), kind)
        for q, each in enumerate(lists):
            has[place[each], q] = 1
        return place, has

    def _round(self, x: np.ndarray) -> np.ndarray:
        return x if self.digits is None else np.floor(x * 10.0**self.digits + 0.5) / 10.0**self.digits

    def _both(self, sets: list[bytes]) -> np.ndarray:
        held = np.zeros((len(sets), len(self.has_gram)), np.float32)
        for i, each in enumerate(sets):
            at = self.gram_at[np.frombuffer(each, np.int32)]
            held[i, at[at >= 0]] = 1
        return held @ self.has_gram

    def _dice(self, both: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(both > 0, 2.0 * both / np.maximum(size[:, None] + self.n_grams, 1), 0.0)

    def batches(self, batches):
        """pos, bm25 and trigram of some rows at a time; one line for a row, one column for a query."""
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                col = {c: b.column(c).to_pylist() for c in ("terms", "tf", "primary", "body", "doc_len", "sizes")}
                bm25 = np.zeros((b.num_rows, self.n))
                for i, (ids, tf, length) in enumerate(zip(col["terms"], col["tf"], col["doc_len"], strict=True)):
                    ids, tf = np.frombuffer(ids, np.int32), np.frombuffer(tf)
                    at = self.term_at[ids]
                    mine = at >= 0
                    if mine.any():
                        tf = tf[mine]
                        part = self.idf[ids[mine]] * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / self.average))
                        bm25[i] = part @ self.has_term[at[mine]]
                sizes = np.frombuffer(b"".join(col["sizes"]), np.int32).reshape(-1, 2)
                new = [s for s in {*col["primary"]} if s not in self.seen]
                if new:
                    if len(self.seen) > 4096:
                        self.seen, new = {}, [*{*col["primary"]}]
                    self.seen.update(zip(new, self._both(new), strict=True))
                primary = self._dice(np.stack([self.seen[s] for s in col["primary"]]).astype(np.float64), sizes[:, 0])
                body = self._dice(self._both(col["body"]).astype(np.float64), sizes[:, 1])
                yield np.asarray(b.column("pos")), (self._round(bm25), self._round(PRIMARY_WEIGHT * primary + BODY_WEIGHT * body))


def _heads(scorer, depth: int):
    """The first ``depth`` rows of each list within a task."""

    def run(batches):
        score = scorer()
        held = [[np.zeros((0, 4)), np.zeros(0, np.int64)] for _ in _NAMES]  # query, value, both signals; pos
        least = np.zeros((2, score.n))

        def cut(s: int) -> None:
            rows, pos = held[s]
            order = np.lexsort((pos, -rows[:, 1], rows[:, 0]))
            rows, pos = rows[order], pos[order]
            q = rows[:, 0].astype(np.int64)
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == depth - 1
            least[s, q[last]] = rows[last, 1]
            held[s] = [rows[place < depth], pos[place < depth]]

        for pos, values in score.batches(batches):
            for s in range(2):
                row, q = np.nonzero((values[s] > 0) & (values[s] >= least[s]))
                held[s][0] = np.concatenate([held[s][0], np.stack([q, values[s][row, q], values[0][row, q], values[1][row, q]], 1)])
                held[s][1] = np.concatenate([held[s][1], pos[row]])
                if len(held[s][1]) > max(2 * depth * score.n, ROWS * score.n):
                    cut(s)
        for s in range(2):
            cut(s)
            rows, pos = held[s]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), s, np.int32)), pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(pos)], ["s", "q", "value", "bm25", "trigram", "pos"])

    return run


def _places(scorer, wanted: dict):
    """For each list and each of its wanted rows (sorted by value and position) how many rows come just before it."""

    def run(batches):
        score = scorer()
        n = {k: np.zeros(len(v) + 1, np.int64) for k, (v, _) in wanted.items()}
        for pos, values in score.batches(batches):
            for (s, q), (v, p) in wanted.items():
                x = values[s][:, q]
                at = np.searchsorted(v, -x, "left")
                end = np.searchsorted(v, -x, "right")
                for i in np.flatnonzero(at < end):
                    at[i] += np.searchsorted(p[at[i] : end[i]], pos[i], "right")
                n[s, q] += np.bincount(at, minlength=len(v) + 1)
        out = [(s, q, i, m) for (s, q), each in n.items() for i, m in enumerate(each[:-1].tolist()) if m]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["s", "q", "i", "n"])

    return run


def batch_search(items: DataFrame, queries: DataFrame, limit: int = 20, weights: SignalWeights = SignalWeights(), digits: int | None = 9) -> DataFrame:
    """What ``multi_query`` gives, exactly, for items and a table of queries (query_id, query) that the driver can hold.

    All pairs are scored, in matrices on the executors, but none is kept: a first pass takes the heads of both lists as far
    down as a result can stand (see ``list_depth``), a second one counts the place of each such row in the other list.
    """
    spark = items.sparkSession
    asked = queries.select("query_id", F.array_distinct(tokenize(F.col("query"))).alias("t"), canonical_trigrams(F.col("query")).alias("g")).collect()
    terms, grams = _vocabulary([r.t or [] for r in asked]), _vocabulary([r.g or [] for r in asked])
    used = [s for s, name in enumerate(_NAMES) if weights.of(name) > 0]
    of = {s: weights.of(_NAMES[s]) for s in used}
    out = []
    encoded = _encoded(first_by_id(items.select("pos", "id", "primary_text", "text")), terms, grams).persist(StorageLevel.MEMORY_AND_DISK)
    if limit > 0 and used:
        n, average = encoded.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
        df = _frequencies(encoded, len(terms))
        idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
        depth = min(list_depth(limit, list(of.values()), digits) or n, max(n, 1))
        for start in range(0, len(asked), BLOCK):
            block = asked[start : start + BLOCK]
            found = _block(encoded, [[terms[t] for t in r.t or ()] for r in block], [[grams[g] for g in r.g or ()] for r in block], idf, len(grams), average or 1.0, depth, limit, of, digits)
            out += [(block[q].query_id, *rest) for q, *rest in found]
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *[T.StructField(c, t()) for c, t in (("rank", T.IntegerType), ("pos", T.LongType), ("score", T.DoubleType), ("bm25", T.DoubleType), ("trigram", T.DoubleType))]])
    best = spark.createDataFrame(out, schema)
    return encoded.select("pos", "id").join(F.broadcast(best), "pos").select("query_id", "rank", "pos", "id", "score", "bm25", "trigram")


def _block(encoded: DataFrame, terms, grams, idf, n_grams, average, depth, limit, of, digits) -> list[tuple]:
    def scorer():
        return _Scorer(terms, grams, idf, n_grams, average, digits)

    order = Window.partitionBy("s", "q").orderBy(F.col("value").desc(), "pos")
    heads = encoded.mapInArrow(_heads(scorer, depth), "s int, q int, value double, bm25 double, trigram double, pos long").withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < depth)
    rows, place, present = defaultdict(dict), {}, set()
    for r in heads.collect():
        if r.s in of:
            rows[r.q][r.pos] = (r.bm25, r.trigram)
            place[r.s, r.q, r.pos] = r.place
            present.add((r.s, r.q))
    wanted, at = {}, {}
    for q, mine in rows.items():
        for s in of:
            rest = sorted((-v[s], p) for p, v in mine.items() if v[s] > 0 and (s, q, p) not in place)
            if rest:
                wanted[s, q] = (np.array([v for v, _ in rest]), np.array([p for _, p in rest], np.int64))
                at[s, q] = [p for _, p in rest]
    if wanted:
        counts = {k: np.zeros(len(v), np.int64) for k, v in at.items()}
        for s, q, i, n in encoded.mapInArrow(_places(scorer, wanted), "s int, q int, i int, n long").groupBy("s", "q", "i").agg(F.sum("n")).collect():
            counts[s, q][i] = n
        for (s, q), each in counts.items():
            place.update({(s, q, p): int(k) for p, k in zip(at[s, q], np.cumsum(each), strict=True)})
    out = []
    for q, mine in rows.items():
        top = 0.0 + sum(w / K for s, w in of.items() if (s, q) in present)
        scored = []
        for p, v in mine.items():
            score = sum((w / (float(K) + place[s, q, p]) for s, w in of.items() if (s, q, p) in place), 0.0) / top
            scored.append((-(score if digits is None else floor(score * 10.0**digits + 0.5) / 10.0**digits), p, v))
        out += [(q, k, p, -score, *map(float, v)) for k, (score, p, v) in enumerate(sorted(scored)[:limit])]
    return out
