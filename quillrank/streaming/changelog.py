"""A corpus kept by an ordered log of changes, in batch and as a stream.

A change has ``seq`` (the serial order), ``op`` (add, remove_id, remove_group), ``id``, the item's fields and ``group``.
An add of a live id is dropped; a removal of an unknown id or group changes nothing; a removed id can come back.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.corpus import CORPUS_COLUMNS, fully_embedded, precompute, set_embeddings
from ..operators.ranker import top_matches
from ..plans.diagnostics import EmbeddingUnavailable, Sink, ignore
from ..plans.searcher import TextEmbedding, embed_rows, with_blocks

CHANGE_SCHEMA = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False)] + [T.StructField(n, T.StringType()) for n in ("id", "primary_text", "text", "summary", "group")])


def replay(log: DataFrame) -> DataFrame:
    """Rows of the surviving adds, for logs in which an id never changes its group.

    An id's survivor is its first add after the last removal of the id or of its group: a maximum for each id and group,
    and a minimum for each id, all combined before they are shuffled. Rows without an id are left out.
    """
    adds = log.where("op = 'add' and id is not null")
    own = log.where("op = 'remove_id'").groupBy("id").agg(F.max("seq").alias("_own"))
    swept = log.where("op = 'remove_group' and group is not null").groupBy("group").agg(F.max("seq").alias("_swept"))
    gone = F.greatest("_own", "_swept")
    left = adds.join(own, "id", "left").join(swept, "group", "left").where(gone.isNull() | (F.col("seq") > gone))
    names = [c for c in log.columns if c != "op"]
    return left.groupBy("id").agg(F.min_by(F.struct(*names), "seq").alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in names])


def survivors(keys: DataFrame) -> DataFrame:
    """id, seq of the surviving adds of any log (columns seq, op, id, group), with groups as they were on the live rows.

    Ids that keep their group go the way of ``replay``. For an id whose adds name several groups, which add is live
    depends on all changes before it: those ids are played one by one, in the order of ``seq``, without their texts; one
    change is held at a time.
    """
    keys = keys.select("seq", "op", "id", "group")
    adds = keys.where("op = 'add' and id is not null")
    several = (F.min("group") != F.max("group")) | ((F.count("group") > 0) & (F.count("group") < F.count(F.lit(1))))
    mixed = adds.groupBy("id").agg(several.alias("m")).where("m").select("id")
    same = replay(keys.where("op = 'remove_group'").unionByName(keys.where("op <> 'remove_group'").join(mixed, "id", "left_anti"))).select("id", "seq")
    swept = keys.where("op = 'remove_group'").select("seq", "op", "group")
    of_mixed = keys.where("op <> 'remove_group'").join(mixed, "id", "left_semi")
    reach = swept.join(of_mixed.where("op = 'add'").select("id", "group").distinct(), "group").select("seq", "op", "id", "group")

    def play(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now = live = group = None
        for batch in batches:
            done: list[tuple] = []
            for i, seq, op, g in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if i != now:
                    if live is not None:
                        done.append((now, live))
                    now, live = i, None
                if op == "add":
                    if live is None:
                        live, group = seq, g
                elif op == "remove_id" or (live is not None and group == g):
                    live = None
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["id", "seq"])
        if live is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([live], pa.int64())], names=["id", "seq"])

    ordered = of_mixed.unionByName(reach).select("id", "seq", "op", "group").repartition("id").sortWithinPartitions("id", "seq")
    return same.unionByName(ordered.mapInArrow(play, "id string, seq long"))


def replay_serial(log: DataFrame) -> DataFrame:
    """Rows of the surviving adds of any log; see ``survivors``."""
    return log.where("op = 'add'").join(survivors(log), ["id", "seq"], "left_semi").drop("op")


class CorruptCorpus(RuntimeError):
    """A folder holds parts of a corpus but no version that can be read."""


class StreamingCorpus:
    """A corpus in versions under ``path``: each batch of changes commits the next one; a search reads one version.

    A version is a list of segments. A segment holds the rows that a batch added and the positions that it took from the
    segments before it, so a batch writes what it changes and no more; from ``most_segments`` on, a batch writes all live
    rows as one segment. A version is committed by the creation of a small numbered file, which fails if another writer
    has made it; the highest number that can be read is the current version, so a writer that dies leaves the version
    before. ``path`` may be any folder that Spark can reach. Weights are the defaults. Embeddings are written back under
    the guard that the live text is still the embedded one; an embedder's failure leaves nulls and does not fail the batch.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: TextEmbedding | None = None, sink: Sink = ignore, most_segments: int = 16):
        self.spark, self.path, self.embedder, self.sink, self.most_segments = spark, path.rstrip("/"), embedder, sink, most_segments
        names = self._names()
        if names and self._pointer() is None:
            raise CorruptCorpus(f"{self.path} holds {len(names)} files but no readable version")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self) -> list[str]:
        fs, at = self._fs(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, name: str) -> dict | None:
        """A version's file; None if it was not written whole."""
        fs, at = self._fs(f"{self.path}/{name}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _pointer(self, version: str | None = None) -> dict | None:
        """The file of a version, or of the current one."""
        for name in reversed([n for n in self._names() if n.startswith("version-")]):
            if version in (None, name):
                found = self._read(name)
                if found is not None:
                    return found | {"version": name}
        return None

    def version(self) -> str | None:
        """The name of the current version; None before the first batch."""
        found = self._pointer()
        return found and found["version"]

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, segments: list, batch: int | None) -> str:
        names = [n for n in self._names() if n.startswith("version-")]
        number = int(names[-1].removeprefix("version-").removesuffix(".json")) + 1 if names else 1
        name = f"version-{number:012d}.json"
        fs, at = self._fs(f"{self.path}/{name}")
        out = fs.create(at, False)  # fails if it is there
        out.write(json.dumps({"segments": segments, "batch": batch}).encode())
        out.close()
        return name

    def snapshot(self, version: str | None = None) -> DataFrame:
        """The rows of a version (default: the current one); later changes don't show in it."""
        found = self._pointer(version)
        if version is not None and found is None:
            raise ValueError(f"no version {version}")
        return self._rows(found["segments"] if found else [])

    def _rows(self, segments: list) -> DataFrame:
        rows = gone = None
        for k, (added, taken) in enumerate(segments):
            if added:
                part = self.spark.read.parquet(f"{self.path}/{added}").withColumn("_segment", F.lit(k))
                rows = part if rows is None else rows.unionByName(part)
            if taken:
                part = self.spark.read.parquet(f"{self.path}/{taken}").select("pos", F.lit(k).alias("_upto"))
                gone = part if gone is None else gone.unionByName(part)
        if rows is None:
            empty = self.spark.createDataFrame([], CHANGE_SCHEMA).drop("op").withColumnRenamed("seq", "pos").withColumn("embedding", F.lit(None).cast("array<float>"))
            return precompute(empty).select(*CORPUS_COLUMNS)
        if gone is not None:
            last = gone.groupBy("pos").agg(F.max("_upto").alias("_upto"))
            rows = rows.join(last, "pos", "left").where(F.col("_upto").isNull() | (F.col("_segment") >= F.col("_upto")))
        return rows.select(*CORPUS_COLUMNS)

    def _advance(self, added: DataFrame | None, gone: DataFrame | None, batch: int | None) -> None:
        """Commit one more segment, or, of many, all live rows as one."""
        segments = (self._pointer() or {"segments": []})["segments"]
        segment = [added is not None and self._write(added.select(*CORPUS_COLUMNS), "rows"), gone is not None and self._write(gone.select("pos"), "gone")]
        segments = [*segments, segment]
        if len(segments) > self.most_segments:
            segments = [[self._write(self._rows(segments), "rows"), False]]
        self._commit(segments, batch)

    def apply(self, changes: DataFrame, batch: int | None = None) -> bool:
        """Apply changes in the order of ``seq`` and commit the next version; False for the batch that was applied last.

        Of the live rows only positions, ids and groups are read; only new rows are tokenized and written. ``seq`` must
        exceed those of earlier batches.
        """
        pointer = self._pointer()
        if batch is not None and pointer and pointer["batch"] == batch:
            return False
        changes = changes.select("seq", "op", "id", F.coalesce("primary_text", "id").alias("primary_text"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("summary", "text", F.lit("")).alias("summary"), "group").persist()
        live = self.snapshot().select(F.col("pos").alias("seq"), F.lit("add").alias("op"), "id", "group")
        touched = changes.where("op <> 'remove_group' and id is not null").select("id").distinct()
        mine = live.join(touched, "id", "left_semi").select(*live.columns)
        left = survivors(mine.unionByName(changes.select(*live.columns))).persist()
        swept = changes.where("op = 'remove_group' and group is not null").select("group").distinct()
        other = live.join(touched, "id", "left_anti").join(swept, "group", "left_semi").select(F.col("seq").alias("pos"))
        gone = mine.join(left, ["id", "seq"], "left_anti").select(F.col("seq").alias("pos")).unionByName(other)
        fresh = changes.where("op = 'add'").join(left, ["id", "seq"], "left_semi").drop("op").withColumnRenamed("seq", "pos")
        added = precompute(fresh.withColumn("embedding", F.lit(None).cast("array<float>")))
        if self.embedder is not None:
            added = set_embeddings(added, embed_rows(fresh.select("id", "text"), self.embedder, tolerant=True))
        self._advance(added, gone, batch)
        left.unpersist()
        changes.unpersist()
        return True

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Apply a stream of changes batch by batch; returns the running query. ``trigger`` defaults to what is there now."""
        writer = stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def set_embeddings(self, found: DataFrame) -> None:
        """A late write-back (id, embedding, expected_text): rows whose text changed meanwhile keep what they have.

        Only the rows that change are written.
        """
        live = self.snapshot()
        same = found.select("id", F.col("expected_text").alias("text")).where("id is not null").distinct()
        old = live.join(same, ["id", "text"], "left_semi").select(*CORPUS_COLUMNS)
        self._advance(set_embeddings(old, found), old, (self._pointer() or {}).get("batch"))

    def vacuum(self, keep: int = 2) -> int:
        """Delete the files that none of the last ``keep`` versions reads, older versions included; how many."""
        names = self._names()
        kept = [n for n in names if n.startswith("version-") and self._read(n) is not None][-max(1, keep) :]
        used = {*kept, *(part for n in kept for segment in self._read(n)["segments"] for part in segment if part)}
        old = [n for n in names if n not in used and n.startswith(("version-", "rows-", "gone-")) and not (n.startswith("version-") and kept and n > kept[-1])]
        for n in sorted(old, reverse=True):  # versions before what they read
            fs, at = self._fs(f"{self.path}/{n}")
            fs.delete(at, True)
        return len(old)

    def count(self) -> int:
        return self.snapshot().count()

    def is_empty(self) -> bool:
        return self.snapshot().isEmpty()

    def search(self, query: str, limit: int = 20, version: str | None = None, digits: int | None = None) -> DataFrame:
        """The best rows of one version. The cosine counts only if every live row has an embedding."""
        corpus = self.snapshot(version)
        if limit <= 0 or corpus.isEmpty():
            return with_blocks(corpus, top_matches(corpus, query, 0))
        vector = None
        if self.embedder is not None and fully_embedded(corpus):
            try:
                vector = list(self.embedder.embed([query])[0])
            except Exception:
                vector = None
        if not vector:
            self.sink(EmbeddingUnavailable())
        return with_blocks(corpus, top_matches(corpus, query, limit, vector, digits=digits))


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Changes as JSON lines in files that arrive in a folder."""
    return spark.readStream.schema(CHANGE_SCHEMA).json(os.path.join(folder, "*.json"))
