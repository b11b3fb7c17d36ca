"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word: a maximal run of bytes other than the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What ``materialise`` writes inside is deleted at the end, but for tables that were taken by ``keep``."""
    _open.append([])
    try:
        yield
    finally:
        for df in _open.pop():
            discard(df)


def keep(df: DataFrame) -> DataFrame:
    """Take a table out of the innermost ``scratch`` and leave it to the one around that, if there is one."""
    if _open and any(x is df for x in _open[-1]):
        _open[-1][:] = [x for x in _open[-1] if x is not df]
        if len(_open) > 1:
            _open[-2].append(df)
    return df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    What is read survives the loss of any executor, and no consumer computes it twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path  # for discard()
    if _open:
        _open[-1].append(out)
    return out


#: Written tables have parts of at least so many rows: small tables, and late rounds, are few files.
PART_ROWS = 10_000


def parts(rows: int) -> int:
    """The most parts in which a table of so many rows is written, for ``coalesce``."""
    return 1 + rows // PART_ROWS


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote, when nothing reads it any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever and however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null, as long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_len(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most ``rows`` rows and, beyond one row, about ``most`` bytes."""
    for batch in batches:
        step = max(1, min(rows, int(most * batch.num_rows / max(1, batch.nbytes)))) if batch.num_rows else 1
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels no model may see: crc32 of the id as text, modulo 5, is 0 (null id: crc32 of '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def is_held_out(doc_id) -> bool:
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0
