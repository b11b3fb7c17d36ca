"""A Spark session with the settings that the library expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """Get or create a session; adaptive execution on, UTC, Arrow on. ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName("quillrank")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see, as the session names it; where it names none (tests), the context gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "quillrank-checkpoints"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")
