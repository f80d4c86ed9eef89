"""Cutting the lineage of a plan that is read more than once, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is named, a local session gets one of its
    own; a cluster raises, for a folder of one machine is lost with it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spandrel-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there from now on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh place in the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder: unlike a checkpoint it has a known size, can be
    removed (:func:`discard`) and hands on nothing of its plan, which in a loop of many joins grows
    until planning stalls."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spandrel_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove tables made by :func:`stored` that no plan reads any more."""
    for df in frames:
        path = getattr(df, "_spandrel_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of at most a few hundred bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else with one to hash it, so
    that the other side isn't sorted. ``rows`` is their number where it is known; otherwise they are
    counted, at most ``limit`` + 1 of them."""
    n = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df.hint("shuffle_hash")
