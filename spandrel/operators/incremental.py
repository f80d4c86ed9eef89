"""Process only what is new or changed since the last run that succeeded.

:class:`ManifestStore` keeps a manifest of what has been taken in on shared storage. A run lists
its input, anti-joins the listing against the committed manifest (:func:`pending`), writes output
and manifest into a folder of its own and commits last, by publishing a marker that names this
folder. Markers are numbered and never overwritten, so of two runs that read the same manifest one
commits and the other starts again from what the first has left; a crash before the marker leaves
nothing behind that is ever read.

:func:`replay` puts a history of runs through the same store at once. Each observation is assigned
to the first succeeded run that saw it, so there is no product of runs and rows, and observations
are folded per (path, run) before anything is ordered per path: a hot path costs one row per run.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.functions.lineage import broadcast_if_small, scratch
from spandrel.functions.text import blank_to_null, plain_path

_ENTRY = "path string, size bigint, checksum string, batch bigint"


class CommitConflict(RuntimeError):
    """Other runs committed first as often as this one was willing to start again."""


def pending(listing: DataFrame, manifest: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rows of ``listing`` (path, size, checksum, ...) that ``manifest`` (path, size, checksum, ...)
    doesn't hold as they are. Absent sizes equal each other, and so do absent checksums.

    ``as_of`` restricts which entries (``m``) a row (``l``) is held against. The join is on the path
    alone, which both sides may already be laid out by; a path has few entries.
    """
    l, m = listing.alias("l"), manifest.alias("m")
    differs = lambda c: ~F.col(f"l.{c}").eqNullSafe(F.col(f"m.{c}"))
    same = (F.col("l.path") == F.col("m.path")) & ~(differs("size") | differs("checksum"))
    return l.join(m, same if as_of is None else same & as_of, "left_anti")


def content_key(files: DataFrame) -> DataFrame:
    """``files`` with ``content``: the digest in lower case; a blank one is taken from another row
    with the same git_sha; where there is none, the git_sha itself stands for the content (null
    if both are absent). Other columns are dropped except path, obs_id and the two times."""
    f = files.select("obs_id", plain_path("path").alias("path"), F.lower(blank_to_null("digest")).alias("digest"),
                     blank_to_null("git_sha").alias("git_sha"), "observed_at", "arrived_at").where(F.col("path").isNotNull())
    known = (f.where(F.col("digest").isNotNull() & F.col("git_sha").isNotNull())
             .groupBy("git_sha").agg(F.min("digest").alias("known")))
    whole = f.where(F.col("digest").isNotNull()).select("*", F.col("digest").alias("content"))
    # only rows with a blank digest take part in the join; the other side has one row per git_sha
    mended = (f.where(F.col("digest").isNull()).join(known, "git_sha", "left")
              .withColumn("content", F.coalesce("known", F.concat(F.lit("sha:"), F.col("git_sha")))))
    cols = ["obs_id", "path", "content", "observed_at", "arrived_at"]
    return whole.select(*cols).unionByName(mended.select(*cols))


def _batch_of(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` with ``batch``, the number of the first run that started no earlier than arrived_at.

    An as-of join through the calendar: one row per day between the first and the last run (366
    rows a year, with the runs of that day as an array; broadcast if few enough), joined on the day
    of arrival. Rows that no run saw are dropped.
    """
    bounds = runs.agg(F.min("started_at").alias("lo"), F.max("started_at").alias("hi"), F.count("*").alias("n")).first()
    if not bounds.n:
        return rows.withColumn("batch", F.lit(None).cast("bigint")).where(F.lit(False))
    spark = rows.sparkSession
    first, last = bounds.lo.date(), bounds.hi.date()
    size = (last - first).days + 1
    days = spark.range(size).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    per_day = runs.groupBy(F.to_date("started_at").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("started_at", "batch"))).alias("starts"))
    calendar = days.join(per_day, "day", "left").select(
        "day", F.coalesce("starts", F.expr("cast(array() as array<struct<started_at:timestamp_ntz,batch:bigint>>)")).alias("starts"))
    calendar = calendar.withColumn("after", F.sum(F.size("starts")).over(Window.orderBy("day")).cast("bigint") + 1)
    joined = rows.withColumn("day", F.to_date("arrived_at")).join(broadcast_if_small(calendar, size + bounds.n), "day", "left")
    same_day = F.filter("starts", lambda r: r["started_at"] >= F.col("arrived_at"))
    batch = (F.when(F.col("day") < F.lit(first), F.lit(1))
             .when(F.size(same_day) > 0, same_day[0]["batch"]).otherwise(F.col("after")))
    return joined.withColumn("batch", batch.cast("bigint")).where(F.col("batch") <= F.lit(bounds.n)).drop("day", "starts", "after")


def listings(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, size, checksum, batch): what each numbered run (batch, started_at) finds when it lists
    its input, but only where it sees a row of that path for the first time. The content is that of
    the seen row with the greatest observed_at, then arrived_at, then obs_id."""
    rows = content_key(files).where(F.col("arrived_at").isNotNull()).withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz"))
    latest = _batch_of(rows, runs).groupBy("path", "batch").agg(
        F.max(F.struct("observed_at", "arrived_at", "obs_id", F.coalesce("content", F.lit("")).alias("content"))).alias("best"))
    w = Window.partitionBy("path").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    latest = latest.withColumn("best", F.max("best").over(w))
    return latest.select("path", F.lit(None).cast("bigint").alias("size"), F.col("best.content").alias("checksum"), "batch")


def changed_by_run(files: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """(run_id, path) of every succeeded run and path whose content is new or changed.

    The runs go through a :class:`ManifestStore` at ``root`` (by default a fresh one in the
    checkpoint folder); the rows are what its committed batches took in. Nulls: rows without path or
    arrival are never seen; an absent observation time sorts first; an absent content equals only
    another absent content. Rows delivered twice change nothing. Equal start times order by run_id.
    No runs or no files: no rows.
    """
    ok = runs.where((F.col("status") == "succeeded") & F.col("started_at").isNotNull()).select(
        "run_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"))
    ok = ok.groupBy("run_id").agg(F.min("started_at").alias("started_at"))
    ok = ok.withColumn("batch", F.row_number().over(Window.orderBy("started_at", "run_id")).cast("bigint"))  # one row per run
    store = ManifestStore(files.sparkSession, root or scratch(files.sparkSession, "runs"))
    store.replay("history", listings(files, ok), lambda df: df.select("path", "batch"))
    return store.read().join(broadcast_if_small(ok.select("batch", "run_id")), "batch").select("run_id", "path")


class ManifestStore:
    """A manifest (path, size, checksum) on a shared file system, with optimistic commits.

    ``root`` must be reachable from every executor. Only file-system metadata (markers, one per
    batch, folded into one at every ``compact_every``-th) comes to the driver, never manifest rows.

    Layout: ``attempts/<id>/{manifest,data}`` are written freely and read only if a marker names
    them; ``commits/<number>`` is the marker of a batch, ``folded/<number>`` that of a manifest
    folded from all batches up to that number.
    """

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 10) -> None:
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    # -- markers
    def _publish(self, folder: str, number: int, content: dict) -> bool:
        """Create a marker whole or not at all; False if that number is taken."""
        name, text = f"{number:012d}", json.dumps(content)
        tmp = self._path("tmp", uuid.uuid4().hex)
        out = self._fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(folder, name)
        self._fs.mkdirs(self._path(folder))
        try:
            if str(self._fs.getScheme()) == "file":
                bare = lambda p: urlparse(str(p)).path
                try:
                    os.link(bare(tmp), bare(target))  # unlike a rename it never replaces
                except FileExistsError:
                    return False
                return True
            try:
                none = getattr(self._hadoop.Options, "Rename").NONE
                options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 1)
                options[0] = none
                self._hadoop.FileContext.getFileContext(tmp.toUri(), self._conf).rename(tmp, target, options)
            except Exception:
                if self._fs.exists(target) and self._fs.exists(tmp):
                    return False
                raise
            return True
        finally:
            self._fs.delete(tmp, False)

    def _numbers(self, folder: str) -> list[int]:
        at = self._path(folder)
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdecimal())

    def _marker(self, folder: str, number: int) -> dict:
        stream = self._fs.open(self._path(folder, f"{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _state(self) -> tuple[int, str | None, list[dict]]:
        """(version, folder of the folded manifest, batches), the batches in order of commit; those
        the folded manifest covers have ``covered``."""
        numbers = self._numbers("commits")
        version = numbers[-1] if numbers else 0
        at = max((n for n in self._numbers("folded") if n <= version), default=0)
        folded = self._marker("folded", at) if at else {"attempt": None, "batches": []}
        batches = [b | {"covered": True} for b in folded["batches"]] + [self._marker("commits", n) for n in numbers if n > at]
        return version, folded["attempt"], batches

    def committed(self) -> list[str]:
        """Identifiers of the committed batches in the order of their commits."""
        return [b["batch_id"] for b in self._state()[2]]

    # -- the manifest
    def _manifest(self, state: tuple) -> DataFrame:
        version, folded, batches = state
        folders = ([folded] if folded else []) + [b["attempt"] for b in batches if not b.get("covered")]
        if not folders:
            return self.spark.createDataFrame([], _ENTRY)
        df = self.spark.read.schema(_ENTRY).parquet(*(f"{self.root}/attempts/{a}/manifest" for a in folders))
        return df.groupBy("path").agg(F.max_by(F.struct("size", "checksum", "batch"), F.col("batch")).alias("m")).select("path", "m.*")

    def manifest(self) -> DataFrame:
        """Latest committed entry per path."""
        return self._manifest(self._state())

    def pending(self, listing: DataFrame) -> DataFrame:
        """Rows of ``listing`` (path, size, checksum, ...) not in the manifest as they are."""
        return pending(listing, self.manifest())

    # -- runs
    def run(self, batch_id: str, listing: DataFrame, process: Callable[[DataFrame], DataFrame], attempts: int = 8) -> bool:
        """Process what is pending as ``batch_id``; False if a batch of that name is committed.

        What another run commits meanwhile makes this one start again, so every record is in exactly
        one committed batch; after ``attempts`` it raises :class:`CommitConflict`.
        """
        def write(attempt: str, state: tuple) -> None:
            todo = pending(listing, self._manifest(state))
            entries = todo.select("path", F.col("size").cast("bigint").alias("size"), F.col("checksum").cast("string").alias("checksum"), F.lit(state[0] + 1).cast("bigint").alias("batch"))
            entries.distinct().write.parquet(f"{attempt}/manifest")
            # the attempt's own manifest is the fixed list of what it covers, whatever arrives meanwhile
            fixed = self.spark.read.schema(_ENTRY).parquet(f"{attempt}/manifest").alias("m")
            l = listing.alias("l")
            same = (F.col("l.path") == F.col("m.path")) & F.col("l.size").eqNullSafe(F.col("m.size")) & F.col("l.checksum").eqNullSafe(F.col("m.checksum"))
            process(l.join(fixed, same, "left_semi")).write.parquet(f"{attempt}/data")

        return self._commit(batch_id, write, attempts)

    def replay(self, batch_id: str, listing: DataFrame, process: Callable[[DataFrame], DataFrame], attempts: int = 8) -> bool:
        """A history of runs as one commit. ``listing`` has ``batch``, the number of the run that
        lists the row. Each entry holds from its batch on until the path's next one; a row is
        pending if no entry holds it that an earlier batch left. The store must be empty."""
        def write(attempt: str, state: tuple) -> None:
            if state[0]:
                raise ValueError("a history starts with an empty store")
            w = Window.partitionBy("path").orderBy("batch")
            listing.withColumn("until", F.lead("batch").over(w)).write.parquet(f"{attempt}/manifest")
            held = self.spark.read.schema(f"{_ENTRY}, until bigint").parquet(f"{attempt}/manifest")
            as_of = (F.col("m.batch") < F.col("l.batch")) & (F.col("l.batch") <= F.col("m.until"))
            process(pending(held.drop("until"), held, as_of)).write.parquet(f"{attempt}/data")

        return self._commit(batch_id, write, attempts)

    def _commit(self, batch_id: str, write: Callable[[str, tuple], None], attempts: int) -> bool:
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError(f"batch_id {batch_id!r} is no plain name")
        for _ in range(attempts):
            state = self._state()
            if any(b["batch_id"] == batch_id for b in state[2]):
                return False
            attempt = uuid.uuid4().hex
            write(f"{self.root}/attempts/{attempt}", state)
            if self._publish("commits", state[0] + 1, {"batch_id": batch_id, "attempt": attempt}):
                if (state[0] + 1) % self.compact_every == 0:
                    self.compact()
                return True
            self._fs.delete(self._path("attempts", attempt), True)
        raise CommitConflict(f"{batch_id}: {attempts} attempts met newer commits")

    def compact(self) -> None:
        """Fold the manifests of all batches so far into one, so that a run reads few of them."""
        state = self._state()
        if not state[0] or state[0] in self._numbers("folded"):
            return
        attempt = uuid.uuid4().hex
        self._manifest(state).write.parquet(f"{self.root}/attempts/{attempt}/manifest")
        batches = [{"batch_id": b["batch_id"], "attempt": b["attempt"]} for b in state[2]]
        if not self._publish("folded", state[0], {"attempt": attempt, "batches": batches}):
            self._fs.delete(self._path("attempts", attempt), True)

    def clean(self, older_than_ms: int = 7 * 86_400_000) -> int:
        """Remove what failed attempts left behind that long ago; returns how many."""
        now = int(self.spark._jvm.java.lang.System.currentTimeMillis())
        named = {b["attempt"] for b in self._state()[2]} | {self._marker("folded", n)["attempt"] for n in self._numbers("folded")}
        at = self._path("attempts")
        gone = [x.getPath() for x in self._fs.listStatus(at) if x.getPath().getName() not in named and x.getModificationTime() <= now - older_than_ms] if self._fs.exists(at) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    def read(self) -> DataFrame | None:
        """Output of all committed batches; None without any."""
        batches = self._state()[2]
        return self.spark.read.parquet(*(f"{self.root}/attempts/{b['attempt']}/data" for b in batches)) if batches else None
