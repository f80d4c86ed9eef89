"""Generations of facts, change logs and history: set differences and keyed merges."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan_replacement(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key..., op): what turns an owner's old facts into the new ones: delete, insert or keep."""
    o, n = old.select(*key).distinct().withColumn("o", F.lit(True)), new.select(*key).distinct().withColumn("n", F.lit(True))
    j = o.join(n, key, "full_outer")
    return j.select(*key, F.when(F.col("n").isNull(), "delete").when(F.col("o").isNull(), "insert").otherwise("keep").alias("op"))


def support_project(supports: DataFrame) -> DataFrame:
    """One public edge per (source, target, kind): highest confidence, then most evidence, then the
    least fact."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("evidence_count")).alias("e"), "fact_id"))
    return supports.groupBy("source", "target", "kind").agg(best.alias("b")).select("source", "target", "kind", (-F.col("b.c")).alias("confidence"), (-F.col("b.e")).alias("evidence_count"), "b.fact_id")


def changes_since(log: DataFrame, cursor: int, limit: int = 10_000) -> DataFrame:
    """The next page of a change log, in order."""
    return log.where(F.col("seq") > cursor).orderBy("seq").limit(limit)


def edge_history(archived: DataFrame, keep: int = 20) -> DataFrame:
    """The newest ``keep`` archived rows per file."""
    w = Window.partitionBy("file").orderBy(F.col("at").desc(), F.col("seq").desc())
    return archived.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).drop("r")


def classify_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): unchanged, changed, added or deleted between two listings (path, digest)."""
    j = old.select("path", F.col("digest").alias("o"), F.lit(True).alias("in_o")).join(new.select("path", F.col("digest").alias("n"), F.lit(True).alias("in_n")), "path", "full_outer")
    return j.select("path", F.when(F.col("in_n").isNull(), "deleted").when(F.col("in_o").isNull(), "added").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed").alias("status"))


def cap_rows_to_budget(rows: DataFrame, order: list[str], budget: int = 25_000) -> DataFrame:
    """Leading rows whose JSON stays within ``budget`` characters in all. A row takes two at least,
    so more than half as many rows need not be looked at."""
    rows = rows.orderBy(*order).limit(budget // 2 + 1)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_used", F.sum(F.length(F.to_json(F.struct(*rows.columns)))).over(w)).where(F.col("_used") <= budget).drop("_used")


def fingerprint(rows: DataFrame, what: str = "") -> str:
    """A hash of a question and all rows that answer it, whatever their order."""
    digest = rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()[0]
    return hashlib.sha1(f"{what}|{digest}".encode()).hexdigest()[:16]


def page(rows: DataFrame, order: list[str], size: int, cursor: str | None = None, what: str = "") -> tuple[DataFrame, str | None]:
    """One page of ``rows`` and the cursor of the next, None after the last.

    A cursor holds the place and the fingerprint of the question (``what``) and all its rows. One
    that can't be read, or whose rows have changed since, is an error and never page one again.
    """
    if size < 1:
        raise ValueError("a page has a row at least")
    offset, now = 0, fingerprint(rows, what)
    if cursor is not None:
        try:
            offset, then = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        except (ValueError, TypeError) as e:
            raise ValueError("malformed cursor") from e
        if type(offset) is not int or offset < 0 or then != now:
            raise ValueError("stale cursor")
    more = rows.count() > offset + size
    following = base64.urlsafe_b64encode(json.dumps([offset + size, now]).encode()).decode() if more else None
    return rows.orderBy(*order).offset(offset).limit(size), following
