"""Keeping a graph's tables right as files, facts and notes come and go.

Tables are values: every operator takes the old ones and gives the new ones, which the caller writes
as one generation. None of them updates in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.operators.supports import edge_history, plan_replacement, support_project


def preferred(contributions: DataFrame) -> DataFrame:
    """(symbol, file): the contribution a symbol is shown by: a definition first, then the least
    file. ``contributions``: (symbol, file, is_def)."""
    c = contributions.where(F.col("symbol").isNotNull() & F.col("file").isNotNull())
    return c.groupBy("symbol").agg(F.min(F.struct((-F.coalesce("is_def", F.lit(0))).alias("d"), "file")).alias("m")).select("symbol", "m.file")


def remove_files(contributions: DataFrame, edges: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """What is left when ``files`` (file) are gone.

    ``contributions`` (symbol, file, is_def), ``edges`` (source, target, kind, file). Returns the
    contributions ``kept``; symbols that have a new home, ``rehomed`` (symbol, file); symbols nobody
    contributes any more, ``gone`` (symbol); the edges ``edges`` of other files both of whose ends
    are left; and those ``archived`` because their file or an end is gone. An unknown file changes
    nothing.
    """
    f = files.select("file").where(F.col("file").isNotNull()).distinct()
    kept = contributions.join(f, "file", "left_anti")
    left = kept.select("symbol").where(F.col("symbol").isNotNull()).distinct()
    was, now = preferred(contributions), preferred(kept)
    rehomed = now.join(was.withColumnRenamed("file", "old"), "symbol").where(F.col("file") != F.col("old")).select("symbol", "file")
    gone = contributions.select("symbol").where(F.col("symbol").isNotNull()).distinct().join(left, "symbol", "left_anti")
    lost = lambda c: gone.select(F.col("symbol").alias(c), F.lit(True).alias(f"{c}_gone"))
    marked = edges.join(f.withColumn("file_gone", F.lit(True)), "file", "left").join(lost("source"), "source", "left").join(lost("target"), "target", "left")
    dead = F.coalesce("file_gone", "source_gone", "target_gone", F.lit(False))
    cols = ["source", "target", "kind", "file"]
    return {"kept": kept, "rehomed": rehomed, "gone": gone, "edges": marked.where(~dead).select(*cols), "archived": marked.where(dead).select(*cols)}


def compact(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, contents: DataFrame, files: DataFrame, history: DataFrame, keep: int = 20) -> dict[str, DataFrame]:
    """The tables without what nothing refers to: edges without both ends, embeddings (id) without a
    node, contents (git_sha) without a file, history beyond the newest ``keep`` rows a file."""
    ids = nodes.select("symbol").distinct()
    e = edges.join(ids.withColumnRenamed("symbol", "source"), "source", "left_semi").join(ids.withColumnRenamed("symbol", "target"), "target", "left_semi")
    return {"edges": e.select(*edges.columns), "embeddings": embeddings.join(ids.withColumnRenamed("symbol", "id"), "id", "left_semi"),
            "contents": contents.join(files.select("git_sha").distinct(), "git_sha", "left_semi"), "history": edge_history(history, keep)}


def replace_supports(old: DataFrame, new: DataFrame, owner: str, generation: int) -> tuple[DataFrame, DataFrame]:
    """(supports, edges) after an owner's facts are replaced by those of one generation.

    Facts: (owner, generation, source, target, kind, fact_id, confidence, evidence_count). A
    generation older than the owner's is refused, and so is the same with other facts; an identical
    retry changes nothing. Public edges are projected anew from what all owners hold.
    """
    mine = old.where(F.col("owner") == owner)
    had = mine.agg(F.max("generation")).first()[0]
    if had is not None and generation < had:
        raise ValueError(f"generation {generation} is older than {had}")
    facts = new.withColumn("owner", F.lit(owner)).withColumn("generation", F.lit(generation).cast("bigint")).select(*old.columns)
    if had == generation and not plan_replacement(mine, facts, ["source", "target", "kind", "fact_id"]).where(F.col("op") != "keep").isEmpty():
        raise ValueError(f"generation {generation} with other facts")
    out = old.where(~F.col("owner").eqNullSafe(owner)).unionByName(facts)
    return out, support_project(out)


def restore_semantics(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """Nodes extracted anew with the description and validation they had; what the extraction itself
    brings wins. ``old``: (symbol, description, validated), one row per symbol at most."""
    o = old.select("symbol", F.col("description").alias("_d"), F.col("validated").alias("_v")).dropDuplicates(["symbol"])
    j = fresh.join(o, "symbol", "left")
    return j.withColumn("description", F.coalesce("description", "_d")).withColumn("validated", F.coalesce("validated", "_v")).drop("_d", "_v")


def annotate(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """Notes (symbol, key, value, ts) with new ones; one row per (symbol, key, value), the latest."""
    both = annotations.unionByName(new)
    return both.groupBy("symbol", "key", "value").agg(F.max("ts").alias("ts"))


def delete_annotations(annotations: DataFrame, doomed: DataFrame) -> DataFrame:
    """Notes without those of ``doomed`` (symbol, key); a null key takes all of the symbol's."""
    d = doomed.where(F.col("symbol").isNotNull())
    rest = annotations.join(d.where(F.col("key").isNull()).select("symbol").distinct(), "symbol", "left_anti")
    return rest.join(d.where(F.col("key").isNotNull()).select("symbol", "key").distinct(), ["symbol", "key"], "left_anti").select(*annotations.columns)


def set_semantics(semantics: DataFrame, new: DataFrame) -> DataFrame:
    """Semantics (symbol, ...) with the rows of ``new`` in place of their symbols' old ones."""
    return semantics.join(new.select("symbol").distinct(), "symbol", "left_anti").select(*semantics.columns).unionByName(new.select(*semantics.columns))


def surviving_bindings(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Scoped edges (source, target, kind, name, resolved_by) that stay when the candidates of some
    names (name) change: all that weren't bound by scope, and those of other names."""
    hit = edges.where(F.col("resolved_by") == "scoped").join(changed.select("name").distinct(), "name", "left_semi")
    key = ["source", "target", "kind", "name", "resolved_by"]
    return edges.join(hit.select(*key).distinct(), key, "left_anti").select(*edges.columns)


def scoped_to_repo(df: DataFrame, label: str, *columns: str) -> DataFrame:
    """A repository's rows with ``label/`` before the given columns, so that several share a store;
    rows that bear it already stay."""
    if "/" in label or not label:
        raise ValueError(f"{label!r} is no label")
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).startswith(f"{label}/"), F.col(c)).otherwise(F.concat(F.lit(f"{label}/"), F.col(c))))
    return df


def freshness(answers: DataFrame, files: DataFrame) -> DataFrame:
    """(answer, drifted, missing): files of an answer (answer, path, digest) whose digest isn't the
    current one (path, digest) any more, and those that are gone."""
    j = answers.join(files.select("path", F.col("digest").alias("now")).dropDuplicates(["path"]).withColumn("there", F.lit(True)), "path", "left")
    n = lambda c: F.count(F.when(c, 1))
    return j.groupBy("answer").agg(n(F.col("there") & ~F.col("digest").eqNullSafe(F.col("now"))).alias("drifted"), n(F.col("there").isNull()).alias("missing"))


def cached(cache: DataFrame, version: int) -> DataFrame:
    """Entries (key, version, value) that hold at the graph's current version; any change of the
    graph makes all others void."""
    return cache.where(F.col("version") == version)


def log_changes(log: DataFrame, changes: DataFrame, ts: int) -> DataFrame:
    """The log (seq, op, target, ts) with changes (op, target) numbered on from its end. Numbers rise
    within a partition of the changes and are unique, but not without gaps."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    seq = (F.monotonically_increasing_id() + F.lit(last + 1)).cast("bigint").alias("seq")
    return log.unionByName(changes.select(seq, "op", "target", F.lit(ts).cast("bigint").alias("ts")))
