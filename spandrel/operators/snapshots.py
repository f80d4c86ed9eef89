"""What changed between consecutive full snapshots.

Each record becomes a hash of its canonical form on the map side. The snapshots of a source are
chained by generation and get a number each; a full outer join on (chain, number, key) compares
each with the one before. Only (numbers, key, 128-bit hash) are shuffled, never texts: once to put
repeats aside and once more to meet the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.jsonudf import canonical_json_udf
from spandrel.functions.lineage import broadcast_if_small, stored


def number_snapshots(chain: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by..., order, chain, pos, last): distinct snapshots with the number of their chain, their
    place in it from 1, and whether they end it."""
    c = chain.select(*by, order).distinct().withColumn("m", F.monotonically_increasing_id())
    w = Window.partitionBy(*by)
    return stored(c.select(*by, order, F.min("m").over(w).alias("chain"), F.row_number().over(w.orderBy(order)).alias("pos"), (F.count("*").over(w) == F.row_number().over(w.orderBy(order))).alias("last")))


def diff_snapshots(rows: DataFrame, chain: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Full outer join of consecutive snapshots.

    ``rows``: (by..., order, key, hash); a key repeated within a snapshot counts by its smallest
    hash. ``chain``: (by..., order) of every snapshot, empty ones included; rows of none of them are
    left out. Result: (by..., order, key, change), order being that of the later snapshot. The first
    snapshot of a chain yields nothing. Null keys are no records.
    """
    numbers = number_snapshots(chain, by, order)
    small = broadcast_if_small(numbers)
    # 1: has a snapshot before it, 2: has one after it; an aggregate, so that both sides of the join
    # below share one exchange instead of pushing their filters under it
    sides = (F.col("pos") > 1).cast("int") + F.when(F.col("last"), 0).otherwise(2)
    r = rows.where(F.col(key).isNotNull()).join(small, [*by, order]).groupBy("chain", "pos", key).agg(F.min("hash").alias("hash"), F.min(sides).alias("sides"))
    later = r.where(F.col("sides").bitwiseAND(1) != 0).select("chain", "pos", key, F.col("hash").alias("new"))
    earlier = r.where(F.col("sides").bitwiseAND(2) != 0).select("chain", (F.col("pos") + 1).alias("pos"), key, F.col("hash").alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    j = later.join(earlier, ["chain", "pos", key], "full_outer").select("chain", "pos", key, change.alias("change")).where(F.col("change").isNotNull())
    return j.join(small.drop("last"), ["chain", "pos"]).select(*by, order, key, "change")


def canonical_hash(*parts: Column) -> Column:
    """128 bits (of SHA-256) of the parts; null and empty differ, and parts can't run into each other."""
    return F.substring(F.unhex(F.sha2(F.to_json(F.array(*parts)), 256)), 1, 16)


def source_changes(deliveries: DataFrame) -> DataFrame:
    """(source_id, generation, doc_key, change) of the full descriptions of sources.

    A delivery is a snapshot if it has as many distinct keys as its catalog's doc_count says
    (absent or unreadable counts: no snapshot). Repeats of a generation are equal; should they
    differ, a key takes the smallest hash, so the result doesn't depend on order. Titles and
    section texts compare exactly (null is not empty), entries as JSON values, sections as a set
    of (key, text). An empty snapshot counts as one.
    """
    d = deliveries.where(F.col("source_id").isNotNull() & F.col("generation").isNotNull()).select(
        "source_id", "generation", F.coalesce("docs", F.array()).alias("docs"),
        F.get_json_object("catalog", "$.doc_count").try_cast("bigint").alias("doc_count"))
    keys = F.array_distinct(F.filter(F.transform("docs", lambda x: x["key"]), lambda k: k.isNotNull()))
    d = d.where(F.size(keys) == F.col("doc_count"))
    chain = d.select("source_id", "generation")
    docs = d.select("source_id", "generation", F.explode("docs").alias("doc"))
    sections = F.to_json(F.array_sort(F.array_distinct(F.transform(
        F.coalesce(F.col("doc.sections"), F.array()), lambda s: F.to_json(F.array(s["key"], s["text"]))))))
    rows = docs.select("source_id", "generation", F.col("doc.key").alias("doc_key"), canonical_hash(
        F.col("doc.title"), canonical_json_udf(F.col("doc.entry")), sections).alias("hash"))
    return diff_snapshots(rows, chain, ["source_id"], "generation", "doc_key")
