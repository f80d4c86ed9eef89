"""References to records that do not exist.

A reference is a composite key (store, id, epoch) whose parts may be absent. References are
grouped by which parts are present (their null mask), and each group is anti-joined on just
these parts against the live records: these come once per mask, with the other parts blanked, so
one join serves all masks. What is left over is missing, deleted, stale or late, told apart by the
target's one summary row. Targets are folded to one row per key before anything else, so a hot
target never multiplies rows; the fold is written to the checkpoint folder, so each table is read
once, and AQE splits the reference side of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.lineage import stored
from spandrel.functions.text import blank_to_null


def fold_targets(*stores: tuple[str, DataFrame]) -> DataFrame:
    """One row per (store, id): (store, id, gone, epochs, since).

    Each store's frame is (id, epoch, since, gone_at). Repeated rows: a record is gone only if
    every row says so, all its epochs count as current, and it exists since the earliest time.
    """
    rows = None
    for store, df in stores:
        part = df.where(F.col("id").isNotNull()).select(F.lit(store).alias("store"), "id", "epoch", "since", "gone_at")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("store", "id").agg(
        F.bool_and(F.col("gone_at").isNotNull()).alias("gone"), F.collect_set("epoch").alias("epochs"), F.min("since").alias("since"))


def orphan_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(ref_table, ref_id, ref_field, at, state) of references that don't hold.

    ``refs``: (ref_table, ref_id, ref_field, store, id, epoch, at). Declared match semantics: a
    null id or store is no reference (mask without id: skipped); a null epoch matches any epoch
    (mask id only); a present epoch must equal one of the target's. The first state that holds:
    missing, deleted, stale, late. A null time on either side is never late.
    """
    r = refs.where(F.col("id").isNotNull() & F.col("store").isNotNull()).select("ref_table", "ref_id", "ref_field", "store", "id", "epoch", "at")
    targets = stored(targets)
    by_id = F.struct(F.lit("id").alias("mask"), F.lit(None).cast("bigint").alias("epoch"))
    by_epoch = F.transform("epochs", lambda e: F.struct(F.lit("id, epoch").alias("mask"), e.cast("bigint").alias("epoch")))
    live = targets.where(~F.col("gone")).select("store", "id", "since", F.explode(F.concat(F.array(by_id), by_epoch)).alias("k")).select("store", "id", "since", "k.*").alias("t")
    r = r.withColumn("mask", F.when(F.col("epoch").isNull(), "id").otherwise("id, epoch")).alias("r")
    met = F.coalesce(F.col("t.since") <= F.col("r.at"), F.lit(True)) & F.col("r.epoch").eqNullSafe(F.col("t.epoch"))
    for c in ("store", "id", "mask"):
        met = (F.col(f"r.{c}") == F.col(f"t.{c}")) & met
    orphans = r.join(live, met, "left_anti")
    j = orphans.join(targets, ["store", "id"], "left")  # only what matched nothing is looked at again
    state = (F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "deleted")
             .when(~F.coalesce(F.array_contains("epochs", F.col("epoch")), F.lit(True)), "stale").when(F.col("since") > F.col("at"), "late"))
    return j.select("ref_table", "ref_id", "ref_field", "at", state.alias("state"))


def estate_references(edges: DataFrame, reports: DataFrame) -> DataFrame:
    """Both ends of every typed edge and the target of every orphan report, as references."""
    ends = F.explode(F.array(
        F.struct(F.lit("src_id").alias("ref_field"), F.col("src_store").alias("store"), F.col("src_id").alias("id"), F.col("src_epoch").alias("epoch")),
        F.struct(F.lit("tgt_id").alias("ref_field"), F.col("tgt_store").alias("store"), F.col("tgt_id").alias("id"), F.col("tgt_epoch").alias("epoch"))))
    e = edges.select("edge_id", F.col("asserted_at").alias("at"), ends.alias("x")).select(
        F.lit("typed_xedges").alias("ref_table"), F.col("edge_id").alias("ref_id"), "x.ref_field", "x.store",
        blank_to_null("x.id").alias("id"), F.col("x.epoch").cast("bigint").alias("epoch"), "at")
    o = reports.select(
        F.lit("orphaned_edges").alias("ref_table"), F.col("report_id").alias("ref_id"), F.lit("to_id").alias("ref_field"),
        F.lit("knowledge").alias("store"), blank_to_null("to_id").alias("id"), F.lit(None).cast("bigint").alias("epoch"), F.col("reported_at").alias("at"))
    return e.where(F.col("store") != "control").unionByName(o)


def estate_targets(nodes: DataFrame, knowledge: DataFrame) -> DataFrame:
    return fold_targets(
        ("estate", nodes.select(blank_to_null("symbol").alias("id"), "epoch", F.col("first_seen").alias("since"), F.col("removed_at").alias("gone_at"))),
        ("knowledge", knowledge.select(blank_to_null("node_id").alias("id"), "epoch", F.col("created_at").alias("since"), F.col("tombstoned_at").alias("gone_at"))))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, month and state."""
    return orphans.groupBy("ref_table", "ref_field", F.date_format("at", "yyyy-MM").alias("period"), "state").agg(F.count("*").alias("n"))
