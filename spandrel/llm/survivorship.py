"""One surviving record per group, field by field, by skyline selection.

Records are compared on which fields they fill (a set), on trust, and on recency (ties broken by
a name). A record is dominated if another is at least as good on all three and better on one. The
undominated records form layer 1, those dominated only by layer 1 form layer 2, and so on. Each
field is taken from the first layer that fills it; within the layer trust decides, then recency,
then the smaller name. As filling is compared as a set, a field's best value by that policy is
never dominated by a record that lacks it.

Scale: records are folded to one per (key, set of filled fields, trust) with map-side partial
aggregation before anything is gathered, so a key with a third of all rows contributes at most
2^fields times the levels of trust rows to the second step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FIELDS = 6


def _has(e: Column, i: int) -> Column:
    return e["mask"].bitwiseAND(F.lit(1 << i)) != 0


def _dominates(a: Column, b: Column) -> Column:
    """Strictly better: superset of fields, no less trust, no older (age, name) and not the same."""
    ge = (a["mask"].bitwiseAND(b["mask"]) == b["mask"]) & (a["trust"] >= b["trust"])
    newer = (a["age"] < b["age"]) | ((a["age"] == b["age"]) & (a["tie"] <= b["tie"]))
    same = (a["mask"] == b["mask"]) & (a["trust"] == b["trust"]) & (a["age"] == b["age"]) & (a["tie"] == b["tie"])
    return ge & newer & ~same


def _winner(i: int, values: bool) -> Column:
    """Source, layer and value of field ``i``: the policy within the first layer that fills it."""
    with_f = F.filter("sky", lambda e: _has(e, i))
    best = F.array_min(F.transform(with_f, lambda e: F.struct(
        e["layer"].alias("layer"), (-e["trust"]).alias("nt"), e["age"].alias("age"), e["tie"].alias("source"),
        *([e[f"v{i}"].alias("value")] if values else []))))
    return F.when(best.isNotNull(), F.struct(best["source"].alias("source"), best["layer"].alias("layer"),
                                             *([best["value"].alias("value")] if values else [])))


def best_representatives(df: DataFrame, key: str, fields: dict[str, Column], trust: Column, recency_micros: Column,
                         name: Column, *, values: bool = True, min_names: int = 1) -> DataFrame:
    """One row per key: ``key`` and, per field f, a struct ``f`` of (source, layer, value).

    ``fields`` maps a field name to its value or null where it isn't filled; ``name`` is both the
    tie break and the source reported. ``min_names=2`` leaves out keys with a single name. Rows
    with a null key or name are dropped; null trust is the lowest, null recency the oldest. Exact
    repeats change nothing. A field filled nowhere is null. With ``values=False`` no value is
    carried through the shuffles.
    """
    if not 1 <= len(fields) <= MAX_FIELDS:
        raise ValueError(f"1 to {MAX_FIELDS} fields")
    mask = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(fields.values())))
    rows = df.select(
        F.col(key).alias("key"), mask.cast("int").alias("mask"), F.coalesce(trust.cast("int"), F.lit(-(1 << 31))).alias("trust"),
        (-F.coalesce(recency_micros, F.lit(-(1 << 62)))).alias("age"), name.alias("tie"),
        *(c.alias(f"v{i}") for i, c in enumerate(fields.values()) if values),
    ).where(F.col("key").isNotNull() & F.col("tie").isNotNull())
    carried = [f"v{i}" for i in range(len(fields))] if values else []
    classes = rows.groupBy("key", "mask", "trust").agg(
        F.min(F.struct("age", "tie", *carried)).alias("r"), F.min("tie").alias("lo"), F.max("tie").alias("hi"))
    groups = classes.groupBy("key").agg(
        F.collect_list(F.struct("mask", "trust", "r.*")).alias("es"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if min_names > 1:
        groups = groups.where(F.col("lo") != F.col("hi"))
    # a linear extension of dominance: whoever dominates comes first
    ordered = F.sort_array(F.transform("es", lambda e: F.struct(
        (-F.bit_count(e["mask"])).alias("n"), (-e["trust"]).alias("nt"), e["age"].alias("age"), e["tie"].alias("tie"),
        e["mask"].alias("mask"), e["trust"].alias("trust"), *(e[v].alias(v) for v in carried))))
    item = lambda e, layer: F.struct(*(e[c].alias(c) for c in ("mask", "trust", "age", "tie", *carried)), layer.alias("layer"))

    def step(acc: Column, e: Column) -> Column:
        above = F.transform(F.filter(acc, lambda a: _dominates(a, e)), lambda a: a["layer"])
        return F.concat(acc, F.array(item(e, F.coalesce(F.array_max(above), F.lit(0)) + 1)))

    groups = groups.withColumn("es", ordered)
    start = F.filter(F.transform("es", lambda e: item(e, F.lit(0) + 0)), lambda e: F.lit(False))
    groups = groups.withColumn("sky", F.aggregate("es", start, step))
    out = [F.col("key").alias(key)]
    for i, f in enumerate(fields):
        out.append(_winner(i, values).alias(f))
    return groups.select(*out)
