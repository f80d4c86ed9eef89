"""Bounded walks over typed edges.

A walk is a loop on the driver with two jobs per hop: the frontier joins the admitted edges, new
nodes are kept by an anti-join with what has been reached, and the ring is written to the checkpoint
folder. The edges are projected once per walk, laid out by the end the walk stands on, and kept;
what executors lose of them is computed again. Frontiers and visited sets stay distributed and are
broadcast while they are small; only counts come back. Edges of a hub are split by AQE's skew join,
and ``distinct`` combines on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.lineage import broadcast_if_small, cut, stored


def edge_admits(kinds: Sequence[str] = (), min_confidence: float = 0.0) -> Column:
    """Whether an edge may be walked: kind in the set (empty: all) and confidence high enough."""
    c = F.col("confidence") >= min_confidence
    return c & F.col("kind").isin(*kinds) if kinds else c


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (here, there): 'in' walks to dependents, 'out' to dependencies."""
    here, there = {"in": ("target", "source"), "out": ("source", "target")}[direction]
    return edges.select(F.col(here).alias("here"), F.col(there).alias("there")).where(F.col("here").isNotNull() & F.col("there").isNotNull())


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Edges touching any of ``ids`` (symbol): incoming, outgoing or both, each edge once."""
    out = [edges.join(ids.select(F.col("symbol").alias(c)).distinct(), c, "left_semi").select("source", "target", "kind", "confidence")
           for c, d in (("target", "in"), ("source", "out")) if direction in (d, "both")]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1]).distinct()


def traverse(edges: DataFrame, seeds: DataFrame, direction: str = "in", max_depth: int = 4, kinds: Sequence[str] = (), min_confidence: float = 0.0,
             keep_seeds: bool = False) -> DataFrame:
    """(symbol, depth): least number of hops from any seed, seeds excluded unless asked for.

    ``both`` merges two separate walks and never turns round in between. Cycles, repeated edges,
    self-loops and repeated seeds change nothing; null ends are skipped; no seeds give no rows.
    """
    if direction == "both":
        both = [traverse(edges, seeds, x, max_depth, kinds, min_confidence, keep_seeds) for x in ("in", "out")]
        return both[0].unionByName(both[1]).groupBy("symbol").agg(F.min("depth").alias("depth"))
    e = _oriented(edges.where(edge_admits(kinds, min_confidence)), direction).repartition("here").persist()
    try:
        frontier = stored(seeds.select("symbol").where(F.col("symbol").isNotNull()).distinct())
        seen, reached, n = frontier.withColumn("depth", F.lit(0)), 0, frontier.count()
        for depth in range(1, max_depth + 1):
            reached += n
            step = e.join(broadcast_if_small(frontier, n), F.col("here") == F.col("symbol")).select(F.col("there").alias("symbol")).distinct()
            frontier = stored(step.join(broadcast_if_small(seen.select("symbol"), reached), "symbol", "left_anti"))
            n = frontier.count()
            if not n:
                break
            seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    finally:
        e.unpersist()
    return seen if keep_seeds else seen.where(F.col("depth") > 0)


def cap_by_depth(reached: DataFrame, max_nodes: int) -> DataFrame:
    """The ``max_nodes`` nearest, by depth and then id."""
    return reached.orderBy("depth", "symbol").limit(max_nodes)


def induced_edges(edges: DataFrame, reached: DataFrame, direction: str = "in", kinds: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    """Admitted edges between reached nodes."""
    ids = reached.select("symbol")
    e = edges.where(edge_admits(kinds, min_confidence))
    return e.join(ids.withColumnRenamed("symbol", "source"), "source", "left_semi").join(ids.withColumnRenamed("symbol", "target"), "target", "left_semi").select("source", "target", "kind", "confidence")


def depth_horizon(edges: DataFrame, reached_with_seeds: DataFrame, max_depth: int, direction: str = "in", kinds: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    """One row (cut_off): does an admitted edge leave the outermost ring for an unseen node?"""
    e = _oriented(edges.where(edge_admits(kinds, min_confidence)), direction)
    rim = reached_with_seeds.where(F.col("depth") == max_depth).select(F.col("symbol").alias("here"))
    beyond = e.join(rim, "here", "left_semi").join(reached_with_seeds.select(F.col("symbol").alias("there")), "there", "left_anti")
    return beyond.limit(1).agg((F.count("*") > 0).alias("cut_off"))


def code_dependents(reached: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reached nodes without file nodes that only pass imports on."""
    acts = edges.where(F.col("kind") != "imports").select(F.col("source").alias("symbol")).distinct()
    r = reached.join(nodes.select("symbol", F.col("kind").alias("_kind")).dropDuplicates(["symbol"]), "symbol", "left")
    r = r.join(acts.withColumn("_acts", F.lit(True)), "symbol", "left")
    return r.where((F.coalesce("_kind", F.lit("")) != "file") | F.col("_acts").isNotNull()).drop("_kind", "_acts")


def predecessor_via(edges: DataFrame, reached_with_seeds: DataFrame, cap: int = 3) -> DataFrame:
    """(symbol, via_target, via_kind, rn, omitted): how each dependent hangs on the ring before it,
    the first ``cap`` edges by (target, kind) and how many more there are."""
    r = reached_with_seeds
    inner = r.select(F.col("symbol").alias("target"), F.col("depth").alias("d0"))
    outer = r.select(F.col("symbol").alias("source"), F.col("depth").alias("d1"))
    j = edges.select("source", "target", "kind").distinct().join(outer, "source").join(inner, "target").where(F.col("d0") == F.col("d1") - 1)
    w = Window.partitionBy("source")
    j = j.withColumn("rn", F.row_number().over(w.orderBy("target", "kind"))).withColumn("omitted", F.greatest(F.count("*").over(w) - cap, F.lit(0)))
    return j.where(F.col("rn") <= cap).select(F.col("source").alias("symbol"), F.col("target").alias("via_target"), F.col("kind").alias("via_kind"), "rn", "omitted")


def shortest_path(edges: DataFrame, starts: DataFrame, goals: DataFrame, direction: str = "out", max_depth: int = 8, kinds: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    """(hop, source, target, kind) of one path with the fewest hops from any start to any goal.

    Ties are settled by the least (source, target, kind) at every node and the least goal. A node
    that is both start and goal is a path without hops. No path: no rows.
    """
    e = edges.where(edge_admits(kinds, min_confidence)).select("source", "target", "kind")
    here, there = ("source", "target") if direction == "out" else ("target", "source")
    frontier = cut(starts.select("symbol").distinct())
    seen = frontier.select("symbol", F.lit(0).alias("depth"), F.lit(None).cast("struct<source:string,target:string,kind:string>").alias("parent"))
    wanted = goals.select("symbol").distinct()
    goal = seen.join(wanted, "symbol", "left_semi").agg(F.min("symbol")).first()[0]
    for depth in range(1, max_depth + 1):
        if goal is not None:
            break
        step = e.join(frontier, F.col(here) == F.col("symbol")).drop("symbol").groupBy(F.col(there).alias("symbol")).agg(F.min(F.struct("source", "target", "kind")).alias("parent"))
        fresh = cut(step.join(seen.select("symbol"), "symbol", "left_anti").select("symbol", F.lit(depth).alias("depth"), "parent"))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh.select("symbol")
        goal = fresh.join(wanted, "symbol", "left_semi").agg(F.min("symbol")).first()[0]
    spark = edges.sparkSession
    hops, at = [], goal  # a chase of at most max_depth point lookups
    while at is not None and (row := seen.where(F.col("symbol") == at).first()).parent is not None:
        hops.append((row.depth, row.parent.source, row.parent.target, row.parent.kind))
        at = row.parent[here]
    return spark.createDataFrame(sorted(hops), "hop int, source string, target string, kind string")


def without_edges(nodes: DataFrame, edges: DataFrame, *, incoming: bool, outgoing: bool, kinds: Sequence[str] = ("calls", "imports")) -> DataFrame:
    """Nodes with no incoming (entry points), no outgoing (leaves) or neither (isolated) edges."""
    e = edges.where(F.col("kind").isin(*kinds))
    for wanted, column in ((incoming, "target"), (outgoing, "source")):
        if wanted:
            nodes = nodes.join(e.select(F.col(column).alias("symbol")), "symbol", "left_anti")
    return nodes


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("symbol")
    return edges.join(ids.withColumnRenamed("symbol", "source"), "source", "left_semi").join(ids.withColumnRenamed("symbol", "target"), "target", "left_semi")


def overlay_traverse(home_reached: DataFrame, xedges: DataFrame, budget: int = 64) -> DataFrame:
    """(symbol, depth) of foreign nodes one cross-store step from what a home walk reached, either
    way, the nearest ``budget``. ``xedges``: (here, there)."""
    both = xedges.select(F.col("src_id").alias("symbol"), F.col("tgt_id").alias("there")).unionByName(xedges.select(F.col("tgt_id").alias("symbol"), F.col("src_id").alias("there")))
    far = both.join(home_reached, "symbol").groupBy(F.col("there").alias("symbol")).agg((F.min("depth") + 1).alias("depth"))
    return cap_by_depth(far.join(home_reached.select("symbol"), "symbol", "left_anti"), budget)
