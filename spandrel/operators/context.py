"""What a language model is shown of a graph: neighbourhoods packed into a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.lineage import broadcast_if_small, stored
from spandrel.operators import graph as G
from spandrel.operators import memory as M
from spandrel.operators import rank as K


def stub(nodes: DataFrame) -> DataFrame:
    """(symbol, stub, cost): one line per node and its cost in tokens, four characters each."""
    line = F.concat_ws(" ", "kind", "name", F.concat(F.lit("@"), "file"))
    return nodes.select("symbol", line.alias("stub"), F.ceil(F.length(line) / 4).cast("bigint").alias("cost"))


def render_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int = 6_000, depth: int = 2, most: int = 200, rank_most: int = 500) -> DataFrame:
    """(position, symbol, stub): the seeds' neighbourhood of ``depth`` hops both ways, at most
    ``most`` nodes and the seeds, in the order of personalised PageRank, packed greedily into
    ``budget`` tokens: what doesn't fit is passed over. Nodes ranked after ``rank_most`` come last,
    by symbol. No seeds: no rows."""
    near = G.cap_by_depth(G.traverse(edges, seeds, "both", depth), most).select("symbol").unionByName(seeds.select("symbol")).distinct()
    rank = K.pagerank(nodes, edges, seeds=seeds)
    top = rank.orderBy(F.desc(F.round("score", 12)), "symbol").limit(rank_most)
    j = near.join(stub(nodes), "symbol").join(broadcast_if_small(top, rank_most), "symbol", "left")
    w = Window.orderBy(F.desc_nulls_last(F.round("score", 12)), "symbol")  # of some hundred rows
    ranked = stored(j.withColumn("rank", F.row_number().over(w)))
    kept = M.budget_pack(ranked.select(F.lit(1).alias("query_id"), F.col("symbol").alias("id"), "rank", "cost"), budget)
    return kept.select("position", F.col("id").alias("symbol")).join(ranked.select("symbol", "stub"), "symbol").select("position", "symbol", "stub")


def context_pack(nodes: DataFrame, edges: DataFrame, name: str, budget: int = 2_000) -> DataFrame:
    """:func:`render_context` around all nodes of a name; at most 6 000 tokens."""
    return render_context(nodes, edges, nodes.where(F.col("name") == name).select("symbol"), min(budget, 6_000))


def budget_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hits: DataFrame, budget: int) -> DataFrame:
    """(position, symbol, score, used): neighbours of the seeds score 2 per edge, text hits (symbol)
    1 if nothing else; by score and symbol until the first that doesn't fit ends the list. A node
    costs its name, its file and 100."""
    e = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    near = e.join(seeds.select(F.col("symbol").alias("source")).distinct(), "source", "left_semi").groupBy(F.col("target").alias("symbol")).agg((F.count("*") * 2.0).alias("score"))
    only = hits.select("symbol").distinct().join(near, "symbol", "left_anti").withColumn("score", F.lit(1.0))
    scored = near.unionByName(only).join(seeds.select("symbol"), "symbol", "left_anti").join(nodes.select("symbol", "name", "file"), "symbol")
    cost = (F.length(F.coalesce("name", F.lit(""))) + F.length(F.coalesce("file", F.lit(""))) + 100).cast("bigint")
    # every row costs 100 at least, so that many can matter and no more
    first = scored.withColumn("cost", cost).orderBy(F.desc("score"), "symbol").limit(budget // 100 + 1)
    w = Window.orderBy(F.desc("score"), "symbol")
    run = first.withColumn("position", F.row_number().over(w)).withColumn("used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("used") <= budget).select("position", "symbol", "score", "used")


def source_bundle(sources: DataFrame, budget: int = 8_000, most: int = 24_000) -> DataFrame:
    """(group, position, symbol): sources (group, symbol, source) in the order of symbols, greedily
    packed into ``budget`` characters a group (at most ``most``); absent sources are left out."""
    s = sources.where(F.col("source").isNotNull()).select(F.col("group").alias("query_id"), F.col("symbol").alias("id"), F.row_number().over(Window.partitionBy("group").orderBy("symbol")).alias("rank"), F.length("source").alias("cost"))
    return M.budget_pack(s, min(budget, most)).select(F.col("query_id").alias("group"), "position", F.col("id").alias("symbol"))


def crossings(edges: DataFrame, reached_with_seeds: DataFrame, nodes: DataFrame, cap: int = 20) -> DataFrame:
    """(source, target, depth): edges between different repositories that a walk took, one ring to
    the next; by depth and ends, the first ``cap``. ``nodes``: (symbol, repo)."""
    r = reached_with_seeds.join(nodes.select("symbol", "repo").dropDuplicates(["symbol"]), "symbol")
    outer = r.select(F.col("symbol").alias("source"), F.col("depth").alias("d1"), F.col("repo").alias("r1"))
    inner = r.select(F.col("symbol").alias("target"), F.col("depth").alias("d0"), F.col("repo").alias("r0"))
    j = edges.select("source", "target").distinct().join(outer, "source").join(inner, "target").where((F.col("d1") == F.col("d0") + 1) & (F.col("r0") != F.col("r1")))
    return j.select("source", "target", F.col("d1").alias("depth")).orderBy("depth", "source", "target").limit(cap)


def refine_horizon(edges: DataFrame, reached_with_seeds: DataFrame, shown: DataFrame, max_depth: int, direction: str = "in", kinds: Sequence[str] = (), hops: int = 32) -> DataFrame:
    """One row (hidden): whether a walk cut at ``max_depth`` keeps rows back that would be shown
    (symbol): goes on from the outermost ring for up to ``hops`` more."""
    rim = reached_with_seeds.where(F.col("depth") == max_depth).select("symbol")
    beyond = G.traverse(edges, rim, direction, hops, kinds).select("symbol")
    new = beyond.join(reached_with_seeds.select("symbol"), "symbol", "left_anti").join(shown.select("symbol"), "symbol", "left_semi")
    return new.limit(1).agg((F.count("*") > 0).alias("hidden"))


def flow_lineage(flows: DataFrame, producers: DataFrame, max_depth: int = 24, most: int = 5_000) -> DataFrame:
    """(symbol, depth) of what consumes a producer's values, directly or through others. ``flows``
    are flows_to edges: source consumes, target produces."""
    return G.cap_by_depth(G.traverse(flows.where(F.col("kind") == "flows_to"), producers, "in", max_depth), most)


def graph_view(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, limit: int = 80, per_node: int = 6, focus: DataFrame | None = None) -> DataFrame:
    """(symbol, degree): a connected slice of the graph. Starts from the best-ranked third of
    ``limit`` (or up to five ``focus`` symbols) and adds, ring by ring, the best-ranked ``per_node``
    neighbours of every node until ``limit``; what is missing then comes by rank, unless focused.
    Degrees count edges inside the slice. ``nodes`` are those that may be shown."""
    e = edges.where(F.col("kind").isin("calls", "imports") & (F.col("source") != F.col("target"))).select("source", "target")
    r = stored(nodes.select("symbol").distinct().join(ranks.select("symbol", F.round("score", 12).alias("score")), "symbol"))
    both = e.select(F.col("source").alias("here"), F.col("target").alias("symbol")).unionByName(e.select(F.col("target").alias("here"), F.col("source").alias("symbol"))).distinct()
    start = r.orderBy(F.desc("score"), "symbol").limit(max(1, limit // 3)) if focus is None else r.join(focus.select("symbol"), "symbol", "left_semi").orderBy(F.desc("score"), "symbol").limit(min(5, limit))
    chosen = stored(start.select("symbol", "score"))
    n, frontier = chosen.count(), chosen
    while 0 < n < limit:
        near = both.join(F.broadcast(frontier.select(F.col("symbol").alias("here"))), "here").join(r, "symbol").join(F.broadcast(chosen.select("symbol")), "symbol", "left_anti")
        w = Window.partitionBy("here").orderBy(F.desc("score"), "symbol")
        near = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_node)
        frontier = stored(near.select("symbol", "score").distinct().orderBy(F.desc("score"), "symbol").limit(limit - n))
        added = frontier.count()
        if not added:
            break
        chosen, n = chosen.unionByName(frontier), n + added
    if focus is None and n < limit:
        chosen = chosen.unionByName(r.join(F.broadcast(chosen.select("symbol")), "symbol", "left_anti").orderBy(F.desc("score"), "symbol").limit(limit - n))
    ids = F.broadcast(stored(chosen.select("symbol")))
    inside = e.distinct().join(ids.withColumnRenamed("symbol", "source"), "source", "left_semi").join(ids.withColumnRenamed("symbol", "target"), "target", "left_semi")
    degree = inside.select(F.explode(F.array("source", "target")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("degree"))
    return ids.join(degree, "symbol", "left").select("symbol", F.coalesce("degree", F.lit(0)).alias("degree"))
