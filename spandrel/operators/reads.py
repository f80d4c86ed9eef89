"""Reads of single records and small sets, and the limits answers are held to.

Plain predicates and equi-joins; Catalyst pushes them into the scans. Nulls never match. Each takes
whole tables and many operands at once as easily as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most a caller may ask for (fixed values).
CEILINGS = {"traverse_depth": 16, "traverse_nodes": 1_000, "search": 100, "path_depth": 16, "path_nodes": 5_000, "rank": 200, "communities": 200, "semantic": 100, "blast_depth": 24, "rules": 500}
#: Kinds of nodes that are values in flows, not structure (fixed values).
VALUE_KINDS = ("field", "parameter", "variable", "slot")
_VENDOR = r"(?i)(^|/)(vendor|vendored|node_modules|third_party|external)/"
_TEST = r"(?i)(^|/)(tests?|spec|__tests__)/|_test\.\w+$|\.(test|spec)\.\w+$"


def clamp(requested: int, limit: str) -> tuple[int, str | None]:
    """(the value used, a note): a value above the ceiling is cut to it, and the note says so."""
    most = CEILINGS[limit]
    return (requested, None) if requested <= most else (most, f"{limit} {requested} was cut to {most}")


def truncated(flags: DataFrame) -> DataFrame:
    """One row (incomplete): whether any of the walks (truncated) was; null flags say nothing."""
    return flags.agg(F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("incomplete"))


def get_node(nodes: DataFrame, symbol: str) -> DataFrame:
    """The node of a symbol, or no row."""
    return nodes.where(F.col("symbol") == symbol).limit(1)


def structural(c: Column | str = "kind") -> Column:
    """Whether a node is no value slot; an absent kind is structure."""
    c = F.col(c) if isinstance(c, str) else c
    return ~F.coalesce(c.isin(*VALUE_KINDS), F.lit(False))


def find_structural(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes that are structure, left out before the limit counts; by symbol."""
    out = nodes.where(structural())
    return out if limit is None else out.orderBy("symbol").limit(limit)


def shown(vendor: bool = False, tests: bool = False, trivial_lines: int = 0, ignored: Sequence[str] = ()) -> Column:
    """Display filter over (file, name, lines): leaves out vendored files and tests unless asked for,
    bodies of fewer than ``trivial_lines`` and names that are ``ignored``. Absent values pass."""
    keep = F.lit(True)
    if not vendor:
        keep = keep & ~F.col("file").rlike(_VENDOR)
    if not tests:
        keep = keep & ~F.col("file").rlike(_TEST)
    if trivial_lines:
        keep = keep & (F.coalesce("lines", F.lit(trivial_lines)) >= trivial_lines)
    if ignored:
        keep = keep & ~F.col("name").isin(*ignored)
    return F.coalesce(keep, F.lit(True))


def unresolved_for_name(parked: DataFrame, names: DataFrame) -> DataFrame:
    """Parked references (raw_name, ...) to any of ``names`` (name)."""
    return parked.join(names.select(F.col("name").alias("raw_name")).distinct(), "raw_name", "left_semi")


def parked_imports(parked: DataFrame, prefix: str = "", relative_only: bool = False) -> DataFrame:
    """Parked import references of files under a path prefix, by whole segments."""
    out = parked.where(F.col("kind") == "imports")
    if prefix:
        out = out.where((F.col("file") == prefix) | F.col("file").startswith(prefix.rstrip("/") + "/"))
    return out.where(F.col("raw_name").rlike(r"^\.\.?/")) if relative_only else out


def by_requirement(semantics: DataFrame, text: str) -> DataFrame:
    """Distinct symbols whose requirement equals a text exactly."""
    return semantics.where(F.col("requirement") == text).select("symbol").distinct()


def annotations_of(annotations: DataFrame, symbols: DataFrame, type_: str | None = None) -> DataFrame:
    """Notes of the given symbols, of one type if asked for."""
    out = annotations.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return out if type_ is None else out.where(F.col("type") == type_)


def annotation_overview(annotations: DataFrame, cap: int = 20) -> DataFrame:
    """(symbol, n, by_type, has_advisory, inline): counts, counts per type, whether there is advice,
    and the first ``cap`` notes as structs, advice first, then the newest."""
    a = annotations.withColumn("type", F.coalesce("type", F.lit("")))
    types = a.groupBy("symbol", "type").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("type", "n"))).alias("by_type"))
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy(F.col("type") != "advisory", F.desc("ts"), "key", "value")
    first = a.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).groupBy("symbol").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "type", "key", "value"))), lambda x: F.struct(x["type"].alias("type"), x["key"].alias("key"), x["value"].alias("value"))).alias("inline"))
    return types.join(first, "symbol").select("symbol", "n", "by_type", F.exists("by_type", lambda x: x["type"] == "advisory").alias("has_advisory"), "inline")


def latest_versions(files: DataFrame) -> DataFrame:
    """(path, git_sha) of the last stored observation of every path (path, git_sha, observed_at,
    arrived_at, obs_id); paths never stored have no row."""
    f = files.where(F.col("git_sha").isNotNull() & F.col("path").isNotNull())
    return f.groupBy("path").agg(F.max(F.struct("observed_at", "arrived_at", "obs_id", "git_sha")).alias("m")).select("path", "m.git_sha")


def file_content(latest: DataFrame, contents: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(path, text) of files by way of the content store; a path is filtered before texts are read."""
    if paths is not None:
        latest = latest.join(paths.select("path").distinct(), "path", "left_semi")
    return latest.join(contents.select("git_sha", F.col("blob").alias("text")), "git_sha").select("path", "text")


def nodes_export(nodes: DataFrame, *, kinds: Sequence[str] = (), annotations: DataFrame | None = None, key: str | None = None, semantics: DataFrame | None = None) -> DataFrame:
    """Nodes of the given kinds (``all``: every kind but file) or with an annotation key, with their
    description where ``semantics`` (symbol, description) is given."""
    out = nodes
    if tuple(kinds) == ("all",):
        out = out.where(F.col("kind") != "file")
    elif kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if annotations is not None:
        a = annotations if key is None else annotations.where(F.col("key") == key)
        out = out.join(a.select("symbol").distinct(), "symbol", "left_semi")
    return out if semantics is None else out.join(semantics.select("symbol", "description").dropDuplicates(["symbol"]), "symbol", "left")


def retrieve_entity(nodes: DataFrame, symbols: DataFrame, annotations: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Nodes of the given symbols with the number of their notes and, if given, their source (symbol,
    source)."""
    n = nodes.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    notes = annotations.join(symbols.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("notes"))
    out = n.join(notes, "symbol", "left").withColumn("notes", F.coalesce("notes", F.lit(0)))
    return out if sources is None else out.join(sources.select("symbol", "source"), "symbol", "left")


def did_you_mean(probes: DataFrame, nodes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(probe, resolved, suggestions): whether a name exists; if not, what is close, best first."""
    known = nodes.select(F.col("name").alias("probe")).distinct().withColumn("resolved", F.lit(True))
    s = suggestions.groupBy("probe").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]).alias("s"))
    j = probes.select("probe").distinct().join(known, "probe", "left").join(s, "probe", "left")
    none = F.array().cast("array<string>")
    return j.select("probe", F.coalesce("resolved", F.lit(False)).alias("resolved"), F.when(F.col("resolved"), none).otherwise(F.coalesce("s", none)).alias("suggestions"))


def live_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vector hits (query_id, id, score, rank) whose id is a live node, ranked anew."""
    from spandrel.operators.textsearch import top_k

    return top_k(hits.drop("rank").join(nodes.select(F.col("symbol").alias("id")), "id", "left_semi"), 1 << 30)


def above_floor(hits: DataFrame, floor: float = 0.55) -> DataFrame:
    """Vector hits similar enough to be fused with others."""
    return hits.where(F.col("score") >= floor)


def support_reads(supports: DataFrame) -> DataFrame:
    """(owner, generation, facts, edges) of every owner: its newest generation and what is in it."""
    last = supports.groupBy("owner").agg(F.max("generation").alias("generation"))
    return supports.join(last, ["owner", "generation"]).groupBy("owner", "generation").agg(F.countDistinct("fact_id").alias("facts"), F.countDistinct("source", "target", "kind").alias("edges"))


def edges_at(edges: DataFrame, *, store: str | None = None, id_: str | None = None, owner: str | None = None, rel_prefix: str = "", epochs: DataFrame | None = None) -> DataFrame:
    """Typed cross-store edges by endpoint (either end), owner and prefix of the relation; with
    ``epochs`` (store, id, epoch) only those both of whose ends have their epoch."""
    out = edges
    if store is not None or id_ is not None:
        end = lambda s: (F.lit(True) if store is None else F.col(f"{s}_store") == store) & (F.lit(True) if id_ is None else F.col(f"{s}_id") == id_)
        out = out.where(end("src") | end("tgt"))
    if owner is not None:
        out = out.where(F.col("owner") == owner)
    if rel_prefix:
        out = out.where(F.col("rel").startswith(rel_prefix))
    if epochs is not None:
        for s in ("src", "tgt"):
            live = epochs.select(F.col("store").alias(f"{s}_store"), F.col("id").alias(f"{s}_id"), F.col("epoch").alias(f"{s}_epoch")).distinct()
            out = out.join(live, [f"{s}_store", f"{s}_id", f"{s}_epoch"], "left_semi")
    return out
