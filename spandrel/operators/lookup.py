"""Point, prefix, scope and facet lookups: plain predicates that Catalyst pushes into the scan."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators.reads import clamp

#: Edge kinds that are built in (fixed values); others are written other:<tag>.
EDGE_KINDS = ("calls", "imports", "contains", "defines", "extends", "implements", "references", "flows_to", "depends_on", "invoked_by")
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def ascii_fold(c: Column | str) -> Column:
    """Lower case for A to Z only."""
    return F.translate(F.col(c) if isinstance(c, str) else c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_scope(c: Column | str, prefix: str) -> Column:
    """Whether a scope path lies in a subtree, by whole segments; the empty prefix holds all."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lit(True) if not prefix else (c == prefix) | c.startswith(prefix + "/")


def ancestors(scope: str) -> list[str]:
    """A scope path and all above it, the root included."""
    parts = scope.split("/") if scope else []
    return ["/".join(parts[:i]) for i in range(len(parts) + 1)]


def above(c: Column | str, scope: str) -> Column:
    """Whether a row's scope is the query's or one of its ancestors."""
    return (F.col(c) if isinstance(c, str) else c).isin(ancestors(scope))


def scope_kind(c: Column | str, prefix: str) -> Column:
    """A prefix that ends with a colon matches every subtree of that kind."""
    return (F.col(c) if isinstance(c, str) else c).startswith(prefix) if prefix.endswith(":") else in_scope(c, prefix)


def find_symbols(nodes: DataFrame, *, text: str | None = None, name: str | None = None, kinds: Sequence[str] = (), language: str | None = None,
                 scope: str = "", limit: int | None = None) -> DataFrame:
    """Conjunction of the given conditions; every filter comes before the limit, order by symbol."""
    out = nodes.where(in_scope("scope", scope)) if scope else nodes
    if text is not None:
        out = out.where(F.lower("name").contains(text.lower()))
    elif name is not None:
        out = out.where(F.col("name") == name)
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if language is not None:
        out = out.where(F.col("language") == language)
    return out.orderBy("symbol").limit(limit) if limit is not None else out


def name_prefix(nodes: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Names that start with a prefix, case of A to Z aside; by folded name, name, symbol."""
    return nodes.where(ascii_fold("name").startswith(prefix.translate({c: c + 32 for c in range(65, 91)}))).orderBy(ascii_fold("name"), "name", "symbol").limit(limit)


def parse_edge_kind(text: str) -> str:
    """A built-in kind or other:<tag>; near misses are refused."""
    if text in EDGE_KINDS or (text.startswith("other:") and len(text) > 6):
        return text
    raise ValueError(f"unknown edge kind {text!r}")


def resolve_operand(nodes: DataFrame, operand: str) -> DataFrame:
    """Nodes with that very symbol; only if there is none, those with that name."""
    exact = nodes.where(F.col("symbol") == operand)
    found = exact.limit(1).agg(F.count("*").alias("exact_hits"))
    by_name = nodes.where((F.col("name") == operand) & (F.col("symbol") != operand)).join(F.broadcast(found), F.col("exact_hits") == 0).drop("exact_hits")
    return exact.unionByName(by_name).dropDuplicates(["symbol"])


def symbol_source(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """(symbol, source): the bytes of the span, as they are even where it cuts a character in two;
    null for a zero span or one beyond the text.
    ``nodes`` (symbol, start_byte, end_byte, key), ``contents`` (key, blob)."""
    raw = F.encode("blob", "UTF-8")
    ok = (F.col("end_byte") > F.col("start_byte")) & (F.col("end_byte") <= F.octet_length("blob"))
    return nodes.join(contents, "key").select("symbol", F.when(ok, F.substring(raw, F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")).cast("string")).alias("source"))


def git_blob_sha(c: Column | str) -> Column:
    """The git blob identifier of a text."""
    b = F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(b).cast("string"), F.lit("\x00")), "UTF-8"), b))


def rules_recall(rules: DataFrame, facets: Mapping[str, str | None], projects: Sequence[str] = (), limit: int = 100) -> DataFrame:
    """Rules whose facets admit the query: a facet absent on either side is a wildcard; a rule with
    projects needs one of the query's. Retired ones and those with an effect are left out. By
    severity, weight (both falling), id; a limit above the ceiling is cut to it with a warning."""
    most, note = clamp(limit, "rules")
    if note:
        warnings.warn(note, stacklevel=2)
    out = rules.where(~F.coalesce("retired", F.lit(False)) & F.col("effect").isNull())
    for f, v in facets.items():
        if v is not None:
            out = out.where(F.col(f).isNull() | (F.col(f) == v))
    has = F.size(F.coalesce("projects", F.array())) > 0
    out = out.where(~has | F.arrays_overlap("projects", F.array(*map(F.lit, projects))) if projects else ~has)
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("severity")], F.lit(0))
    return out.orderBy(rank.desc(), F.col("weight").desc(), "id").limit(most)


def facet_admits(facets: Column, intent: Mapping[str, str]) -> Column:
    """Every facet of a memory must be met by the intent; one the intent lacks excludes."""
    m = F.create_map(*(F.lit(x) for kv in intent.items() for x in kv)) if intent else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.forall(F.map_entries(facets), lambda e: F.coalesce(F.element_at(m, e["key"]) == e["value"], F.lit(False)))


def visible(deps: Column, allowed: Sequence[str]) -> Column:
    """Whether all dependencies of a row are in the caller's set."""
    return F.size(F.array_except(F.coalesce(deps, F.array().cast("array<string>")), F.array(*map(F.lit, allowed)).cast("array<string>"))) == 0
