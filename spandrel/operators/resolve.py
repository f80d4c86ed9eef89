"""Turning references by name into edges: equi-joins on names with conditions on the candidates.

``refs`` (ref_id, from_symbol, raw_name, file, ...), ``nodes`` (symbol, name, kind, file, ...).
Every resolver carries ref_id, so which references stay open is a plain anti-join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.lineage import broadcast_if_small


def resolve_name(refs: DataFrame, nodes: DataFrame, confidence: float = 0.6) -> DataFrame:
    """(ref_id, target, confidence, resolved_by): names with exactly one candidate, never itself.

    Candidates are counted per name before the join, so an ambiguous name joins with nothing.
    """
    unique = nodes.where(F.col("name").isNotNull()).groupBy("name").agg(F.countDistinct("symbol").alias("n"), F.min("symbol").alias("target")).where(F.col("n") == 1)
    j = refs.join(unique, refs["raw_name"] == unique["name"]).where(F.col("target") != F.col("from_symbol"))
    return j.select("ref_id", "target", F.lit(confidence).alias("confidence"), F.lit("name").alias("resolved_by"))


def directory(path: Column | str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolve_scoped(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nearest tier wins (same file 0.65, same directory 0.62, elsewhere 0.60) and must hold
    one candidate only.

    Candidates are counted per (name, file), (name, directory) and name instead of listing the
    pairs, so a name that a third of all nodes bear costs three rows per reference.
    """
    n = nodes.where(F.col("name").isNotNull()).select("symbol", "name", "file", directory("file").alias("dir")).distinct()
    r = refs.select("ref_id", "from_symbol", F.col("raw_name").alias("name"), "file", directory("file").alias("dir"))

    def tier(keys: list[str], rank: int) -> DataFrame:
        return n.groupBy(*keys).agg(F.countDistinct("symbol").alias(f"n{rank}"), F.min("symbol").alias(f"s{rank}"), F.max("symbol").alias(f"t{rank}"))

    j = r.join(tier(["name", "file"], 0), ["name", "file"], "left").join(tier(["name", "dir"], 1), ["name", "dir"], "left").join(tier(["name"], 2), "name", "left")

    def others(k: int) -> Column:  # candidates but for the referrer itself
        mine = (F.col(f"s{k}") == F.col("from_symbol")) | (F.col(f"t{k}") == F.col("from_symbol"))
        return F.coalesce(F.col(f"n{k}"), F.lit(0)) - F.when(mine, 1).otherwise(0)

    def only(k: int) -> Column:
        return F.when(F.col(f"s{k}") == F.col("from_symbol"), F.col(f"t{k}")).otherwise(F.col(f"s{k}"))

    pick = F.when(others(0) > 0, F.when(others(0) == 1, F.struct(only(0).alias("t"), F.lit(0.65).alias("c"))))
    pick = pick.when(others(1) > 0, F.when(others(1) == 1, F.struct(only(1).alias("t"), F.lit(0.62).alias("c"))))
    pick = pick.when(others(2) == 1, F.struct(only(2).alias("t"), F.lit(0.60).alias("c")))
    return j.select("ref_id", pick.alias("p")).where(F.col("p").isNotNull()).select("ref_id", F.col("p.t").alias("target"), F.col("p.c").alias("confidence"), F.lit("scoped").alias("resolved_by"))


def resolve_import_map(refs: DataFrame, nodes: DataFrame, confidence: float = 0.63) -> DataFrame:
    """Calls with a ``module`` hint: the one candidate of that name whose file, without extension,
    is the module or ends with it. The match runs on every suffix of the file's path, an equi-join."""
    stem = F.regexp_replace("file", r"\.[^./]*$", "")
    parts = F.split(stem, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, i, F.size(parts))))
    cand = nodes.where(F.col("file").isNotNull()).select("symbol", "name", F.explode(suffixes).alias("module")).distinct()
    one = cand.groupBy("name", "module").agg(F.count("*").alias("n"), F.min("symbol").alias("target")).where(F.col("n") == 1)
    j = refs.select("ref_id", "from_symbol", F.col("raw_name").alias("name"), "module").join(one, ["name", "module"]).where(F.col("target") != F.col("from_symbol"))
    return j.select("ref_id", "target", F.lit(confidence).alias("confidence"), F.lit("import_map").alias("resolved_by"))


#: Probed after an import path that names no file itself (fixed values, in order).
PROBES = (".ts", ".js", ".py", ".rs", "/index.ts", "/index.js", "/__init__.py", "/mod.rs")


def normal_path(c: Column) -> Column:
    """A path with ``.`` and ``..`` segments worked off; null if it climbs above the root."""
    walk = F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), lambda acc, s: F.when((s == ".") | (s == ""), acc)
                       .when((s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..!"), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                       .when(s == "..", F.array(F.lit("..!"))).otherwise(F.concat(acc, F.array(s))))
    return F.when(~F.array_contains(walk, "..!"), F.concat_ws("/", walk))


def resolve_relative_import(refs: DataFrame, files: DataFrame, confidence: float = 0.9) -> DataFrame:
    """(ref_id, target, confidence, resolved_by) of ``./`` and ``../`` imports: the first probe that
    names a known file wins. A path that leaves the root stays open. ``files`` (path)."""
    r = refs.where(F.col("raw_name").rlike(r"^\.\.?/")).select("ref_id", normal_path(F.concat_ws("/", directory("file"), "raw_name")).alias("base"), F.col("raw_name").endswith("/").alias("slash"))
    literal = F.when(~F.col("slash"), F.col("base"))
    probes = F.array(literal, *(F.when(F.lit(p.startswith("/")) | ~F.col("slash"), F.concat("base", F.lit(p))) for p in PROBES))
    c = r.where(F.col("base").isNotNull()).select("ref_id", F.posexplode(probes).alias("ordinal", "path")).where(F.col("path").isNotNull())
    hit = c.join(files.select("path").distinct(), "path").groupBy("ref_id").agg(F.min(F.struct("ordinal", "path")).alias("h"))
    return hit.select("ref_id", F.col("h.path").alias("target"), F.lit(confidence).alias("confidence"), F.lit("relative_import").alias("resolved_by"))


def resolve_infra(refs: DataFrame, nodes: DataFrame, kind: str = "resource") -> DataFrame:
    """References to a name exactly one resource bears, if no code bears it or a resource refers."""
    g = nodes.where(F.col("name").isNotNull()).groupBy("name").agg(
        F.countDistinct(F.when(F.col("kind") == kind, F.col("symbol"))).alias("resources"), F.min(F.when(F.col("kind") == kind, F.col("symbol"))).alias("target"), F.count(F.when(F.col("kind") != kind, 1)).alias("code"))
    ok = g.where(F.col("resources") == 1)
    mine = nodes.where(F.col("kind") == kind).select(F.col("symbol").alias("from_symbol"), F.lit(True).alias("by_resource")).distinct()
    j = refs.join(ok, refs["raw_name"] == ok["name"]).where(F.col("target") != F.col("from_symbol")).join(mine, "from_symbol", "left")
    return j.where((F.col("code") == 0) | F.col("by_resource")).select("ref_id", "target", F.lit(1.0).alias("confidence"), F.lit("infra").alias("resolved_by"))


def resolve_rules_bridge(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References to a rules engine (``rules-engine:<name>``) bind to every rule set there is, each
    pair once, never to themselves: an equi-join on that both are what they are, rule sets broadcast
    while few."""
    marked = refs.where(F.col("raw_name").startswith("rules-engine:")).select("ref_id", "from_symbol", F.lit(1).alias("bridge"))
    sets = nodes.where(F.col("kind") == "rule_set").select(F.col("symbol").alias("target"), F.lit(1).alias("bridge")).distinct()
    j = marked.join(broadcast_if_small(sets), "bridge").where(F.col("target") != F.col("from_symbol"))
    return j.select("ref_id", "target").distinct().select("ref_id", "target", F.lit(0.5).alias("confidence"), F.lit("rules_bridge").alias("resolved_by"))


def resolve_dynamic_call(refs: DataFrame, nodes: DataFrame, languages: tuple[str, ...] = ("cobol", "hlasm", "pli")) -> DataFrame:
    """References ``dynamic:<name>``: the one module of a program language with that name, case
    aside; several leave it open, and so does the caller's own."""
    n = nodes.where((F.col("kind") == "module") & F.col("language").isin(*languages)).groupBy(F.lower("name").alias("key")).agg(F.countDistinct("symbol").alias("n"), F.min("symbol").alias("target")).where(F.col("n") == 1)
    r = refs.where(F.col("raw_name").startswith("dynamic:")).withColumn("key", F.lower(F.expr("substring(raw_name, 9)")))
    return r.join(n, "key").where(F.col("target") != F.col("from_symbol")).select("ref_id", "target", F.lit(0.5).alias("confidence"), F.lit("dynamic_call").alias("resolved_by"))


def resolve_component(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References ``<scope>|<type>|<slug>`` to components of an application: the one node of that
    name whose symbol starts with the scope and whose type (metadata) is the one named; typed ones
    are certain, without a type 0.5."""
    part = F.split("raw_name", r"\|")
    r = refs.where(F.size(part) == 3).select("ref_id", "from_symbol", part[0].alias("in_scope"), F.nullif(part[1], F.lit("")).alias("wanted"), part[2].alias("name"))
    n = nodes.select("symbol", "name", F.col("type").alias("has")).distinct()
    j = r.join(n, "name").where(F.expr("startswith(symbol, in_scope)") & (F.col("wanted").isNull() | (F.col("wanted") == F.col("has"))))
    one = j.groupBy("ref_id", "from_symbol", "wanted").agg(F.countDistinct("symbol").alias("n"), F.min("symbol").alias("target")).where((F.col("n") == 1) & (F.col("target") != F.col("from_symbol")))
    return one.select("ref_id", "target", F.when(F.col("wanted").isNotNull(), 1.0).otherwise(0.5).alias("confidence"), F.lit("component").alias("resolved_by"))


def rules_inventory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule_set, callers, grouped, ungrouped) of every rule set: who invokes it (sorted), its rules
    inside rule groups and those directly in it. ``contains`` counts in either direction."""
    sets = nodes.where(F.col("kind") == "rule_set").select(F.col("symbol").alias("rule_set")).distinct()
    called = edges.where(F.col("kind") == "invoked_by").groupBy(F.col("source").alias("rule_set")).agg(F.array_sort(F.collect_set("target")).alias("callers"))
    c = edges.where(F.col("kind") == "contains").select("source", "target")
    c = c.unionByName(c.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    kinds = nodes.select(F.col("symbol").alias("target"), F.col("kind").alias("k")).distinct()
    inside = c.join(kinds, "target")
    direct = sets.join(inside, F.col("source") == F.col("rule_set"))
    rules = direct.where(F.col("k") == "rule").select("rule_set", F.col("target").alias("rule"), F.lit(0).alias("grouped"))
    groups = direct.where(F.col("k") == "rule_group").select("rule_set", F.col("target").alias("g"))
    below = groups.join(inside.where(F.col("k") == "rule").select(F.col("source").alias("g"), F.col("target").alias("rule")), "g").select("rule_set", "rule", F.lit(1).alias("grouped"))
    n = rules.unionByName(below).groupBy("rule_set", "rule").agg(F.max("grouped").alias("grouped")).groupBy("rule_set").agg(F.sum("grouped").alias("grouped"), F.sum(1 - F.col("grouped")).alias("ungrouped"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return sets.join(called, "rule_set", "left").join(n, "rule_set", "left").select("rule_set", F.coalesce("callers", F.array().cast("array<string>")).alias("callers"), zero("grouped"), zero("ungrouped"))


def repo_identity(url: Column) -> Column:
    """host/owner/name of a repository's address, however it is written; lower case, no ``.git``."""
    c = F.regexp_replace(F.lower(F.trim(url)), r"^(?:git\+)?[a-z]+://(?:[^/@]*@)?|^[^/@:]+@", "")
    return F.regexp_replace(F.regexp_replace(c, r"^([^/:]+):(?:\d+/)?", "$1/"), r"(?:\.git)?/*(?:#.*)?$", "")


def package_identity(ecosystem: Column, name: Column) -> Column:
    """A package's name as its ecosystem compares it: Python folds case and runs of ``-_.``, Cargo
    takes ``_`` for ``-``, npm is exact."""
    return F.when(ecosystem == "python", F.regexp_replace(F.lower(name), "[-_.]+", "-")).when(ecosystem == "cargo", F.replace(name, F.lit("_"), F.lit("-"))).otherwise(name)


def link_repos(dependencies: DataFrame, packages: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, boundaries) between repositories by their dependency manifests.

    ``dependencies`` (repo, ecosystem, name, kind, source): kind path (source is a repository's name),
    git (its address) or registry. ``packages`` (repo, ecosystem, name) are what repositories
    provide; ``repos`` (repo, url). A dependency is a link (repo, ecosystem, name, target, kind) if
    exactly one other repository provides the package and, for path and git, is the one named. All
    others are boundaries with a reason: ``no_name``, ``unknown_ecosystem``, ``unknown_repository``,
    ``not_provided``, ``ambiguous``, ``other_provider``, ``itself``.
    """
    d = dependencies.distinct().withColumn("key", package_identity(F.col("ecosystem"), F.col("name")))
    p = packages.select("ecosystem", package_identity(F.col("ecosystem"), F.col("name")).alias("key"), F.col("repo").alias("provider")).distinct()
    one = p.groupBy("ecosystem", "key").agg(F.countDistinct("provider").alias("n"), F.min("provider").alias("provider"))
    known = repos.select(repo_identity(F.col("url")).alias("address"), F.col("repo").alias("by_address")).dropDuplicates(["address"])
    names = repos.select(F.col("repo").alias("by_name")).distinct()
    j = d.join(one, ["ecosystem", "key"], "left").withColumn("address", F.when(F.col("kind") == "git", repo_identity(F.col("source")))).join(known, "address", "left")
    j = j.join(names, F.when(F.col("kind") == "path", F.col("source")) == F.col("by_name"), "left")
    named = F.coalesce("by_address", "by_name")
    # a repository that is named must provide the package itself, whoever else does
    mine = p.select("ecosystem", "key", F.col("provider").alias("named")).withColumn("provides", F.lit(True))
    j = j.withColumn("named", named).join(mine, ["ecosystem", "key", "named"], "left")
    by_name = F.col("kind").isin("path", "git")
    target = F.when(by_name, F.col("named")).otherwise(F.col("provider"))
    reason = (F.when(F.col("name").isNull() | (F.trim("name") == ""), "no_name").when(~F.coalesce(F.col("ecosystem").isin("npm", "cargo", "python"), F.lit(False)), "unknown_ecosystem")
              .when(by_name & F.col("named").isNull(), "unknown_repository").when(F.col("n").isNull(), "not_provided").when(by_name & F.col("provides").isNull(), "other_provider")
              .when(~by_name & (F.col("n") > 1), "ambiguous").when(target == F.col("repo"), "itself"))
    j = j.withColumn("target", target).withColumn("reason", reason)
    cols = ["repo", "ecosystem", "name"]
    return j.where(F.col("reason").isNull()).select(*cols, "target", "kind").distinct(), j.where(F.col("reason").isNotNull()).select(*cols, "kind", "reason").distinct()


def edge_dedup_best(edges: DataFrame) -> DataFrame:
    """Per (source, target, kind) the highest confidence, the earliest ordinal on ties."""
    best = F.min(F.struct((-F.col("confidence")).alias("n"), F.col("ordinal"), F.col("resolved_by")))
    return edges.groupBy("source", "target", "kind").agg(best.alias("b"), F.count("*").alias("evidence_count")).select("source", "target", "kind", (-F.col("b.n")).alias("confidence"), "b.resolved_by", "evidence_count")


def edge_upsert_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new row wins if its confidence isn't lower or its evidence count is higher."""
    key = ["source", "target", "kind"]
    o = old.select(*key, F.struct("confidence", "evidence_count").alias("o"))
    n = new.select(*key, F.struct("confidence", "evidence_count").alias("w"))
    wins = F.col("o").isNull() | (F.col("w.confidence") >= F.col("o.confidence")) | (F.col("w.evidence_count") > F.col("o.evidence_count"))
    return o.join(n, key, "full_outer").select(*key, F.when(F.col("w").isNotNull() & wins, F.col("w")).otherwise(F.col("o")).alias("e")).select(*key, "e.confidence", "e.evidence_count")


def drift(declared: DataFrame, live: DataFrame) -> DataFrame:
    """(identity, status): managed in both, undeployed only declared, unmanaged only live. Names
    compare in lower case without ``[n]`` suffixes."""
    ident = lambda df, side: df.select(F.lower(F.regexp_replace("name", r"\[\d+\]$", "")).alias("identity")).where(F.col("identity").isNotNull()).distinct().withColumn(side, F.lit(True))
    j = ident(declared, "d").join(ident(live, "l"), "identity", "full_outer")
    return j.select("identity", F.when(F.col("d") & F.col("l"), "managed").when(F.col("d"), "undeployed").otherwise("unmanaged").alias("status"))


def glob_regex(glob: str) -> str:
    """``%`` is one character of a qualifier, ``*`` any of them, ``**`` any characters."""
    out = "".join({"**": ".*", "*": "[^.]*", "%": "[^.]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|\*|%|[^*%]+", glob))
    return f"^{out}$"


def resolve_glob(assets: DataFrame, profiles: DataFrame) -> DataFrame:
    """(asset, profile, confidence): each asset's most specific profile, exact 1.0, generic 0.5.

    Exact profiles are an equi-join. Generic ones are joined on the text before their first dot if
    that has no wildcard, and only those whose first part is generic itself meet all assets.
    """
    a = assets.select("asset").where(F.col("asset").isNotNull()).distinct().withColumn("q", F.substring_index("asset", ".", 1))
    p = profiles.select("profile").where(F.col("profile").isNotNull()).distinct()
    rx = F.regexp_replace(F.regexp_replace("profile", r"([.\\+?()\[\]{}^$|])", r"\\$1"), r"\*\*", "\x01")
    rx = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(rx, r"\*", "[^.]*"), "%", "[^.]"), "\x01", ".*"), F.lit("$"))
    p = p.select("profile", rx.alias("rx"), F.col("profile").rlike("[*%]").alias("generic"), F.substring_index("profile", ".", 1).alias("head"), F.struct(
        F.length(F.regexp_replace("profile", "[*%]", "")).alias("fixed"), (-F.size(F.split("profile", r"\*\*"))).alias("deep"), (-F.size(F.split("profile", r"\*"))).alias("wide")).alias("specific"))
    fixed = ~F.col("head").rlike("[*%]")
    by_head = a.join(p.where(fixed).withColumnRenamed("head", "q"), "q").where(F.expr("asset rlike rx")).select("asset", "profile", "generic", "specific")
    loose = a.join(broadcast_if_small(p.where(~fixed)), F.expr("asset rlike rx")).select("asset", "profile", "generic", "specific")
    best = by_head.unionByName(loose).groupBy("asset").agg(F.max(F.struct((~F.col("generic")).alias("exact"), "specific", "profile")).alias("b"))
    return best.select("asset", "b.profile", F.when(F.col("b.exact"), 1.0).otherwise(0.5).alias("confidence"))


def project_sites(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """(site_id, symbol): the one innermost node of the same file whose span holds the site.

    An equi-join on the file plus the span; ambiguity (two innermost of one size) leaves the site
    out, a site in no span falls to the file's node if there is one.
    """
    n = nodes.where((F.col("start_line") < F.col("end_line")) | (F.col("end_byte") > F.col("start_byte"))).select("file", "symbol", "kind", "start_byte", "end_byte").distinct()
    j = sites.join(n, "file").where((F.col("start_byte") <= F.col("at_byte")) & (F.col("at_byte") < F.col("end_byte")) & (F.col("kind") != "file"))
    w = Window.partitionBy("site_id")
    j = j.withColumn("size", F.col("end_byte") - F.col("start_byte")).withColumn("least", F.min("size").over(w)).where(F.col("size") == F.col("least"))
    inner = j.groupBy("site_id").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol"))
    files = n.where(F.col("kind") == "file").groupBy("file").agg(F.min("symbol").alias("file_symbol"))
    s = sites.join(inner, "site_id", "left").join(files, "file", "left")
    return s.select("site_id", F.when(F.col("n") == 1, F.col("symbol")).when(F.col("n").isNull(), F.col("file_symbol")).alias("symbol")).where(F.col("symbol").isNotNull())
