"""Queries of the graph, retrieval and memory operators over whole tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.functions.lineage import stored
from spandrel.functions.text import blank_to_null, plain_path
from spandrel.operators import graph as G
from spandrel.operators import lookup as L
from spandrel.operators import memory as M
from spandrel.operators import rank as K
from spandrel.operators import redaction as D
from spandrel.operators import resolve as R
from spandrel.operators import supports as S
from spandrel.operators import textsearch as T
from spandrel.sources.graph import GRAPH_SQL, graph_edges, graph_nodes
from spandrel.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NOW = 1_767_225_600  # the moment recall is asked at, seconds


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace({0}, '[\\/]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '')"
#: One row per symbol of the code graph, by the order the rows are preferred in.
_CODE = f"""c AS (SELECT symbol, name, kind, language, {_PLAIN.format('file')} AS file, scope, signature, doc, span, epoch, first_seen, removed_at,
 row_number() OVER (PARTITION BY symbol ORDER BY language IS NULL, language, {_PLAIN.format('file')}) AS rn FROM nodes),
code AS (SELECT * FROM c WHERE rn = 1)"""


def code_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per symbol: rows with a language first, then the least language and file."""
    n = table(spark, d, "nodes").withColumn("file", plain_path("file"))
    order = F.struct(F.col("language").isNull(), F.col("language"), F.col("file"))
    cols = ["name", "kind", "language", "file", "scope", "signature", "doc", "span", "epoch", "first_seen", "removed_at"]
    return n.groupBy("symbol").agg(F.min_by(F.struct(*cols), order).alias("n")).select("symbol", "n.*")


# ------------------------------------------------------------------ lookups


@query(f"WITH {_CODE} SELECT symbol, name, kind, language, file FROM code")
def scan_nodes(spark, d):
    return code_nodes(spark, d).select("symbol", "name", "kind", "language", "file")


@query(f"{GRAPH_SQL} SELECT source, target, kind, round(confidence, 6) AS confidence FROM e")
def scan_edges(spark, d):
    return graph_edges(spark, d).withColumn("confidence", F.round("confidence", 6))


@query("SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")
def scan_embeddings(spark, d):
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", "label")


@query(f"SELECT DISTINCT {_PLAIN.format('path')} AS path FROM files WHERE path IS NOT NULL")
def scan_files(spark, d):
    return table(spark, d, "files", "path").where(F.col("path").isNotNull()).select(plain_path("path").alias("path")).distinct()


@query(f"WITH {_CODE} SELECT symbol, name FROM code WHERE kind = 'function' AND language = 'python' AND (scope = 'repo:amber-ledger' OR starts_with(scope, 'repo:amber-ledger/'))")
def find_symbols(spark, d):
    return L.find_symbols(code_nodes(spark, d), kinds=["function"], language="python", scope="repo:amber-ledger").select("symbol", "name")


@query(f"WITH {_CODE} SELECT count(*) AS n FROM code WHERE kind = 'method'")
def count_symbols(spark, d):
    return L.find_symbols(code_nodes(spark, d), kinds=["method"]).agg(F.count("*").alias("n"))


@query(f"WITH {_CODE} SELECT symbol, name FROM code WHERE starts_with(lower(name), 'update') ORDER BY lower(name), name, symbol LIMIT 20")
def name_prefix(spark, d):
    return L.name_prefix(code_nodes(spark, d), "UPDATE").select("symbol", "name")


@query(f"WITH {_CODE} SELECT file, count(*) AS n, count(*) FILTER (kind = 'function') AS functions FROM code WHERE kind <> 'file' GROUP BY 1")
def nodes_in_file(spark, d):
    return code_nodes(spark, d).where(F.col("kind") != "file").groupBy("file").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "function", 1)).alias("functions"))


@query(f"WITH {_CODE} SELECT kind, coalesce(language, '') AS language, count(*) AS n, count(*) FILTER (removed_at IS NULL) AS live FROM code GROUP BY ALL")
def graph_stats(spark, d):
    return code_nodes(spark, d).groupBy("kind", F.coalesce("language", F.lit("")).alias("language")).agg(F.count("*").alias("n"), F.count(F.when(F.col("removed_at").isNull(), 1)).alias("live"))


@query(f"""WITH {_CODE}, w AS (SELECT {_PLAIN.format('path')} AS path, git_sha, row_number() OVER (PARTITION BY {_PLAIN.format('path')} ORDER BY observed_at DESC, arrived_at DESC, obs_id DESC) AS r FROM files WHERE git_sha IS NOT NULL)
SELECT code.symbol, CASE WHEN span.end_byte > span.start_byte AND span.end_byte <= octet_length(encode(blob)) THEN md5(encode(blob)[span.start_byte + 1 : span.end_byte]) END AS source_md5
FROM code JOIN w ON w.path = code.file AND w.r = 1 JOIN file_content USING (git_sha)""")
def symbol_source(spark, d):
    """Source of every symbol in the latest stored version of its file, as a digest."""
    f = table(spark, d, "files").withColumn("path", plain_path("path")).where(F.col("git_sha").isNotNull())
    latest = f.groupBy("path").agg(F.max(F.struct("observed_at", "arrived_at", "obs_id", "git_sha")).alias("m")).select(F.col("path").alias("file"), F.col("m.git_sha").alias("key"))
    n = code_nodes(spark, d).select("symbol", "file", "span.start_byte", "span.end_byte").join(latest, "file")
    texts = table(spark, d, "file_content").withColumnRenamed("git_sha", "key")
    return L.symbol_source(n, texts).select("symbol", F.md5("source").alias("source_md5"))


@query("SELECT git_sha, git_sha AS computed FROM file_content")
def git_blob_sha(spark, d):
    """The identifier computed from the text is the one it is stored under."""
    return table(spark, d, "file_content").select("git_sha", L.git_blob_sha("blob").alias("computed"))


@query(f"WITH {_CODE} SELECT symbol, md5(concat_ws('|', symbol, name, kind, file, coalesce(signature, ''))) AS fingerprint FROM code")
def node_fingerprint(spark, d):
    return code_nodes(spark, d).select("symbol", F.md5(F.concat_ws("|", "symbol", "name", "kind", "file", F.coalesce("signature", F.lit("")))).alias("fingerprint"))


@query(f"""WITH {_CODE}, f AS (SELECT {_PLAIN.format('path')} AS file, max(observed_at) AS seen FROM files GROUP BY 1)
SELECT symbol FROM code SEMI JOIN (SELECT file FROM f WHERE seen >= TIMESTAMP '2025-02-01') USING (file)""")
def changed_since(spark, d):
    f = table(spark, d, "files", "path", "observed_at").groupBy(plain_path("path").alias("file")).agg(F.max("observed_at").alias("seen"))
    return code_nodes(spark, d).join(f.where("seen >= timestamp_ntz'2025-02-01'"), "file", "left_semi").select("symbol")


@query(f"""WITH {_CODE} SELECT symbol FROM code WHERE NOT regexp_matches(file, '(?i)(^|/)(vendor|node_modules|third_party|external)/') AND NOT regexp_matches(file, '(^|/)tests?/')""")
def display_filters(spark, d):
    n = code_nodes(spark, d)
    return n.where(~F.col("file").rlike("(?i)(^|/)(vendor|node_modules|third_party|external)/") & ~F.col("file").rlike("(^|/)tests?/")).select("symbol")


@query("SELECT node_id FROM knowledge_nodes WHERE starts_with(scope, 'source:') AND tombstoned_at IS NULL GROUP BY 1")
def scope_kind_wildcard(spark, d):
    k = table(spark, d, "knowledge_nodes")
    return k.where(L.scope_kind("scope", "source:") & F.col("tombstoned_at").isNull()).select("node_id").distinct()


@query("SELECT class_name, scope, count(DISTINCT node_id) AS n FROM knowledge_nodes GROUP BY ALL")
def knowledge_count(spark, d):
    return table(spark, d, "knowledge_nodes").groupBy("class_name", "scope").agg(F.countDistinct("node_id").alias("n"))


_RULES_SQL = """WITH r AS (SELECT doc_id AS id, CASE doc_kind WHEN 'adr' THEN 'critical' WHEN 'runbook' THEN 'high' WHEN 'rule_note' THEN 'medium' ELSE 'low' END AS severity,
 n_chars AS weight, lower(lang) AS language, source AS layer FROM documents)"""


@query(f"""{_RULES_SQL} SELECT id, severity FROM r WHERE (language IS NULL OR language = 'de') ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, weight DESC NULLS LAST, id LIMIT 100""")
def rules_recall(spark, d):
    doc = table(spark, d, "documents", "doc_id", "doc_kind", "n_chars", "lang", "source")
    sev = F.when(F.col("doc_kind") == "adr", "critical").when(F.col("doc_kind") == "runbook", "high").when(F.col("doc_kind") == "rule_note", "medium").otherwise("low")
    rules = doc.select(F.col("doc_id").alias("id"), sev.alias("severity"), F.col("n_chars").alias("weight"), F.lower("lang").alias("language"), F.lit(False).alias("retired"), F.lit(None).cast("string").alias("effect"), F.lit(None).cast("array<string>").alias("projects"))
    return L.rules_recall(rules, {"language": "de"}).select("id", "severity")


@query("""WITH x AS (SELECT edge_id, from_json(json_extract(meta, '$.deps'), '["VARCHAR"]') AS deps FROM typed_xedges)
SELECT edge_id FROM x WHERE len(list_filter(coalesce(deps, []), lambda t: t NOT IN ('repo:umber-furrow', 'repo:jolly-anvil', 'repo:lunar-compass'))) = 0""")
def visible_filter(spark, d):
    deps = F.from_json(F.get_json_object("meta", "$.deps"), "array<string>")
    return table(spark, d, "typed_xedges", "edge_id", "meta").where(L.visible(deps, ["repo:umber-furrow", "repo:jolly-anvil", "repo:lunar-compass"])).select("edge_id")


@query("SELECT rel, owner, count(*) AS n, round(min(confidence), 6) AS least, round(avg(confidence), 6) AS mean FROM typed_xedges GROUP BY ALL")
def typed_xedges(spark, d):
    return table(spark, d, "typed_xedges").groupBy("rel", "owner").agg(F.count("*").alias("n"), F.round(F.min("confidence"), 6).alias("least"), F.round(F.avg("confidence"), 6).alias("mean"))


@query("""SELECT x.edge_id, k.node_id FROM typed_xedges x JOIN (SELECT DISTINCT node_id, epoch FROM knowledge_nodes WHERE tombstoned_at IS NULL) k ON x.src_store = 'knowledge' AND x.src_id = k.node_id AND x.src_epoch = k.epoch""")
def xedge_join(spark, d):
    k = table(spark, d, "knowledge_nodes").where(F.col("tombstoned_at").isNull()).select("node_id", "epoch").distinct()
    x = table(spark, d, "typed_xedges", "edge_id", "src_store", "src_id", "src_epoch").where(F.col("src_store") == "knowledge")
    return x.join(k, (F.col("src_id") == F.col("node_id")) & (F.col("src_epoch") == F.col("epoch"))).select("edge_id", "node_id")


# ------------------------------------------------------------------ aggregations


@query(f"{GRAPH_SQL} SELECT kind, count(*) AS n, round(min(confidence), 6) AS least, round(avg(confidence), 6) AS mean FROM e GROUP BY kind")
def confidence_summary(spark, d):
    return graph_edges(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.min("confidence"), 6).alias("least"), F.round(F.avg("confidence"), 6).alias("mean"))


@query(f"""{GRAPH_SQL} SELECT kind, count(*) FILTER (confidence = 1.0) AS exact_n, count(*) FILTER (confidence >= 0.8 AND confidence < 1.0) AS high_n,
 count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium_n, count(*) FILTER (confidence < 0.5) AS low_n FROM e GROUP BY kind""")
def confidence_bands(spark, d):
    c, n = F.col("confidence"), lambda x, a: F.count(F.when(x, 1)).alias(a)
    return graph_edges(spark, d).groupBy("kind").agg(n(c == 1, "exact_n"), n((c >= 0.8) & (c < 1), "high_n"), n((c >= 0.5) & (c < 0.8), "medium_n"), n(c < 0.5, "low_n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def access_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("sessions"))


@query("""SELECT props->>'$.k' AS query, count(*) AS misses, max(ts) AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY misses DESC, last_seen DESC, query LIMIT 50""")
def miss_report(spark, d):
    e = table(spark, d, "events").where(F.col("event_type") == "error").groupBy(F.get_json_object("props", "$.k").alias("query")).agg(F.count("*").alias("misses"), F.max("ts").alias("last_seen"))
    return e.orderBy(F.desc("misses"), F.desc("last_seen"), "query").limit(50)


@query(f"""WITH f AS (SELECT symbol, {_PLAIN.format('file')} AS file, max(coalesce(is_def, 0)) AS d FROM node_files WHERE symbol IS NOT NULL AND file IS NOT NULL GROUP BY 1, 2)
SELECT symbol, file FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC, file) AS rn FROM f) WHERE rn = 1""")
def node_preferred(spark, d):
    """Definition first, then the least file; a fold, so a symbol with a third of the rows is cheap."""
    n = table(spark, d, "node_files", "symbol", "file", "is_def").select("symbol", plain_path("file").alias("file"), F.coalesce("is_def", F.lit(0)).alias("d")).where("symbol is not null and file is not null")
    return n.groupBy("symbol").agg(F.min(F.struct((-F.col("d")).alias("nd"), "file")).alias("m")).select("symbol", "m.file")


@query(f"""{GRAPH_SQL}, a AS (SELECT symbol, kind AS c FROM n), l AS (SELECT x.c AS cs, y.c AS ct FROM e JOIN a x ON x.symbol = e.source JOIN a y ON y.symbol = e.target WHERE source <> target),
m AS (SELECT count(*)::DOUBLE AS m FROM l), g AS (SELECT c, count(*) AS d FROM (SELECT cs AS c FROM l UNION ALL SELECT ct FROM l) GROUP BY 1), i AS (SELECT cs AS c, count(*) AS l FROM l WHERE cs = ct GROUP BY 1)
SELECT round(sum(coalesce(i.l, 0) / m - (d / (2 * m)) * (d / (2 * m))), 6) AS q FROM g LEFT JOIN i USING (c), m""")
def modularity(spark, d):
    n = graph_nodes(spark, d).select("symbol", F.col("kind").alias("community"))
    return K.modularity(graph_edges(spark, d), n).select(F.round("q", 6).alias("q"))


@query("SELECT doc_kind, round(median(n_chars), 3) AS p50 FROM documents GROUP BY 1")
def p50(spark, d):
    return table(spark, d, "documents", "doc_kind", "n_chars").groupBy("doc_kind").agg(F.round(F.median("n_chars"), 3).alias("p50"))


@query(f"{GRAPH_SQL}, r AS (SELECT file, kind, count(*) AS n FROM n GROUP BY ALL) SELECT file, sum(n)::BIGINT AS n FROM r GROUP BY 1 ORDER BY n DESC, file LIMIT 10")
def top_files(spark, d):
    return graph_nodes(spark, d).groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(10)


@query(f"""{GRAPH_SQL}, s AS (SELECT source, target, kind, confidence, 'f' || (hash % 3) AS fact_id, 1 + (hash % 4) AS evidence_count FROM (SELECT *, length(source || target) AS hash FROM e))
SELECT source, target, kind, round(confidence, 6) AS confidence, evidence_count::BIGINT AS evidence_count, fact_id FROM s""")
def support_project(spark, d):
    h = F.length(F.concat("source", "target"))
    s = graph_edges(spark, d).withColumn("fact_id", F.concat(F.lit("f"), h % 3)).withColumn("evidence_count", (1 + h % 4).cast("bigint"))
    return S.support_project(s.unionByName(s.withColumn("confidence", F.col("confidence") - 0.1))).withColumn("confidence", F.round("confidence", 6))


# ------------------------------------------------------------------ walks

_WALK = GRAPH_SQL + """, w AS (SELECT '{seed}' AS symbol, 0 AS depth UNION SELECT {there}, depth + 1 FROM w JOIN e ON {here} = w.symbol WHERE depth < {most} {extra}),
reached AS (SELECT symbol, min(depth) AS depth FROM w GROUP BY 1)"""


def _seed(spark: SparkSession, symbol: str) -> DataFrame:
    return spark.createDataFrame([(symbol,)], "symbol string")


def _walk(seed: str, direction: str, most: int, extra: str = "") -> str:
    here, there = ("target", "source") if direction == "in" else ("source", "target")
    return _WALK.format(seed=seed, here=here, there=there, most=most, extra=extra)


@query(_walk("nation/3", "in", 3) + " SELECT symbol, depth FROM reached WHERE depth > 0")
def traverse(spark, d):
    return G.traverse(graph_edges(spark, d), _seed(spark, "nation/3"), "in", 3)


@query(GRAPH_SQL + """, w AS (SELECT symbol, 0 AS depth FROM n WHERE kind = 'module' UNION SELECT source, depth + 1 FROM w JOIN e ON target = w.symbol WHERE depth < 2 AND confidence >= 0.8)
SELECT symbol, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def traverse_multi(spark, d):
    seeds = graph_nodes(spark, d).where(F.col("kind") == "module").select("symbol")
    return G.traverse(graph_edges(spark, d), seeds, "in", 2, min_confidence=0.8)


@query(_walk("order/1", "out", 4, "AND kind IN ('calls', 'imports')") + " SELECT symbol, depth FROM reached WHERE depth > 0")
def lineage(spark, d):
    return G.traverse(graph_edges(spark, d), _seed(spark, "order/1"), "out", 4, kinds=["calls", "imports"])


@query(_walk("supplier/1", "in", 3) + """ SELECT r.symbol, r.depth FROM reached r LEFT JOIN n USING (symbol) WHERE depth > 0 AND coalesce(n.kind, '') <> 'file' ORDER BY depth, symbol LIMIT 5000""")
def blast_radius(spark, d):
    e = graph_edges(spark, d)
    reached = G.code_dependents(G.traverse(e, _seed(spark, "supplier/1"), "in", 3), e, graph_nodes(spark, d))
    return G.cap_by_depth(reached, 5000)


@query(_walk("nation/3", "in", 2) + """ SELECT symbol, via_target, via_kind, rn, omitted FROM (
 SELECT e.source AS symbol, e.target AS via_target, e.kind AS via_kind, row_number() OVER (PARTITION BY e.source ORDER BY e.target, e.kind) AS rn, greatest(count(*) OVER (PARTITION BY e.source) - 3, 0) AS omitted
 FROM e JOIN reached b ON b.symbol = e.source JOIN reached a ON a.symbol = e.target WHERE a.depth = b.depth - 1) WHERE rn <= 3""")
def predecessor_via(spark, d):
    e = graph_edges(spark, d)
    return G.predecessor_via(e, G.traverse(e, _seed(spark, "nation/3"), "in", 2, keep_seeds=True))


@query(_walk("nation/3", "in", 2) + " SELECT count(*) > 0 AS cut_off FROM e JOIN reached a ON a.symbol = e.target AND a.depth = 2 ANTI JOIN reached b ON b.symbol = e.source")
def depth_horizon(spark, d):
    e = graph_edges(spark, d)
    return G.depth_horizon(e, G.traverse(e, _seed(spark, "nation/3"), "in", 2, keep_seeds=True), 2)


@query(_walk("nation/3", "in", 2) + " SELECT e.source, e.target, e.kind FROM e JOIN reached a ON a.symbol = e.source JOIN reached b ON b.symbol = e.target")
def induced_edges(spark, d):
    e = graph_edges(spark, d)
    return G.induced_edges(e, G.traverse(e, _seed(spark, "nation/3"), "in", 2, keep_seeds=True)).select("source", "target", "kind")


@query(_walk("order/1", "out", 8) + " SELECT min(depth)::BIGINT AS hops FROM reached JOIN n USING (symbol) WHERE n.kind = 'namespace'")
def path_between(spark, d):
    goals = graph_nodes(spark, d).where(F.col("kind") == "namespace").select("symbol")
    return G.shortest_path(graph_edges(spark, d), _seed(spark, "order/1"), goals).agg(F.count("*").alias("hops"))


@query(f"{GRAPH_SQL} SELECT source, target, kind FROM e WHERE source = 'nation/3' OR target = 'nation/3'")
def neighbors(spark, d):
    return G.neighbors(graph_edges(spark, d), _seed(spark, "nation/3")).select("source", "target", "kind")


for _name, _in, _out in (("entrypoints", True, False), ("leaves", False, True), ("isolated", True, True)):
    _ends = [c for w, c in ((_in, "target"), (_out, "source")) if w]

    def _shape(spark, d, incoming=_in, outgoing=_out):
        return G.without_edges(graph_nodes(spark, d), graph_edges(spark, d), incoming=incoming, outgoing=outgoing).select("symbol")

    QUERIES[_name] = _shape
    ORACLE[_name] = f"{GRAPH_SQL}, x AS MATERIALIZED (" + " UNION ".join(f"SELECT {c} AS symbol FROM e WHERE kind IN ('calls', 'imports')" for c in _ends) + ") SELECT symbol FROM n ANTI JOIN x USING (symbol)"


@query(f"{GRAPH_SQL}, k AS (SELECT symbol FROM n WHERE kind <> 'struct') SELECT source, target, kind FROM e WHERE source IN (SELECT symbol FROM k) AND target IN (SELECT symbol FROM k)")
def prune_dangling(spark, d):
    """Edges left when all nodes of one kind are gone."""
    return G.prune_dangling(graph_edges(spark, d), graph_nodes(spark, d).where(F.col("kind") != "struct")).select("source", "target", "kind")


@query("""WITH RECURSIVE x AS (SELECT src_id AS a, tgt_id AS b FROM typed_xedges WHERE src_store = 'knowledge' AND tgt_store = 'knowledge' UNION SELECT tgt_id, src_id FROM typed_xedges WHERE src_store = 'knowledge' AND tgt_store = 'knowledge'),
s AS (SELECT min(node_id) AS s FROM knowledge_nodes WHERE class_name = 'concept'), w AS (SELECT s AS symbol, 0 AS depth FROM s UNION SELECT b, depth + 1 FROM w JOIN x ON a = symbol WHERE depth < 3)
SELECT symbol, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def knowledge_neighbors(spark, d):
    x = table(spark, d, "typed_xedges").where("src_store = 'knowledge' and tgt_store = 'knowledge'").select(F.col("src_id").alias("source"), F.col("tgt_id").alias("target"), F.col("rel").alias("kind"), "confidence")
    both = x.unionByName(x.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind", "confidence"))
    seed = table(spark, d, "knowledge_nodes").where(F.col("class_name") == "concept").agg(F.min("node_id").alias("symbol"))
    return G.traverse(both, seed, "out", 3)


# ------------------------------------------------------------------ ranking and clusters

_STEPS = 30  # the most the operator takes; on the tables' graph the change stays above its epsilon until then


def _pagerank_sql() -> str:
    s = GRAPH_SQL.replace("WITH RECURSIVE", "WITH") + """, l AS (SELECT source, target FROM e WHERE source <> target), o AS (SELECT source, count(*) AS out FROM l GROUP BY 1), c AS (SELECT count(*)::DOUBLE AS c FROM n),
b AS (SELECT symbol, 1 / c AS t, out FROM n CROSS JOIN c LEFT JOIN o ON o.source = n.symbol), r0 AS (SELECT symbol, t AS r FROM b)"""
    for i in range(_STEPS):
        s += f""", d{i} AS (SELECT coalesce(sum(r), 0) AS d FROM r{i} JOIN b USING (symbol) WHERE out IS NULL),
g{i} AS (SELECT l.target AS symbol, sum(r / out) AS g FROM l JOIN r{i} ON r{i}.symbol = l.source JOIN b ON b.symbol = l.source GROUP BY 1),
r{i + 1} AS MATERIALIZED (SELECT b.symbol, (0.15 + 0.85 * d) * t + 0.85 * coalesce(g, 0) AS r FROM b CROSS JOIN d{i} LEFT JOIN g{i} ON g{i}.symbol = b.symbol)"""
    return s + f" SELECT symbol, round(r * c, 4) AS score FROM r{_STEPS} CROSS JOIN c"


@query(_pagerank_sql())
def pagerank(spark, d):
    n = graph_nodes(spark, d)
    return _scaled(K.pagerank(n, graph_edges(spark, d)), n)


def _scaled(p: DataFrame, n: DataFrame) -> DataFrame:
    """Scores times the number of nodes, a figure that doesn't shrink with the graph."""
    return p.select("symbol", F.round(F.col("score") * F.lit(float(n.count())), 4).alias("score"))


@query()
def pagerank_personalized(spark, d):
    n = graph_nodes(spark, d)
    return _scaled(K.pagerank(n, graph_edges(spark, d), seeds=_seed(spark, "nation/3")), n)


@query()
def hotspots(spark, d):
    n = graph_nodes(spark, d)
    p = K.pagerank(n, graph_edges(spark, d))
    shown = p.join(n.where(~F.col("kind").isin("file", "import")).select("symbol", "name"), "symbol")
    return shown.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "symbol").limit(20)


@query()
def communities(spark, d):
    return K.label_communities(graph_nodes(spark, d), graph_edges(spark, d))


@query(GRAPH_SQL + """, u AS (SELECT symbol AS a, symbol AS b FROM n UNION SELECT source, target FROM e UNION SELECT target, source FROM e),
m AS (SELECT symbol, symbol AS c FROM n WHERE kind = 'namespace' UNION SELECT u.b, m.c FROM m JOIN u ON u.a = m.symbol), g AS (SELECT symbol, min(c) AS c FROM m GROUP BY 1)
SELECT symbol, min(symbol) OVER (PARTITION BY g.c) AS component FROM n JOIN g USING (symbol)""")
def connected_components(spark, d):
    e = graph_edges(spark, d)
    alone = graph_nodes(spark, d).select(F.col("symbol").alias("source"), F.col("symbol").alias("target"))
    return K.connected_components(e.select("source", "target").unionByName(alone))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 6) AS score, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS raw FROM q, embeddings)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vector_nearest(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id")
    return K.vector_nearest(v, q).withColumn("score", F.round("score", 6))


@query()
def kmeans_cosine(spark, d):
    return K.kmeans_cosine(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k=16, iterations=50)


@query()
def dbscan_cosine(spark, d):
    return K.dbscan_cosine(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), eps=0.75)


# ------------------------------------------------------------------ resolvers

_REFS = f"{_CODE}, r AS (SELECT symbol AS ref_id, symbol AS from_symbol, name AS raw_name, file, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir FROM code WHERE kind <> 'file')"


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """Every function refers to its own name, which others bear too: homonyms in the wild."""
    return code_nodes(spark, d).where(F.col("kind") != "file").select(F.col("symbol").alias("ref_id"), F.col("symbol").alias("from_symbol"), F.col("name").alias("raw_name"), "file")


@query(f"""WITH {_CODE}, u AS (SELECT name, min(symbol) AS target FROM code GROUP BY 1 HAVING count(DISTINCT symbol) = 1)
SELECT 'x:' || code.symbol AS ref_id, target, 0.6::DOUBLE AS confidence FROM code JOIN u USING (name) WHERE kind <> 'file'""")
def resolve_name(spark, d):
    refs = _refs(spark, d).withColumn("ref_id", F.concat(F.lit("x:"), "ref_id")).withColumn("from_symbol", F.col("ref_id"))
    return R.resolve_name(refs, code_nodes(spark, d)).select("ref_id", "target", "confidence")


@query(f"""WITH {_REFS}, k AS (SELECT symbol, name, file, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir FROM code),
p AS (SELECT r.ref_id, k.symbol AS target, CASE WHEN k.file = r.file THEN 0 WHEN k.dir = r.dir THEN 1 ELSE 2 END AS tier FROM r JOIN k ON k.name = r.raw_name AND k.symbol <> r.from_symbol),
b AS (SELECT ref_id, min(tier) AS tier FROM p GROUP BY 1)
SELECT ref_id, min(target) AS target, CASE tier WHEN 0 THEN 0.65 WHEN 1 THEN 0.62 ELSE 0.60 END::DOUBLE AS confidence FROM p JOIN b USING (ref_id, tier) GROUP BY ref_id, tier HAVING count(DISTINCT target) = 1""")
def resolve_scoped(spark, d):
    return R.resolve_scoped(_refs(spark, d), code_nodes(spark, d)).select("ref_id", "target", "confidence")


@query(f"""WITH {_REFS}, k AS (SELECT symbol, name, regexp_replace(file, '\\.[^./]*$', '') AS stem FROM code),
q AS (SELECT ref_id, raw_name, regexp_extract(file, '([^/]+/[^/]+)\\.[^./]*$', 1) AS module FROM r),
p AS (SELECT q.ref_id, k.symbol AS target FROM q JOIN k ON k.name = q.raw_name AND (k.stem = module OR ends_with(k.stem, '/' || module)) WHERE module <> '')
SELECT ref_id, min(target) AS target FROM p GROUP BY 1 HAVING count(DISTINCT target) = 1""")
def resolve_import_map(spark, d):
    refs = _refs(spark, d).withColumn("module", F.regexp_extract("file", r"([^/]+/[^/]+)\.[^./]*$", 1)).withColumn("from_symbol", F.lit("caller"))
    return R.resolve_import_map(refs.where(F.col("module") != ""), code_nodes(spark, d)).select("ref_id", "target")


@query("""WITH b AS (SELECT DISTINCT trim(symbol) AS s FROM node_files WHERE symbol IS NOT NULL), l AS (SELECT DISTINCT symbol AS s FROM nodes WHERE removed_at IS NULL)
SELECT lower(regexp_replace(coalesce(b.s, l.s), '\\[\\d+\\]$', '')) AS identity, CASE WHEN b.s IS NULL THEN 'unmanaged' WHEN l.s IS NULL THEN 'undeployed' ELSE 'managed' END AS status
FROM b FULL JOIN l ON lower(regexp_replace(b.s, '\\[\\d+\\]$', '')) = lower(regexp_replace(l.s, '\\[\\d+\\]$', ''))""")
def drift(spark, d):
    declared = table(spark, d, "node_files", "symbol").select(F.trim("symbol").alias("name"))
    return R.drift(declared, table(spark, d, "nodes", "symbol", "removed_at").where(F.col("removed_at").isNull()).select(F.col("symbol").alias("name")))


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, round(1 - l_discount, 2) AS c FROM lineitem)
SELECT 'order/' || l_orderkey AS source, 'part/' || l_partkey AS target, 'calls' AS kind, round(max(c), 6) AS confidence, count(*) AS evidence_count FROM x GROUP BY l_orderkey, l_partkey""")
def edge_dedup_best(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_discount")
    e = li.select(F.concat(F.lit("order/"), "l_orderkey").alias("source"), F.concat(F.lit("part/"), "l_partkey").alias("target"), F.lit("calls").alias("kind"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
                  F.col("l_linenumber").alias("ordinal"), F.lit("scoped").alias("resolved_by"))
    return R.edge_dedup_best(e).select("source", "target", "kind", F.round("confidence", 6).alias("confidence"), "evidence_count")


_PROFILES = ("repo.**", "repo.*.src.**", "repo.amber-ledger.**", "repo.amber-ledger.src.core.*.*")


@query(f"""WITH a AS (SELECT DISTINCT 'repo.' || replace({_PLAIN.format('path')}, '/', '.') AS asset FROM files WHERE path IS NOT NULL),
p(profile, rx, specific) AS (VALUES ('repo.**', '^repo\\..*$', 5), ('repo.*.src.**', '^repo\\.[^.]*\\.src\\..*$', 10), ('repo.amber-ledger.**', '^repo\\.amber-ledger\\..*$', 18), ('repo.amber-ledger.src.core.*.*', '^repo\\.amber-ledger\\.src\\.core\\.[^.]*\\.[^.]*$', 28))
SELECT asset, profile, 0.5::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY specific DESC, profile DESC) AS rn FROM a JOIN p ON regexp_matches(asset, rx)) WHERE rn = 1""")
def resolve_glob(spark, d):
    assets = table(spark, d, "files", "path").where(F.col("path").isNotNull()).select(F.concat(F.lit("repo."), F.translate(plain_path("path"), "/", ".")).alias("asset"))
    return R.resolve_glob(assets, spark.createDataFrame([(p,) for p in _PROFILES], "profile string"))


@query(f"""WITH {_CODE}, s AS (SELECT edge_id AS site_id, tgt_id, 40 + edge_id % 2000 AS at_byte FROM typed_xedges WHERE tgt_store = 'estate'),
t AS (SELECT site_id, file, at_byte FROM s JOIN code ON code.symbol = s.tgt_id),
n AS (SELECT DISTINCT {_PLAIN.format('file')} AS file, symbol, kind, span.start_byte AS a, span.end_byte AS b FROM nodes WHERE span.start_line < span.end_line OR span.end_byte > span.start_byte),
j AS (SELECT site_id, symbol, b - a AS size, min(b - a) OVER (PARTITION BY site_id) AS least FROM t JOIN n USING (file) WHERE a <= at_byte AND at_byte < b AND kind <> 'file'),
i AS (SELECT site_id, count(*) AS n, min(symbol) AS symbol FROM j WHERE size = least GROUP BY 1), f AS (SELECT file, min(symbol) AS fs FROM n WHERE kind = 'file' GROUP BY 1)
SELECT site_id, symbol FROM (SELECT t.site_id, CASE WHEN i.n = 1 THEN i.symbol WHEN i.n IS NULL THEN fs END AS symbol FROM t LEFT JOIN i USING (site_id) LEFT JOIN f USING (file)) WHERE symbol IS NOT NULL""")
def project_evidence(spark, d):
    code = code_nodes(spark, d).select(F.col("symbol").alias("tgt_id"), "file")
    x = table(spark, d, "typed_xedges", "edge_id", "tgt_store", "tgt_id").where(F.col("tgt_store") == "estate")
    sites = x.join(code, "tgt_id").select(F.col("edge_id").alias("site_id"), "file", (40 + F.col("edge_id") % 2000).alias("at_byte"))
    n = table(spark, d, "nodes").select(plain_path("file").alias("file"), "symbol", "kind", "span.start_byte", "span.end_byte", "span.start_line", "span.end_line")
    return R.project_sites(sites, n)


# ------------------------------------------------------------------ text

_IDX = """t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL),
ix AS (SELECT id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY id) AS len FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM ix GROUP BY 1),
q AS (SELECT id AS query_id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY df, term) AS r FROM ix JOIN df USING (term) WHERE id % 50 = 0) WHERE r <= 8)"""


def _search(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    index = stored(T.postings(docs))
    return T.bm25(index, T.rarest_terms(index, docs.where(F.col("id") % 50 == 0).select("id")), k)


@query(f"""WITH {_IDX}, st AS (SELECT count(DISTINCT id) AS n, (SELECT avg(len) FROM (SELECT DISTINCT id, len FROM ix)) AS al FROM ix)
SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
 SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM q JOIN ix USING (term) JOIN df USING (term), st GROUP BY 1, 2)) WHERE rank <= 10""")
def fts_bm25(spark, d):
    return _search(spark, d)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'token budget')")
def fts_substring(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where(F.lower("text").contains("token budget")).select("doc_id")


@query()
def hybrid_search(spark, d):
    """BM25 and hashed-embedding neighbours fused by reciprocal rank."""
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), T.hash_embedding("text").alias("v"))
    near = K.vector_nearest(docs, docs.where(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id"))
    return T.rrf([_search(spark, d).select("query_id", "id", "rank"), near.select("query_id", "id", "rank")])


@query("""WITH a AS (SELECT event_id, ts, event_type, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r1, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r2 FROM events)
SELECT query_id, id, score, rank FROM (SELECT user_id AS query_id, event_id AS id, round(1 / (60 + r1) + 1 / (60 + r2), 9) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(1 / (60 + r1) + 1 / (60 + r2), 9) DESC, event_id) AS rank FROM a) WHERE rank <= 10""")
def rrf(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "value", "ts")
    ranked = lambda c: e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(c), "event_id")).alias("rank"))
    return T.rrf([ranked("value"), ranked("ts")])


@query()
def fuzzy_candidates(spark, d):
    """Every name against every name; SQL would need all pairs, so tests compare with brute force."""
    n = code_nodes(spark, d)
    return T.fuzzy_candidates(n.select("name"), n.select(F.col("name").alias("probe"))).withColumn("score", F.round("score", 6))


@query()
def name_suggest(spark, d):
    """Suggestions for every name in capitals and for every name with two letters swapped."""
    n = code_nodes(spark, d).where(F.col("kind") != "file")
    swapped = F.concat(F.substring("name", 1, 3), F.substring("name", 5, 1), F.substring("name", 4, 1), F.expr("substring(name, 6)"))
    probes = n.select(F.upper("name").alias("probe")).unionByName(n.where(F.length("name") >= 6).select(swapped.alias("probe"))).distinct()
    return T.name_suggest(n, probes)


@query()
def redact_token_shapes(spark, d):
    t = table(spark, d, "documents", "doc_id", "text")
    clean = t.select("doc_id", D.column(D.redact_shapes, "text").alias("t"))
    return clean.select("doc_id", F.md5("t").alias("clean"), F.length("t").alias("n"))


@query()
def chunk_markdown(spark, d):
    return T.chunks(table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text"))


@query("SELECT doc_id, round(coalesce(-list_sum([x.c / n * log2(x.c / n) FOR x IN cs]), 0), 6) AS entropy FROM (SELECT doc_id, list({'c': c}) AS cs, sum(c) AS n FROM (SELECT doc_id, ch, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY 1, 2) GROUP BY 1)")
def shannon_entropy(spark, d):
    """Bits per character of every text that has any."""
    c = table(spark, d, "documents", "doc_id", "text").where(F.col("text") != "").select("doc_id", F.explode(F.split("text", "")).alias("ch")).where(F.col("ch") != "").groupBy("doc_id", "ch").agg(F.count("*").alias("c"))
    g = c.groupBy("doc_id").agg(F.sum("c").alias("n"), F.collect_list("c").alias("cs"))
    bits = F.aggregate("cs", F.lit(0.0), lambda a, x: a - (x / F.col("n")) * F.log2(x / F.col("n")))
    return g.select("doc_id", F.round(bits + 0.0, 6).alias("entropy"))


# ------------------------------------------------------------------ memories

_MEM = f"""mem AS (SELECT doc_id AS id, text AS content, source AS scope, CASE WHEN doc_kind = 'memory' THEN 'episodic' WHEN doc_kind = 'runbook' THEN 'procedural' ELSE 'semantic' END AS tier,
 epoch(created_at)::BIGINT AS created, (doc_id % 70)::BIGINT AS accesses, (doc_id % 50)::BIGINT AS good, (doc_id % 11) / 10.0::DOUBLE AS confidence FROM documents)"""


def memories(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    tier = F.when(F.col("doc_kind") == "memory", "episodic").when(F.col("doc_kind") == "runbook", "procedural").otherwise("semantic")
    created = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at").cast("timestamp_ntz"))
    i = F.col("doc_id")
    return t.select(i.alias("id"), F.col("text").alias("content"), F.col("source").alias("scope"), tier.alias("tier"), created.alias("created"), (i % 70).alias("accesses"), (i % 50).alias("good"),
                    ((i % 11) / F.lit(10.0)).alias("confidence"), F.lit(None).cast("bigint").alias("invalid_at"), F.lit(None).cast("bigint").alias("last_access"))


_SAL = f"greatest(0, least(1, 0.5 * confidence + 0.3 * exp(-0.01 * greatest(({NOW} - created) / 86400.0, 0)) + 0.2 * least(1, log2(1 + accesses) / log2(65))))"


@query(f"WITH {_MEM} SELECT id, round({_SAL}, 4) AS salience FROM mem")
def salience(spark, d):
    m = memories(spark, d)
    return m.select("id", F.round(M.salience(F.col("confidence"), M.decay((F.lit(NOW) - F.col("created")) / 86_400.0), F.col("accesses")), 4).alias("salience"))


@query(f"""WITH {_MEM} SELECT id, round(CASE WHEN accesses > 0 THEN greatest(0, least(1, (p + 3.8416 / (2 * accesses) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * accesses)) / accesses)) / (1 + 3.8416 / accesses))) ELSE 0 END, 6) AS bound
FROM (SELECT *, least(good, accesses)::DOUBLE / nullif(accesses, 0) AS p FROM mem)""")
def wilson_lower_bound(spark, d):
    m = memories(spark, d)
    return m.select("id", F.round(M.wilson_lower_bound(F.least("good", "accesses").cast("double"), F.col("accesses")), 6).alias("bound"))


@query(f"WITH {_MEM} SELECT scope, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM mem WHERE ({NOW} - created) / 86400.0 >= 90 AND {_SAL} < 0.3 GROUP BY scope")
def archive(spark, d):
    return M.archive(memories(spark, d), NOW, 0.3)


@query(f"WITH {_MEM} SELECT tier, count(*) AS n, count(DISTINCT scope) AS scopes FROM mem GROUP BY tier")
def memory_coverage(spark, d):
    return memories(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("scope").alias("scopes"))


@query()
def memory_recall(spark, d):
    """Keyword candidates weighed by tier, age and salience, then packed into a budget."""
    m = memories(spark, d)
    ranked = M.recall(m, _search(spark, d, 32), NOW, 10)
    cost = m.select("id", F.ceil(F.length("content") / 4).alias("cost"))
    return M.budget_pack(ranked.join(cost, "id").select("query_id", "id", "rank", "cost"), 600)


@query("""SELECT DISTINCT id, fact FROM (SELECT doc_id AS id, trim(unnest(regexp_split_to_array(text, '[.!?\\n]'))) AS fact FROM documents WHERE text IS NOT NULL) WHERE length(fact) > 3""")
def heuristic_facts(spark, d):
    return M.facts(memories(spark, d))


@query("""SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '\\b[A-Z][A-Za-z0-9]+')) AS entity FROM documents WHERE text IS NOT NULL""")
def heuristic_entities(spark, d):
    return M.entities(memories(spark, d))


@query("""WITH r AS (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, 1 + event_id % 40 AS cost FROM events)
SELECT query_id, id, rank::INT AS rank, cost FROM (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM r) WHERE used <= 300""")
def budget_prefix(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts")
    r = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"), (1 + F.col("event_id") % 40).alias("cost"))
    return M.budget_prefix(r, 300)


# ------------------------------------------------------------------ change


@query("SELECT event_id AS seq, event_type AS op FROM events WHERE event_id > 100 ORDER BY seq LIMIT 10000")
def changes_since(spark, d):
    log = table(spark, d, "events", "event_id", "event_type").select(F.col("event_id").alias("seq"), F.col("event_type").alias("op"))
    return S.changes_since(log, 100)


@query(f"""WITH f AS (SELECT {_PLAIN.format('path')} AS path, lower(digest) AS digest, observed_at, obs_id FROM files WHERE trim(coalesce(digest, '')) <> ''),
o AS (SELECT path, arg_max(digest, (observed_at, obs_id)) AS d FROM f WHERE observed_at < TIMESTAMP '2025-02-01' GROUP BY 1), n AS (SELECT path, arg_max(digest, (observed_at, obs_id)) AS d FROM f WHERE observed_at >= TIMESTAMP '2025-02-01' GROUP BY 1)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added' WHEN o.d = n.d THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.path = n.path""")
def incremental_index(spark, d):
    f = table(spark, d, "files").select(plain_path("path").alias("path"), F.lower(blank_to_null("digest")).alias("digest"), "observed_at", "obs_id").where(F.col("digest").isNotNull())
    side = lambda c: f.where(c).groupBy("path").agg(F.max_by("digest", F.struct("observed_at", "obs_id")).alias("digest"))
    return S.classify_changes(side("observed_at < timestamp_ntz'2025-02-01'"), side("observed_at >= timestamp_ntz'2025-02-01'"))


@query(f"""SELECT path AS file, obs_id AS seq FROM (SELECT {_PLAIN.format('path')} AS path, obs_id, row_number() OVER (PARTITION BY {_PLAIN.format('path')} ORDER BY observed_at DESC NULLS LAST, obs_id DESC) AS r FROM files) WHERE r <= 2""")
def edge_history(spark, d):
    f = table(spark, d, "files", "path", "obs_id", "observed_at").select(plain_path("path").alias("file"), F.col("obs_id").alias("seq"), F.col("observed_at").alias("at"))
    return S.edge_history(f, keep=2).select("file", "seq")


@query("""WITH g AS (SELECT source_id, generation, unnest(docs).key AS k FROM source_generations), m AS (SELECT source_id, max(generation) AS last FROM source_generations GROUP BY 1),
o AS (SELECT DISTINCT source_id, k FROM g JOIN m USING (source_id) WHERE generation < last), n AS (SELECT DISTINCT source_id, k FROM g JOIN m USING (source_id) WHERE generation = last)
SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.k, n.k) AS doc_key, CASE WHEN n.k IS NULL THEN 'delete' WHEN o.k IS NULL THEN 'insert' ELSE 'keep' END AS op FROM o FULL JOIN n ON o.source_id = n.source_id AND o.k = n.k WHERE coalesce(o.k, n.k) IS NOT NULL""")
def plan_replacement(spark, d):
    s = table(spark, d, "source_generations", "source_id", "generation", "docs")
    last = s.groupBy("source_id").agg(F.max("generation").alias("last"))
    g = s.select("source_id", "generation", F.explode("docs.key").alias("doc_key")).join(last, "source_id").where(F.col("doc_key").isNotNull())
    return S.plan_replacement(g.where("generation < last"), g.where("generation = last"), ["source_id", "doc_key"])


@query("SELECT symbol, max(epoch) AS epoch FROM nodes GROUP BY 1")
def symbol_epoch(spark, d):
    return table(spark, d, "nodes", "symbol", "epoch").groupBy("symbol").agg(F.max("epoch").alias("epoch"))
