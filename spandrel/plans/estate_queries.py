"""Queries of the reads, contexts, upkeep, recall and resolver operators over whole tables, with their
SQL twins. The twins are written from what the operators are meant to give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.text import plain_path
from spandrel.operators import context as C
from spandrel.operators import graph as G
from spandrel.operators import rank as K
from spandrel.operators import reads as R
from spandrel.operators import recall as M
from spandrel.operators import redaction as D
from spandrel.operators import resolve as V
from spandrel.operators import textsearch as T
from spandrel.operators import upkeep as U
from spandrel.plans.more_queries import _NOTES, _TEXTS, notes, texts
from spandrel.plans.reference_queries import _CODE, _MEM, _PLAIN, NOW, _SAL, _seed, _walk, code_nodes, memories
from spandrel.sources.graph import GRAPH_SQL, graph_edges, graph_nodes
from spandrel.sources.tables import table

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def counted(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, n) of several frames."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ reads


@query(f"{GRAPH_SQL} SELECT symbol, name, kind FROM n WHERE symbol = 'nation/3'")
def get_node(spark, d):
    return R.get_node(graph_nodes(spark, d), "nation/3").select("symbol", "name", "kind")


@query(f"WITH {_CODE} SELECT symbol FROM code WHERE coalesce(kind NOT IN ('field', 'parameter', 'variable', 'slot'), true) ORDER BY symbol LIMIT 500")
def find_structural_symbols(spark, d):
    return R.find_structural(code_nodes(spark, d), 500).select("symbol")


@query(f"""WITH {_CODE} SELECT symbol FROM code WHERE NOT regexp_matches(file, '(?i)(^|/)(vendor|vendored|node_modules|third_party|external)/') AND NOT regexp_matches(file, '(?i)(^|/)(tests?|spec|__tests__)/|_test\\.\\w+$|\\.(test|spec)\\.\\w+$')
 AND span.end_line - span.start_line + 1 >= 4 AND name NOT IN ('close', 'open')""")
def graph_display_filters(spark, d):
    n = code_nodes(spark, d).withColumn("lines", F.col("span.end_line") - F.col("span.start_line") + 1)
    return n.where(R.shown(trivial_lines=4, ignored=("close", "open"))).select("symbol")


_PARKED = f"{_TEXTS}, parked AS (SELECT DISTINCT path AS file, unnest(regexp_extract_all(blob, '(?:require\\(|from )\"([^\"\\n]+)\"', 1)) AS raw_name FROM tx)"


def parked(spark: SparkSession, d: str) -> DataFrame:
    """Imports as texts write them, none of them resolved yet."""
    found = F.regexp_extract_all("text", F.lit(r'(?:require\(|from )"([^"\n]+)"'), F.lit(1))
    return texts(spark, d).select(F.col("path").alias("file"), F.explode(found).alias("raw_name")).distinct().withColumn("kind", F.lit("imports"))


@query(f"WITH {_PARKED} SELECT file, raw_name FROM parked WHERE raw_name IN ('./digest', './marker', './shard')")
def unresolved_for_name(spark, d):
    names = spark.createDataFrame([("./digest",), ("./marker",), ("./shard",), ("./shard",)], "name string")
    return R.unresolved_for_name(parked(spark, d), names).select("file", "raw_name")


@query(f"WITH {_PARKED} SELECT file, raw_name FROM parked WHERE starts_with(file, 'amber-ledger/') AND regexp_matches(raw_name, '^\\.\\.?/')")
def parked_imports(spark, d):
    return R.parked_imports(parked(spark, d), "amber-ledger", relative_only=True).select("file", "raw_name")


@query(f"WITH {_CODE} SELECT DISTINCT symbol FROM code WHERE doc = (SELECT min(doc) FROM code)")
def by_requirement(spark, d):
    s = code_nodes(spark, d).select("symbol", F.col("doc").alias("requirement"))
    return R.by_requirement(s, s.agg(F.min("requirement")).first()[0])


@query(f"WITH {_CODE}, {_NOTES} SELECT DISTINCT symbol, key, value FROM notes SEMI JOIN (SELECT symbol FROM code WHERE kind = 'method') USING (symbol) WHERE key = 'visibility'")
def annotations_of(spark, d):
    a = notes(spark, d).withColumn("type", F.col("key"))
    return R.annotations_of(a, code_nodes(spark, d).where(F.col("kind") == "method"), "visibility").select("symbol", "key", "value").distinct()


@query(f"""WITH {_NOTES}, a AS (SELECT DISTINCT symbol, key, value, ts, CASE WHEN value = 'internal' THEN 'advisory' ELSE key END AS type FROM notes),
t AS (SELECT symbol, type, count(*) AS n FROM a GROUP BY ALL), g AS (SELECT symbol, sum(n)::BIGINT AS n, string_agg(type || ':' || n, ',' ORDER BY type) AS by_type, bool_or(type = 'advisory') AS has_advisory FROM t GROUP BY 1),
f AS (SELECT symbol, arg_min(value, (type <> 'advisory', -epoch(ts), key, value)) AS first_value FROM a GROUP BY 1) SELECT g.*, f.first_value, least(n, 2) AS inline FROM g JOIN f USING (symbol)""")
def annotation_overview(spark, d):
    """Notes by type, advice first; the inline list is cut at two."""
    a = notes(spark, d).withColumn("type", F.when(F.col("value") == "internal", "advisory").otherwise(F.col("key")))
    o = R.annotation_overview(a, 2)
    return o.select("symbol", "n", F.array_join(F.transform("by_type", lambda x: F.concat_ws(":", x["type"], x["n"].cast("string"))), ",").alias("by_type"), "has_advisory",
                    F.col("inline")[0]["value"].alias("first_value"), F.size("inline").cast("bigint").alias("inline"))


_LATEST = f"lv AS (SELECT path, arg_max(git_sha, (observed_at, arrived_at, obs_id)) AS git_sha FROM (SELECT {_PLAIN.format('path')} AS path, git_sha, observed_at, arrived_at, obs_id FROM files WHERE git_sha IS NOT NULL AND path IS NOT NULL) GROUP BY 1)"


def latest(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_versions(table(spark, d, "files", "path", "git_sha", "observed_at", "arrived_at", "obs_id").withColumn("path", plain_path("path")))


@query(f"WITH {_LATEST} SELECT path, md5(blob) AS digest FROM lv JOIN file_content USING (git_sha)")
def file_content(spark, d):
    return R.file_content(latest(spark, d), table(spark, d, "file_content")).select("path", F.md5("text").alias("digest"))


@query(f"WITH {_CODE}, {_NOTES} SELECT symbol, kind, doc AS description FROM code SEMI JOIN (SELECT symbol FROM notes WHERE key = 'visibility') USING (symbol) WHERE kind <> 'file'")
def nodes_export(spark, d):
    n = code_nodes(spark, d)
    return R.nodes_export(n, kinds=("all",), annotations=notes(spark, d), key="visibility", semantics=n.select("symbol", F.col("doc").alias("description"))).select("symbol", "kind", "description")


@query(f"""WITH {_CODE}, {_NOTES}, m AS (SELECT symbol, count(*) AS notes FROM (SELECT DISTINCT * FROM notes) GROUP BY 1)
SELECT symbol, name, coalesce(notes, 0) AS notes FROM code LEFT JOIN m USING (symbol) WHERE kind = 'method'""")
def retrieve_entity(spark, d):
    n = code_nodes(spark, d)
    return R.retrieve_entity(n, n.where(F.col("kind") == "method"), notes(spark, d)).select("symbol", "name", "notes")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 12) AS score FROM q, embeddings),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k JOIN embeddings e ON e.vec_id = k.id WHERE e.label % 2 = 0 AND score >= 0.1""")
def semantic_search(spark, d):
    """Neighbours above a floor whose node is still there (here: an even label)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    near = K.vector_nearest(v.select("id", "v"), v.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "v"))
    live = v.where(F.col("label") % 2 == 0).select(F.col("id").alias("symbol"))
    return R.live_hits(R.above_floor(near, 0.1), live).withColumn("score", F.round("score", 6))


def supports(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges as facts their owners hold; repeated edges are several facts of one edge."""
    x = table(spark, d, "typed_xedges").where("src_id is not null and tgt_id is not null and owner is not null")
    return x.select("owner", F.coalesce("src_epoch", F.lit(0)).alias("generation"), F.col("src_id").alias("source"), F.col("tgt_id").alias("target"), F.col("rel").alias("kind"),
                    F.col("edge_id").cast("string").alias("fact_id"), "confidence", F.lit(1).cast("bigint").alias("evidence_count"))


_SUP = "s AS (SELECT owner, coalesce(src_epoch, 0) AS generation, src_id AS source, tgt_id AS target, rel AS kind, edge_id::VARCHAR AS fact_id, confidence, 1 AS evidence_count FROM typed_xedges WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL AND owner IS NOT NULL)"


@query(f"WITH {_SUP} SELECT owner, generation, count(DISTINCT fact_id) AS facts, count(DISTINCT (source, target, kind)) AS edges FROM s WHERE generation = (SELECT max(generation) FROM s z WHERE z.owner = s.owner) GROUP BY ALL")
def support_reads(spark, d):
    return R.support_reads(supports(spark, d))


@query("""WITH l AS (SELECT DISTINCT 'knowledge' AS store, node_id AS id, epoch FROM knowledge_nodes UNION SELECT 'estate', symbol, epoch FROM nodes)
SELECT edge_id FROM typed_xedges x WHERE starts_with(rel, 'de') AND (src_store = 'knowledge' OR tgt_store = 'knowledge')
 AND (src_store, src_id, src_epoch) IN (SELECT (store, id, epoch) FROM l) AND (tgt_store, tgt_id, tgt_epoch) IN (SELECT (store, id, epoch) FROM l)""")
def typed_edge_reads(spark, d):
    """Edges of one store by prefix of the relation, both of whose ends are of their epoch."""
    e = table(spark, d, "knowledge_nodes", "node_id", "epoch").select(F.lit("knowledge").alias("store"), F.col("node_id").alias("id"), "epoch")
    e = e.unionByName(table(spark, d, "nodes", "symbol", "epoch").select(F.lit("estate").alias("store"), F.col("symbol").alias("id"), "epoch"))
    return R.edges_at(table(spark, d, "typed_xedges"), store="knowledge", rel_prefix="de", epochs=e).select("edge_id")


@query(f"""{GRAPH_SQL}, f AS (SELECT count(DISTINCT file) AS n FROM n), o AS (SELECT count(*) AS n FROM orders)
SELECT 'nodes' AS metric, kind AS key, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edges', kind, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'files', '', n FROM f""")
def graph_counts(spark, d):
    """Nodes and edges by kind, and files."""
    n, e = graph_nodes(spark, d), graph_edges(spark, d)
    by = lambda df, m: df.groupBy(F.lit(m).alias("metric"), F.col("kind").alias("key")).agg(F.count("*").alias("n"))
    return by(n, "nodes").unionByName(by(e, "edges")).unionByName(n.agg(F.lit("files").alias("metric"), F.lit("").alias("key"), F.countDistinct("file").alias("n")))


_BYRES = f"{GRAPH_SQL}, r AS (SELECT *, CASE WHEN confidence = 1 THEN 'parsed' WHEN confidence = 0.9 THEN 'import_map' WHEN confidence = 0.65 THEN 'scoped' ELSE 'name' END AS resolved_by FROM e)"


def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    return graph_edges(spark, d).withColumn("resolved_by", F.when(c == 1, "parsed").when(c == 0.9, "import_map").when(c == 0.65, "scoped").otherwise("name"))


@query(f"{_BYRES} SELECT count(*) AS n, round(min(confidence), 6) AS least, round(avg(confidence), 6) AS mean FROM r WHERE kind NOT IN ('contains', 'defines')")
def dependency_confidence(spark, d):
    """Over the deduplicated dependency edges as a whole; null figures without any."""
    e = V.edge_dedup_best(resolved_edges(spark, d).withColumn("ordinal", F.lit(0))).where(~F.col("kind").isin("contains", "defines"))
    return e.agg(F.count("*").alias("n"), F.round(F.min("confidence"), 6).alias("least"), F.round(F.avg("confidence"), 6).alias("mean"))


@query(f"""{_BYRES} SELECT resolved_by, count(*) FILTER (confidence = 1.0) AS exact_n, count(*) FILTER (confidence >= 0.8 AND confidence < 1.0) AS high_n, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium_n,
 count(*) FILTER (confidence < 0.5) AS low_n, round(avg(confidence), 6) AS mean FROM r GROUP BY 1""")
def resolver_bands(spark, d):
    c, n = F.col("confidence"), lambda x, a: F.count(F.when(x, 1)).alias(a)
    return resolved_edges(spark, d).groupBy("resolved_by").agg(n(c == 1, "exact_n"), n((c >= 0.8) & (c < 1), "high_n"), n((c >= 0.5) & (c < 0.8), "medium_n"), n(c < 0.5, "low_n"), F.round(F.avg(c), 6).alias("mean"))


@query(f"WITH {_CODE} SELECT symbol, kind FROM code WHERE file = (SELECT min(file) FROM code)")
def symbols_of_file(spark, d):
    n = code_nodes(spark, d)
    return n.where(F.col("file") == n.agg(F.min("file")).first()[0]).select("symbol", "kind")


@query("""WITH b AS (SELECT doc_id, unnest(list_transform(range(0, octet_length(encode(text))), lambda i: substr(hex(encode(text)), (2 * i + 1)::BIGINT, 2))) AS b FROM documents WHERE text <> '' AND octet_length(encode(text)) < 3000),
c AS (SELECT doc_id, b, count(*)::DOUBLE AS c FROM b GROUP BY 1, 2), n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY 1)
SELECT doc_id, round(-sum(c / n * log2(c / n)) + 0.0, 6) AS bits FROM c JOIN n USING (doc_id) GROUP BY 1""".replace(" AND octet_length(encode(text)) < 3000", ""))
def entropy_bytes(spark, d):
    """Bits per byte of every text that has any."""
    t = table(spark, d, "documents", "doc_id", "text").where(F.col("text") != "")
    return t.select("doc_id", F.round(D.column(D.entropy, "text", kind="double"), 6).alias("bits"))


# ------------------------------------------------------------------ contexts


@query(_walk("supplier/1", "in", 3) + """, x AS (SELECT DISTINCT e.source, e.target, b.depth FROM e JOIN reached b ON b.symbol = e.source JOIN reached a ON a.symbol = e.target
 WHERE b.depth = a.depth + 1 AND split_part(e.source, '/', 1) <> split_part(e.target, '/', 1)) SELECT source, target, depth FROM x ORDER BY depth, source, target LIMIT 20""")
def crossings(spark, d):
    e = graph_edges(spark, d)
    reached = G.traverse(e, _seed(spark, "supplier/1"), "in", 3, keep_seeds=True)
    return C.crossings(e, reached, graph_nodes(spark, d).select("symbol", F.split_part("symbol", F.lit("/"), F.lit(1)).alias("repo")))


@query(_walk("region/1", "in", 6).replace("reached AS", "far AS") + ", near AS (SELECT symbol FROM far WHERE depth <= 2) SELECT count(*) > 0 AS hidden FROM far JOIN n USING (symbol) WHERE depth > 2 AND n.kind = 'function'")
def refine_horizon(spark, d):
    """Does a walk of two hops from a region keep functions back?"""
    e, n = graph_edges(spark, d), graph_nodes(spark, d)
    reached = G.traverse(e, _seed(spark, "region/1"), "in", 2, keep_seeds=True)
    return C.refine_horizon(e, reached, n.where(F.col("kind") == "function"), 2)


@query(GRAPH_SQL + """, x AS (SELECT source, target FROM e WHERE starts_with(target, 'supplier/')), w AS (SELECT DISTINCT source AS s, 1 AS depth FROM x WHERE target = 'supplier/1' UNION SELECT e.source, 2 FROM e JOIN x ON e.target = x.source AND x.target = 'supplier/1')
SELECT s AS symbol, min(depth) AS depth FROM w GROUP BY 1 ORDER BY depth, symbol LIMIT 5000""")
def flow_lineage(spark, d):
    """Calls taken as flows: what consumes, directly or through others, what a supplier produces."""
    f = graph_edges(spark, d).where(F.col("kind") == "calls").withColumn("kind", F.lit("flows_to"))
    return C.flow_lineage(f, _seed(spark, "supplier/1"))


@query(GRAPH_SQL + """, near AS (SELECT CASE WHEN source = 'nation/3' THEN target ELSE source END AS symbol, count(*) * 2.0 AS score FROM e WHERE source = 'nation/3' OR target = 'nation/3' GROUP BY 1),
h AS (SELECT symbol, 1.0 AS score FROM n WHERE starts_with(symbol, 'region/') AND symbol NOT IN (SELECT symbol FROM near)), s AS (SELECT * FROM near UNION ALL SELECT * FROM h),
c AS (SELECT symbol, score, row_number() OVER o AS position, sum(length(name) + length(file) + 100) OVER o AS used FROM s JOIN n USING (symbol) WINDOW o AS (ORDER BY score DESC, symbol))
SELECT position::INT AS position, symbol, score::DOUBLE AS score, used::BIGINT AS used FROM c WHERE used <= 6000""")
def budget_context(spark, d):
    n = graph_nodes(spark, d)
    return C.budget_context(n, graph_edges(spark, d), _seed(spark, "nation/3"), n.where(F.col("symbol").startswith("region/")), 6_000)


@query()
def render_context(spark, d):
    return C.render_context(graph_nodes(spark, d), graph_edges(spark, d), _seed(spark, "region/1"))


@query()
def context_pack(spark, d):
    return C.context_pack(graph_nodes(spark, d), graph_edges(spark, d), "Supplier#000000001")


@query()
def source_bundle(spark, d):
    """Sources of each repository's files, as far as the budget goes."""
    s = R.file_content(latest(spark, d), table(spark, d, "file_content"))
    return C.source_bundle(s.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("group"), F.col("path").alias("symbol"), F.col("text").alias("source")))


@query()
def graph_view(spark, d):
    n, e = graph_nodes(spark, d), graph_edges(spark, d)
    return C.graph_view(n, e, K.pagerank(n, e))


# ------------------------------------------------------------------ upkeep

_CONTRIB = f"c AS (SELECT symbol, {_PLAIN.format('file')} AS file, is_def FROM node_files)"
_LEADS = f"lead AS (SELECT {_PLAIN.format('file')} AS file, min(symbol) AS target FROM node_files GROUP BY 1), ed AS (SELECT DISTINCT c.symbol AS source, target, 'contains' AS kind, file FROM c JOIN lead USING (file) WHERE c.symbol IS NOT NULL)"


def contributions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Contributions, and an edge from every symbol to the least of its file."""
    c = table(spark, d, "node_files", "symbol", "file", "is_def").withColumn("file", plain_path("file"))
    lead = c.groupBy("file").agg(F.min("symbol").alias("target"))
    e = c.where(F.col("symbol").isNotNull()).join(lead, "file").select(F.col("symbol").alias("source"), "target", F.lit("contains").alias("kind"), "file").distinct()
    return c, e


@query(f"""WITH {_CONTRIB}, {_LEADS}, k AS (SELECT * FROM c WHERE NOT coalesce(starts_with(file, 'amber-ledger/'), false)), left_ AS (SELECT DISTINCT symbol FROM k WHERE symbol IS NOT NULL),
gone AS (SELECT DISTINCT symbol FROM c WHERE symbol IS NOT NULL AND symbol NOT IN (SELECT symbol FROM left_)),
p AS (SELECT symbol, arg_min(file, (-coalesce(is_def, 0), file)) AS f FROM c WHERE symbol IS NOT NULL AND file IS NOT NULL GROUP BY 1), q AS (SELECT symbol, arg_min(file, (-coalesce(is_def, 0), file)) AS f FROM k WHERE symbol IS NOT NULL AND file IS NOT NULL GROUP BY 1),
dead AS (SELECT * FROM ed WHERE starts_with(file, 'amber-ledger/') OR source IN (SELECT symbol FROM gone) OR target IN (SELECT symbol FROM gone))
SELECT 'kept' AS part, count(*) AS n FROM k UNION ALL SELECT 'rehomed', count(*) FROM p JOIN q USING (symbol) WHERE p.f <> q.f UNION ALL SELECT 'gone', count(*) FROM gone
UNION ALL SELECT 'edges', (SELECT count(*) FROM ed) - (SELECT count(*) FROM dead) UNION ALL SELECT 'archived', count(*) FROM dead""")
def remove_file(spark, d):
    """What one repository's files leave behind when they go."""
    c, e = contributions(spark, d)
    return counted(U.remove_files(c, e, c.where(F.col("file").startswith("amber-ledger/")).select("file")))


@query(f"""{GRAPH_SQL}, k AS (SELECT symbol FROM n WHERE kind <> 'struct'), x AS (SELECT vec_id FROM embeddings WHERE 'customer/' || vec_id IN (SELECT symbol FROM k)),
h AS (SELECT *, row_number() OVER (PARTITION BY {_PLAIN.format('path')} ORDER BY observed_at DESC NULLS LAST, obs_id DESC) AS r FROM files)
SELECT 'edges' AS part, count(*) AS n FROM e WHERE source IN (SELECT symbol FROM k) AND target IN (SELECT symbol FROM k) UNION ALL SELECT 'embeddings', count(*) FROM x
UNION ALL SELECT 'contents', count(*) FROM file_content WHERE git_sha IN (SELECT git_sha FROM files WHERE repo = 'amber-ledger') UNION ALL SELECT 'history', count(*) FROM h WHERE r <= 3""")
def compact(spark, d):
    n = graph_nodes(spark, d).where(F.col("kind") != "struct")
    emb = table(spark, d, "embeddings").select(F.concat(F.lit("customer/"), F.col("vec_id")).alias("id"))
    f = table(spark, d, "files", "path", "repo", "git_sha", "observed_at", "obs_id")
    history = f.select(plain_path("path").alias("file"), F.col("observed_at").alias("at"), F.col("obs_id").alias("seq"))
    return counted(U.compact(n, graph_edges(spark, d), emb, table(spark, d, "file_content", "git_sha"), f.where(F.col("repo") == "amber-ledger"), history, 3))


@query(f"""WITH {_SUP}, o AS (SELECT min(owner) AS o FROM s), t AS (SELECT * FROM s WHERE owner <> (SELECT o FROM o) UNION ALL SELECT owner, 1000000, source, target, 'replaced', fact_id, 1.0, 1 FROM s WHERE owner = (SELECT o FROM o))
SELECT source, target, kind, round(max(confidence), 6) AS confidence FROM t GROUP BY ALL""")
def replace_edge_supports(spark, d):
    """Edges after one owner's facts were replaced by a later generation."""
    s = supports(spark, d)
    owner = s.agg(F.min("owner")).first()[0]
    new = s.where(F.col("owner") == owner).withColumn("kind", F.lit("replaced")).withColumn("confidence", F.lit(1.0))
    return U.replace_supports(s, new, owner, 1_000_000)[1].select("source", "target", "kind", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_CODE} SELECT symbol, CASE WHEN kind = 'method' THEN signature ELSE doc END AS description FROM code")
def semantics_restore(spark, d):
    """Methods are extracted with a description, all others get theirs back."""
    n = code_nodes(spark, d)
    fresh = n.select("symbol", F.when(F.col("kind") == "method", F.coalesce("signature", "doc")).alias("description"), F.lit(None).cast("boolean").alias("validated"))
    fresh = fresh.where(F.col("symbol").isNotNull())
    old = n.select("symbol", F.when(F.col("kind") != "method", F.col("doc")).alias("description"), F.lit(True).alias("validated"))
    return U.restore_semantics(fresh, old).select("symbol", "description")


@query(f"WITH {_NOTES} SELECT symbol, key, value, max(ts) AS ts FROM (SELECT DISTINCT * FROM notes UNION ALL SELECT DISTINCT symbol, 'seen', key, ts FROM notes) GROUP BY ALL")
def annotate(spark, d):
    a = notes(spark, d)
    return U.annotate(a, a.select("symbol", F.lit("seen").alias("key"), F.col("key").alias("value"), "ts"))


@query(f"WITH {_CODE}, {_NOTES} SELECT DISTINCT symbol, key, value FROM notes WHERE symbol NOT IN (SELECT symbol FROM code WHERE kind = 'method') AND key <> 'visibility'")
def delete_annotations(spark, d):
    a = notes(spark, d).select("symbol", "key", "value").distinct()
    doomed = code_nodes(spark, d).where(F.col("kind") == "method").select("symbol", F.lit(None).cast("string").alias("key"))
    return U.delete_annotations(a, doomed.unionByName(a.select("symbol", F.lit("visibility").alias("key"))))


@query(f"""WITH f AS (SELECT {_PLAIN.format('path')} AS path, lower(digest) AS digest, repo, observed_at, obs_id FROM files WHERE trim(coalesce(digest, '')) <> ''),
a AS (SELECT path, arg_max(digest, (observed_at, obs_id)) AS d, min(repo) AS repo FROM f WHERE observed_at < TIMESTAMP '2025-02-01' GROUP BY 1), n AS (SELECT path, arg_max(digest, (observed_at, obs_id)) AS d FROM f WHERE observed_at >= TIMESTAMP '2025-01-15' GROUP BY 1)
SELECT repo AS answer, count(*) FILTER (n.path IS NOT NULL AND a.d <> n.d) AS drifted, count(*) FILTER (n.path IS NULL) AS missing FROM a LEFT JOIN n USING (path) GROUP BY 1""")
def freshness(spark, d):
    """What each repository's answer of the 1st of February was worth later."""
    f = table(spark, d, "files").where(F.trim(F.coalesce("digest", F.lit(""))) != "").select(plain_path("path").alias("path"), F.lower("digest").alias("digest"), "repo", "observed_at", "obs_id")
    side = lambda c: f.where(c).groupBy("path").agg(F.max_by("digest", F.struct("observed_at", "obs_id")).alias("digest"), F.min("repo").alias("answer"))
    return U.freshness(side("observed_at < timestamp_ntz'2025-02-01'"), side("observed_at >= timestamp_ntz'2025-01-15'"))


@query(f"{GRAPH_SQL} SELECT 'shop/' || symbol AS symbol, kind FROM n")
def multi_repo_namespace(spark, d):
    n = graph_nodes(spark, d).select("symbol", "kind")
    return U.scoped_to_repo(U.scoped_to_repo(n, "shop", "symbol"), "shop", "symbol")


# ------------------------------------------------------------------ memories and knowledge


@query(f"""WITH {_MEM}, q(query_id, s) AS (VALUES (1, 'store:ledger-handbook'), (2, ''), (3, 'store:none')) SELECT query_id, id FROM q JOIN mem ON mem.scope IS NULL OR mem.scope = '' OR mem.scope = q.s""")
def scope_filter(spark, d):
    q = spark.createDataFrame([(1, "store:ledger-handbook"), (2, ""), (3, "store:none")], "query_id int, scope string")
    return M.in_reach(memories(spark, d), q)


@query(f"WITH {_MEM} SELECT id FROM mem WHERE coalesce(scope <> 'store:ledger-handbook', true) AND id % 10 <> 0")
def erase(spark, d):
    m = memories(spark, d)
    return M.erase(m, scope="store:ledger-handbook", ids=m.where(F.col("id") % 10 == 0)).select("id")


@query(f"WITH {_MEM} SELECT id, CASE WHEN id % 10 = 0 THEN {NOW}::BIGINT END AS invalid_at FROM mem")
def retire(spark, d):
    m = memories(spark, d)
    return M.retire(m, m.where(F.col("id") % 10 == 0), NOW).select("id", "invalid_at")


@query(f"""WITH {_MEM}, e AS (SELECT * FROM mem WHERE tier = 'episodic' AND content IS NOT NULL),
f AS (SELECT DISTINCT 'fact' AS kind, fact AS content, scope FROM (SELECT scope, trim(unnest(regexp_split_to_array(content, '[.!?\\n]'))) AS fact FROM e) WHERE length(fact) > 3),
n AS (SELECT scope, unnest(regexp_extract_all(content, '\\b[A-Z][A-Za-z0-9]+')) AS name FROM e), g AS (SELECT lower(name) AS k, min(name) AS entity FROM n GROUP BY 1),
m AS (SELECT DISTINCT 'entity' AS kind, entity AS content, scope FROM n JOIN g ON g.k = lower(n.name)) SELECT * FROM f UNION ALL SELECT * FROM m""")
def reflect(spark, d):
    m = memories(spark, d).withColumn("facets", F.lit(""))
    none = spark.createDataFrame([], "kind string, content string, scope string, facets string")
    return M.reflect(m, none)[0].select("kind", "content", "scope")


@query(f"""WITH {_MEM}, s AS (SELECT *, {_SAL} AS s, ({NOW} - created) / 86400.0 AS age FROM mem), b AS (SELECT CASE WHEN count(*) >= 8 THEN least(median(s), 0.3) ELSE 0.3 END AS low, CASE WHEN count(*) >= 8 THEN greatest(median(s), 0.3) ELSE 0.3 END AS up FROM s),
p AS (SELECT id, CASE WHEN accesses > 0 THEN greatest(0, least(1, (r + 3.8416 / (2 * accesses) - 1.96 * sqrt((r * (1 - r) + 3.8416 / (4 * accesses)) / accesses)) / (1 + 3.8416 / accesses))) ELSE 0 END AS w FROM (SELECT *, good::DOUBLE / nullif(accesses, 0) AS r FROM mem WHERE good >= 5 AND good <= accesses))
SELECT 'archived' AS part, count(DISTINCT coalesce(scope, '')) AS n FROM s, b WHERE age >= 90 AND s.s < low UNION ALL SELECT 'promoted', count(*) FROM p, b WHERE w >= up UNION ALL SELECT 'memories', count(*) FROM mem""")
def consolidate(spark, d):
    m = memories(spark, d).withColumn("facets", F.lit("")).withColumn("good", F.when(F.col("good") <= F.col("accesses"), F.col("good")))
    out = M.consolidate(m, spark.createDataFrame([], "kind string, content string, scope string, facets string"), NOW)
    return counted({k: out[k] for k in ("archived", "promoted", "memories")})


@query()
def keyword_candidates(spark, d):
    """Every passage of the benchmark as a question, against all documents."""
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    q = table(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), "text")
    return M.keyword_candidates(docs, q)


@query()
def knowledge_recall(spark, d):
    """The best piece of every visible document for every passage of the benchmark."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang").withColumnRenamed("doc_id", "id")
    q = table(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), "text")
    return M.knowledge_recall(docs.select("id", "text"), q, docs.where(F.col("lang").isNotNull()))


@query(f"""{GRAPH_SQL}, t AS (SELECT symbol FROM n WHERE kind IN ('module', 'struct')) SELECT round(count(*) FILTER (symbol NOT IN (SELECT symbol FROM t)) / count(*), 6) AS rate FROM n""")
def singleton_rate(spark, d):
    """Share of nodes no community of two or more covers (here: communities are two kinds)."""
    n = graph_nodes(spark, d)
    return K.singleton_rate(n, n.where(F.col("kind").isin("module", "struct")).select("symbol", F.col("kind").alias("community")))


@query(f"""{GRAPH_SQL}, r AS (SELECT symbol, file, lead(symbol) OVER (PARTITION BY file ORDER BY symbol) AS nx, min(symbol) OVER (PARTITION BY file) AS lo, count(*) OVER (PARTITION BY file) AS c FROM n)
SELECT symbol AS source, coalesce(nx, lo) AS target, 2.0::DOUBLE AS weight FROM r WHERE c > 1""")
def package_bias(spark, d):
    """A ring through the nodes of every directory."""
    return K.package_ring(graph_nodes(spark, d).select("symbol", F.col("file").alias("directory")), 2.0)


@query(f"""{GRAPH_SQL}, c AS (SELECT symbol, kind AS community, file FROM n), l AS (SELECT x.community AS a, y.community AS b FROM e JOIN c x ON x.symbol = e.source JOIN c y ON y.symbol = e.target WHERE source <> target), m AS (SELECT count(*)::DOUBLE AS m FROM l),
g AS (SELECT k, count(*) AS d FROM (SELECT a AS k FROM l UNION ALL SELECT b FROM l) GROUP BY 1), i AS (SELECT a AS k, count(*) AS l FROM l WHERE a = b GROUP BY 1), t AS (SELECT community, symbol, row_number() OVER (PARTITION BY community ORDER BY symbol) AS r FROM c),
s AS (SELECT community, count(*) AS size FROM c GROUP BY 1)
SELECT s.community, size, string_agg(t.symbol, ',' ORDER BY r) AS top, round(coalesce(i.l, 0) / any_value(m) - (coalesce(d, 0) / (2 * any_value(m))) * (coalesce(d, 0) / (2 * any_value(m))), 6) AS term
FROM s JOIN t ON t.community = s.community AND r <= 5 LEFT JOIN g ON g.k = s.community LEFT JOIN i ON i.k = s.community, m GROUP BY s.community, size, i.l, d""")
def community_report(spark, d):
    """Size, best-ranked five (here by a rank that falls with the symbol) and modularity term of every kind."""
    n = graph_nodes(spark, d)
    a = n.select("symbol", F.col("kind").alias("community"))
    r = K.community_report(a, graph_edges(spark, d), n.select("symbol", F.lit(1.0).alias("score")))
    return r.select("community", "size", F.array_join("top", ",").alias("top"), F.round("term", 6).alias("term"))


@query()
def memory_recall_gated(spark, d):
    """Recall by every passage of the benchmark, with scope, salience floor and budget."""
    m = memories(spark, d).withColumn("facets", F.create_map().cast("map<string,string>"))
    q = table(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), "text", F.lit("store:ledger-handbook").alias("scope"))
    return M.memory_recall(m, q, NOW, 600, mode="keyword", floor=0.2)


_KN = "k AS (SELECT DISTINCT node_id, source_id, scope FROM knowledge_nodes)"


@query(f"WITH {_KN} SELECT node_id FROM k WHERE source_id IS DISTINCT FROM (SELECT min(source_id) FROM k) AND NOT coalesce(starts_with(scope, 'source:src-00-0002'), false)")
def knowledge_forget(spark, d):
    k = table(spark, d, "knowledge_nodes", "node_id", "source_id", "scope").distinct()
    gone = k.where(F.col("scope").startswith("source:src-00-0002")).select("node_id")
    return M.knowledge_forget(k, ids=gone, source=k.agg(F.min("source_id")).first()[0]).select("node_id")


@query("""WITH l AS (SELECT source_id, max(generation) AS generation FROM source_generations GROUP BY 1), x AS (SELECT DISTINCT source_id, generation, d.key AS doc_key, d.title AS title, coalesce(len(d.sections), 0)::INT AS sections FROM (SELECT source_id, generation, unnest(docs) AS d FROM source_generations JOIN l USING (source_id, generation)))
SELECT * FROM x WHERE doc_key IS NOT NULL ORDER BY source_id, doc_key, title NULLS FIRST, sections LIMIT 100 OFFSET 100""")
def source_catalog(spark, d):
    return M.source_catalog(table(spark, d, "source_generations", "source_id", "generation", "docs"), 100, 100)


@query("""WITH i AS (SELECT DISTINCT node_id AS id FROM knowledge_nodes WHERE tombstoned_at IS NULL), x AS (SELECT * FROM typed_xedges WHERE src_store = 'knowledge' AND tgt_store = 'knowledge')
SELECT CASE WHEN coalesce(rel NOT IN ('describes', 'joins'), true) THEN 'relation' WHEN src_id IS NULL OR src_id NOT IN (SELECT id FROM i) THEN 'source' WHEN tgt_id IS NULL OR tgt_id NOT IN (SELECT id FROM i) THEN 'target' ELSE 'loop' END AS wrong, count(*) AS n FROM x
WHERE NOT coalesce(rel IN ('describes', 'joins') AND src_id IN (SELECT id FROM i) AND tgt_id IN (SELECT id FROM i) AND src_id <> tgt_id, false) GROUP BY 1""")
def doc_links(spark, d):
    x = table(spark, d, "typed_xedges").where("src_store = 'knowledge' and tgt_store = 'knowledge'").select("owner", F.col("src_epoch").alias("generation"), F.col("src_id").alias("source"), F.col("tgt_id").alias("target"), "rel")
    live = table(spark, d, "knowledge_nodes").where(F.col("tombstoned_at").isNull()).select(F.col("node_id").alias("id"))
    return M.doc_links(x, live, ("describes", "joins"))[1].groupBy("wrong").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey AS id, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, md5(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'remove' WHEN o.id IS NULL THEN 'insert' WHEN o.h = n.h THEN 'keep' ELSE 'update' END AS op FROM o FULL JOIN n ON o.id = n.id""")
def memory_pack(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    old = o.where(k % 3 != 0).select(k.alias("id"), F.md5("o_orderstatus").alias("hash"))
    return M.apply_pack(old, o.where(k % 4 != 0).select(k.alias("id"), F.md5(F.when(k % 5 == 0, "x").otherwise(F.col("o_orderstatus"))).alias("hash")))


# ------------------------------------------------------------------ resolvers


def _estate(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as rule sets, suppliers as rule groups, parts and customers as rules."""
    kinds = F.create_map(*map(F.lit, ("module", "rule_set", "struct", "rule_group", "interface", "rule", "class", "rule", "namespace", "module", "function", "function")))
    n = graph_nodes(spark, d).withColumn("kind", kinds[F.col("kind")])
    e = graph_edges(spark, d).where(~F.col("source").startswith("order/"))
    return n, e.withColumn("kind", F.when(F.col("source").startswith("nation/"), "invoked_by").otherwise("contains"))


@query(f"""{GRAPH_SQL}, s AS (SELECT symbol FROM n WHERE kind = 'module'), d AS (SELECT target AS rs, source AS rule FROM e WHERE starts_with(source, 'customer/')),
g AS (SELECT DISTINCT x.target AS rs, y.source AS rule FROM e x JOIN e y ON y.target = x.source WHERE starts_with(x.source, 'supplier/') AND starts_with(y.source, 'part/')),
a AS (SELECT rs, count(*) AS ungrouped FROM d GROUP BY 1), b AS (SELECT rs, count(*) AS grouped FROM g GROUP BY 1), c AS (SELECT source AS rs, count(DISTINCT target) AS callers FROM e WHERE starts_with(source, 'nation/') GROUP BY 1)
SELECT symbol AS rule_set, coalesce(callers, 0) AS callers, coalesce(grouped, 0) AS grouped, coalesce(ungrouped, 0) AS ungrouped FROM s LEFT JOIN a ON a.rs = symbol LEFT JOIN b ON b.rs = symbol LEFT JOIN c ON c.rs = symbol""")
def rules_inventory(spark, d):
    return V.rules_inventory(*_estate(spark, d)).select("rule_set", F.size("callers").cast("bigint").alias("callers"), "grouped", "ungrouped")


@query("SELECT 'supplier/' || s_suppkey AS ref_id, 'nation/' || n_nationkey AS target FROM supplier, nation")
def resolve_rules_bridge(spark, d):
    n, _ = _estate(spark, d)
    refs = n.where(F.col("kind") == "rule_group").select(F.col("symbol").alias("ref_id"), F.col("symbol").alias("from_symbol"), F.lit("rules-engine:main").alias("raw_name"))
    return V.resolve_rules_bridge(refs, n).select("ref_id", "target")


@query("SELECT o_orderkey AS ref_id, 'nation/' || n_nationkey AS target FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def resolve_dynamic_call(spark, d):
    """Orders call the nation's program by name, in capitals or not."""
    nation = table(spark, d, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("symbol"), F.lower("n_name").alias("name"), F.lit("module").alias("kind"), F.lit("cobol").alias("language"), F.col("n_nationkey").alias("k"), "n_name")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("k"))
    refs = table(spark, d, "orders", "o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ref_id"), F.lit("caller").alias("from_symbol"), F.concat(F.lit("dynamic:"), "n_name").alias("raw_name"))
    return V.resolve_dynamic_call(refs, nation).select("ref_id", "target")


@query(f"""WITH f AS (SELECT DISTINCT {_PLAIN.format('path')} AS path FROM files WHERE path IS NOT NULL), x AS (SELECT path, regexp_replace(path, '\\.[^./]*$', '') AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]+)$', 1) AS base, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM f),
r AS (SELECT path AS ref_id, dir || '/' || regexp_replace(base, '\\.[^.]*$', '') AS want FROM x WHERE ext IN ('ts', 'js', 'py', 'rs') AND dir <> '')
SELECT ref_id, coalesce((SELECT min(path) FROM f WHERE path = want || '.ts'), (SELECT min(path) FROM f WHERE path = want || '.js'), (SELECT min(path) FROM f WHERE path = want || '.py'), (SELECT min(path) FROM f WHERE path = want || '.rs')) AS target FROM r""")
def resolve_relative_import(spark, d):
    """Every TypeScript, JavaScript, Python and Rust file imported from beside it without extension."""
    f = table(spark, d, "files", "path").where(F.col("path").isNotNull()).select(plain_path("path").alias("path")).distinct()
    base = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    refs = f.where(F.col("path").rlike(r"/[^/]*\.(ts|js|py|rs)$")).select(F.col("path").alias("ref_id"), F.col("path").alias("file"), F.concat(F.lit("./"), base).alias("raw_name"))
    return V.resolve_relative_import(refs, f).select("ref_id", "target")


@query("""WITH p AS (SELECT 'nation' || s_nationkey AS repo, lower(replace(s_name, '#', '-')) AS key FROM supplier), d AS (SELECT DISTINCT 'nation' || c_nationkey AS repo, replace(s_name, '#', '_') AS name, lower(replace(s_name, '#', '-')) AS key FROM customer JOIN supplier ON s_suppkey = c_custkey % 97 + 1),
o AS (SELECT key, count(DISTINCT repo) AS n, min(repo) AS provider FROM p GROUP BY 1)
SELECT d.repo, name, CASE WHEN n IS NULL THEN 'not_provided' WHEN n > 1 THEN 'ambiguous' WHEN provider = d.repo THEN 'itself' ELSE provider END AS result FROM d LEFT JOIN o USING (key)""")
def link_repos(spark, d):
    """Nations as repositories: suppliers are the packages they provide, customers need one each."""
    s = table(spark, d, "supplier")
    repo = lambda c: F.concat(F.lit("nation"), c)
    p = s.select(repo("s_nationkey").alias("repo"), F.lit("python").alias("ecosystem"), F.col("s_name").alias("raw")).select("repo", "ecosystem", F.replace("raw", F.lit("#"), F.lit("-")).alias("name"))
    need = table(spark, d, "customer", "c_custkey", "c_nationkey").join(s, F.col("s_suppkey") == F.col("c_custkey") % 97 + 1)
    need = need.select(repo("c_nationkey").alias("repo"), F.lit("python").alias("ecosystem"), F.replace("s_name", F.lit("#"), F.lit("_")).alias("name"), F.lit("registry").alias("kind"), F.lit(None).cast("string").alias("source"))
    repos = table(spark, d, "nation").select(repo("n_nationkey").alias("repo"), F.lit("").alias("url"))
    links, bounds = V.link_repos(need, p, repos)
    return links.select("repo", "name", F.col("target").alias("result")).unionByName(bounds.select("repo", "name", F.col("reason").alias("result")))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def redact_free_text(spark, d):
    """Masks keep every text's length; what they hide is checked on small cases."""
    t = table(spark, d, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return t.select("doc_id", F.length(D.column(D.redact_free_text, "text")).alias("n"))


@query(f"WITH {_TEXTS} SELECT path, git_sha, length(blob) AS n FROM tx WHERE blob IS NOT NULL AND regexp_matches(path, '\\.(json|toml)$')")
def redact_config(spark, d):
    t = texts(spark, d).where(F.col("path").rlike(r"\.(json|toml)$") & F.col("text").isNotNull())
    return t.select("path", "git_sha", F.length(D.column(D.redact_config, "text", "path")).alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def value_secret(spark, d):
    t = table(spark, d, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return t.select("doc_id", F.length(D.column(D.redact_values, "text")).alias("n"))
