"""Extraction, annotation, correspondence and upkeep queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.text import plain_path
from spandrel.operators import extract as X
from spandrel.operators import knowledge as N
from spandrel.operators import rank as K
from spandrel.operators import resolve as R
from spandrel.plans.reference_queries import _CODE, _PLAIN, _refs, _search, code_nodes
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


_TEXTS = f"tx AS (SELECT DISTINCT {_PLAIN.format('path')} AS path, git_sha, blob FROM files JOIN file_content USING (git_sha))"


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct stored versions of all files: (path, git_sha, text)."""
    f = table(spark, d, "files", "path", "git_sha").where(F.col("git_sha").isNotNull()).select(plain_path("path").alias("path"), "git_sha").distinct()
    return f.join(table(spark, d, "file_content"), "git_sha").select("path", "git_sha", F.col("blob").alias("text"))


@query(f"""WITH {_TEXTS} SELECT DISTINCT path AS source, 'mod:' || unnest(regexp_extract_all(blob, 'require\\("([^"]+)"\\)', 1)) AS target FROM tx WHERE regexp_matches(path, '^.*/[^/]*\\.js$')""")
def extra_edge(spark, d):
    rule = X.EdgeRule("require", "**/*.js", r'require\("([^"]+)"\)', "mod:{0}")
    return X.extra_edges(texts(spark, d), rule).select("source", "target")


@query("""WITH r AS (SELECT doc_id AS id, unnest(list_zip(regexp_extract_all(text, '(?s)```(\\w*)[^\\n]*\\n(.*?)```', 1), regexp_extract_all(text, '(?s)```(\\w*)[^\\n]*\\n(.*?)```', 2), range(0, len(regexp_extract_all(text, '(?s)```(\\w*)[^\\n]*\\n(.*?)```'))))) AS z FROM documents WHERE text IS NOT NULL)
SELECT id, z[3]::INT AS ordinal, z[1] AS tag, length(z[2])::INT AS n FROM r""")
def embedded_regions(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    return X.embedded_regions(docs).select("id", "ordinal", "tag", F.length("text").alias("n"))


@query(f"""WITH {_TEXTS}
SELECT path, name, count(*) AS n FROM (
 SELECT path, unnest(regexp_extract_all(blob, '(?m)^[ \\t]*(?:async )?def (\\w+)\\(', 1)) AS name FROM tx WHERE ends_with(path, '.py') UNION ALL
 SELECT path, unnest(regexp_extract_all(blob, '(?m)^[ \\t]*(?:pub )?fn (\\w+)', 1)) FROM tx WHERE ends_with(path, '.rs') UNION ALL
 SELECT path, unnest(regexp_extract_all(blob, '(?m)^func (\\w+)\\(', 1)) FROM tx WHERE ends_with(path, '.go') UNION ALL
 SELECT path, unnest(regexp_extract_all(blob, '(?m)^[ \\t]*def (\\w+)', 1)) FROM tx WHERE ends_with(path, '.rb') UNION ALL
 SELECT path, unnest(regexp_extract_all(blob, '(?m)^[ \\t]*(?:export )?function (\\w+)\\(', 1)) FROM tx WHERE ends_with(path, '.js') OR ends_with(path, '.ts') UNION ALL
 SELECT path, unnest(regexp_extract_all(blob, '(?m)^[ \\t]*static \\w+ (\\w+)\\(', 1)) FROM tx WHERE ends_with(path, '.java') UNION ALL
 SELECT path, unnest(regexp_extract_all(blob, '(?m)^(\\w+)\\(\\) \\{{', 1)) FROM tx WHERE ends_with(path, '.sh')) GROUP BY ALL""")
def source_definitions(spark, d):
    """Definitions in every stored text of eight languages, found by pattern."""
    lang = F.create_map(*map(F.lit, ("py", "python", "rs", "rust", "go", "go", "rb", "ruby", "js", "javascript", "ts", "typescript", "java", "java", "sh", "shell")))[F.regexp_extract("path", r"\.(\w+)$", 1)]
    return X.definitions(texts(spark, d).withColumn("language", lang)).groupBy("path", "name").agg(F.count("*").alias("n"))


@query(f"""WITH {_CODE} SELECT symbol, CASE WHEN regexp_matches(file, '(?:^|/)(?:tests?|spec|__tests__)/|_test\\.\\w+$|\\.(?:test|spec)\\.\\w+$') THEN 'test' WHEN span.end_line - span.start_line <= 3 THEN 'trivial' ELSE 'body' END AS behaviour FROM code WHERE kind <> 'file'""")
def behaviour_classify(spark, d):
    n = code_nodes(spark, d).where(F.col("kind") != "file")
    return n.select("symbol", X.behaviour(F.col("file"), F.col("span.end_line") - F.col("span.start_line")).alias("behaviour"))


@query(f"""WITH {_CODE}, p AS (SELECT symbol, position, regexp_extract(raw, '(?:mut )?(\\w+)', 1) AS name FROM (
 SELECT symbol, unnest(regexp_split_to_array(regexp_extract(signature, '\\(([^()]*)\\)', 1), '\\s*,\\s*')) AS raw, generate_subscripts(regexp_split_to_array(regexp_extract(signature, '\\(([^()]*)\\)', 1), '\\s*,\\s*'), 1) - 1 AS position FROM code WHERE signature IS NOT NULL) WHERE regexp_extract(raw, '(?:mut )?(\\w+)', 1) <> ''),
k AS (SELECT symbol, name, file, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir FROM code), r AS (SELECT * FROM k WHERE symbol IN (SELECT symbol FROM code WHERE kind <> 'file')),
q AS (SELECT r.symbol AS ref_id, k.symbol AS target, CASE WHEN k.file = r.file THEN 0 WHEN k.dir = r.dir THEN 1 ELSE 2 END AS tier FROM r JOIN k ON k.name = r.name AND k.symbol <> r.symbol),
b AS (SELECT ref_id, min(tier) AS tier FROM q GROUP BY 1), cc AS (SELECT ref_id, min(target) AS target FROM q JOIN b USING (ref_id, tier) GROUP BY 1 HAVING count(DISTINCT target) = 1)
SELECT DISTINCT a.symbol || '#' || a.name AS source, z.symbol || '#' || z.name AS target, a.position::INT AS position FROM cc JOIN p a ON a.symbol = cc.ref_id JOIN p z ON z.symbol = cc.target AND z.position = a.position""")
def value_flow_derive(spark, d):
    n = code_nodes(spark, d)
    calls = R.resolve_scoped(_refs(spark, d), n).select(F.col("ref_id").alias("site_id"), F.col("ref_id").alias("caller"), "target")
    return X.value_flow(calls, X.parameters(n))


_NOTES = "notes AS (SELECT symbol, unnest(map_keys(metadata)) AS key, unnest(map_values(metadata)) AS value, first_seen AS ts FROM (SELECT DISTINCT symbol, metadata, first_seen FROM nodes))"


def notes(spark: SparkSession, d: str) -> DataFrame:
    """A node's metadata as annotations."""
    n = table(spark, d, "nodes", "symbol", "metadata", "first_seen").select("symbol", F.explode("metadata").alias("key", "value"), F.col("first_seen").alias("ts"))
    return n.distinct()


@query(f"WITH {_NOTES} SELECT symbol, count(*) AS n, count(DISTINCT key) AS keys, least(count(*), 20) AS inline FROM (SELECT DISTINCT * FROM notes) GROUP BY symbol")
def annotation_summary(spark, d):
    return N.annotation_summary(notes(spark, d))


@query(f"WITH {_CODE}, {_NOTES} SELECT symbol, name FROM code SEMI JOIN (SELECT symbol FROM notes WHERE key = 'visibility' AND value = 'internal') USING (symbol)")
def find_by_annotation(spark, d):
    return N.find_by_annotation(code_nodes(spark, d), notes(spark, d), "visibility", "internal").select("symbol", "name")


@query(f"WITH {_NOTES} SELECT DISTINCT symbol, key, value FROM notes WHERE ts < TIMESTAMP '2025-02-01'")
def stale_annotations(spark, d):
    a = notes(spark, d).withColumn("last_verified", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))
    return N.stale_annotations(a, 1_738_368_000).select("symbol", "key", "value").distinct()


@query("SELECT DISTINCT src_id AS source, tgt_id AS target, rel FROM typed_xedges WHERE src_store = 'knowledge' AND tgt_store = 'knowledge' AND src_id IN (SELECT node_id FROM knowledge_nodes WHERE tombstoned_at IS NULL) AND tgt_id IN (SELECT node_id FROM knowledge_nodes WHERE tombstoned_at IS NULL)")
def relate(spark, d):
    x = table(spark, d, "typed_xedges").where("src_store = 'knowledge' and tgt_store = 'knowledge'").select(F.col("src_id").alias("source"), F.col("tgt_id").alias("target"), "rel").distinct()
    return N.relate(x, table(spark, d, "knowledge_nodes").where(F.col("tombstoned_at").isNull()).select(F.col("node_id").alias("id")))


@query("""WITH r AS (SELECT DISTINCT src_id AS source, tgt_id AS target, rel, confidence, owner FROM typed_xedges)
SELECT source, target, list_sort(list(DISTINCT rel)) AS semantics, round(min(confidence), 6) AS confidence, greatest(count(DISTINCT owner) - 2, 0) AS dropped, list_slice(list_sort(list(DISTINCT owner)), 1, 2) AS supports FROM r WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL""")
def flow_merge(spark, d):
    x = table(spark, d, "typed_xedges").where("src_id is not null and tgt_id is not null").select(F.col("src_id").alias("source"), F.col("tgt_id").alias("target"), F.col("rel").alias("semantics"), "confidence", F.col("owner").alias("support"))
    return N.flow_merge(x, cap=2).withColumn("confidence", F.round("confidence", 6))


@query()
def correspond(spark, d):
    """Python functions and the Rust ones they may correspond to."""
    n = code_nodes(spark, d).where(F.col("kind") != "file")
    return N.correspond(n.where(F.col("language") == "python"), n.where(F.col("language") == "rust"))


@query()
def louvain(spark, d):
    return K.louvain(graph_nodes(spark, d), graph_edges(spark, d))


@query(f"{GRAPH_SQL}, p AS (SELECT kind AS community, file, count(*) AS n FROM n GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, file) AS r FROM p) SELECT community, sum(n)::BIGINT AS size, list(file ORDER BY r) FILTER (r <= 3) AS files FROM q GROUP BY 1")
def community_summary(spark, d):
    n = graph_nodes(spark, d)
    return K.community_summary(n.select("symbol", F.col("kind").alias("community")), n)


@query(f"{GRAPH_SQL}, c AS (SELECT kind, count(*) AS n FROM n GROUP BY 1) SELECT round(max(n) / sum(n), 6) AS largest, round(count(*) FILTER (n = 1) / count(*), 6) AS singles FROM c")
def community_fractions(spark, d):
    c = graph_nodes(spark, d).groupBy("kind").agg(F.count("*").alias("n"))
    return c.agg(F.round(F.max("n") / F.sum("n"), 6).alias("largest"), F.round(F.count(F.when(F.col("n") == 1, 1)) / F.count("*"), 6).alias("singles"))


@query(f"""WITH {_CODE}, u AS (SELECT name FROM code GROUP BY 1 HAVING count(DISTINCT symbol) = 1), r AS (SELECT DISTINCT symbol, name FROM code WHERE kind <> 'file')
SELECT count(*) AS refs, count(*) FILTER (name IN (SELECT name FROM u)) AS resolved, round(count(*) FILTER (name IN (SELECT name FROM u)) * 100.0 / nullif(count(*), 0), 4) AS pct FROM r""")
def direct_ref_resolution(spark, d):
    refs = _refs(spark, d).withColumn("from_symbol", F.lit("caller"))
    ok = R.resolve_name(refs, code_nodes(spark, d)).select("ref_id").distinct().withColumn("ok", F.lit(True))
    j = refs.select("ref_id").distinct().join(ok, "ref_id", "left")
    return j.agg(F.count("*").alias("refs"), F.count("ok").alias("resolved"), F.round(F.count("ok") * 100.0 / F.nullif(F.count("*"), F.lit(0)), 4).alias("pct"))


@query(f"""WITH {_CODE}, x AS (SELECT symbol, 0 AS stage FROM code WHERE name = 'update_shard' UNION ALL SELECT symbol, 1 FROM code WHERE contains(lower(name), 'shard'))
SELECT symbol, min(stage) AS stage FROM x GROUP BY 1 ORDER BY stage, symbol LIMIT 100""")
def name_search(spark, d):
    """Exact hits first, then those that contain the text."""
    n = code_nodes(spark, d)
    x = n.where(F.col("name") == "update_shard").select("symbol", F.lit(0).alias("stage")).unionByName(n.where(F.lower("name").contains("shard")).select("symbol", F.lit(1).alias("stage")))
    return x.groupBy("symbol").agg(F.min("stage").alias("stage")).orderBy("stage", "symbol").limit(100)


@query(f"""WITH {_CODE} SELECT split_part(scope, ':', 2) AS repo, count(*) AS n FROM code WHERE name = 'close' GROUP BY 1""")
def cross_graph_search(spark, d):
    """One exact name in every repository, tagged by repository."""
    return code_nodes(spark, d).where(F.col("name") == "close").groupBy(F.split_part("scope", F.lit(":"), F.lit(2)).alias("repo")).agg(F.count("*").alias("n"))


@query()
def entity_neighbours(spark, d):
    """Documents that a search reaches, with the capitalised words they share with the query's."""
    from spandrel.operators import memory as M
    from spandrel.plans.reference_queries import memories

    e = M.entities(memories(spark, d))
    s = _search(spark, d).select("query_id", "id")
    mine = e.select(F.col("id").alias("query_id"), "entity")
    return s.join(e, "id").join(mine, ["query_id", "entity"]).groupBy("query_id", "id").agg(F.count("*").alias("shared"))
