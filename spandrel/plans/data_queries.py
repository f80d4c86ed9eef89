"""Queries of the data-maintenance operators over an estate's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spandrel.operators.incremental import changed_by_run
from spandrel.operators.references import estate_references, estate_targets, orphan_references, orphan_report
from spandrel.operators.snapshots import source_changes
from spandrel.sources.tables import table

def p2_found(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files", "obs_id", "path", "digest", "git_sha", "observed_at", "arrived_at")
    return changed_by_run(files, table(spark, d, "index_runs", "run_id", "started_at", "status"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return source_changes(table(spark, d, "source_generations", "source_id", "generation", "catalog", "docs"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = estate_references(
        table(spark, d, "typed_xedges", "edge_id", "src_store", "src_id", "src_epoch", "tgt_store", "tgt_id", "tgt_epoch", "asserted_at"),
        table(spark, d, "orphaned_edges", "report_id", "to_id", "reported_at"))
    return orphan_references(refs, estate_targets(
        table(spark, d, "nodes", "symbol", "epoch", "first_seen", "removed_at"),
        table(spark, d, "knowledge_nodes", "node_id", "epoch", "created_at", "tombstoned_at")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "ref_field", "state")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p6_found": p6_found, "p6_report": p6_report}

_PLAIN = r"regexp_replace(regexp_replace(regexp_replace({0}, '[\\/]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '')"

_P2 = f"""
WITH f AS (SELECT obs_id, {_PLAIN.format('path')} AS path, nullif(lower(trim(digest)), '') AS digest, git_sha, observed_at, arrived_at FROM files),
k AS (SELECT git_sha, min(digest) AS known FROM f WHERE digest IS NOT NULL GROUP BY 1),
r AS (SELECT f.*, coalesce(f.digest, k.known, 'sha:' || f.git_sha, '') AS content FROM f LEFT JOIN k USING (git_sha)),
s AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS i FROM index_runs WHERE status = 'succeeded'),
v AS (SELECT s.i, s.run_id, r.path, arg_max(r.content, (r.observed_at, r.arrived_at, r.obs_id)) AS content
      FROM s JOIN r ON r.arrived_at <= s.started_at GROUP BY ALL)
SELECT a.run_id, a.path FROM v a LEFT JOIN v b ON b.path = a.path AND b.i = a.i - 1 WHERE b.path IS NULL OR a.content <> b.content"""

# entry values: member order is put aside by comparing the sorted list of (path, value) leaves
_P5 = """
WITH d AS (SELECT source_id, generation, docs FROM source_generations
  WHERE len(list_distinct([x.key FOR x IN docs])) = (catalog->>'$.doc_count')::BIGINT),
g AS (SELECT source_id, generation, lag(generation) OVER (PARTITION BY source_id ORDER BY generation) AS prev FROM (SELECT DISTINCT source_id, generation FROM d)),
x AS (SELECT source_id, generation, unnest(docs) AS doc FROM d),
e AS (SELECT source_id, generation, doc.key AS doc_key, doc.title AS title, doc.entry AS entry,
      list_sort(list_distinct([to_json([s.key, s.text])::VARCHAR FOR s IN doc.sections])) AS secs FROM x),
leaf AS (SELECT DISTINCT e.entry, t.fullkey AS k, t.type AS ty, t.atom::VARCHAR AS a FROM (SELECT DISTINCT entry FROM e) e, json_tree(e.entry) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')),
canon AS (SELECT entry, list(k || '=' || CASE WHEN ty = 'VARCHAR' THEN 's' ELSE '' END || coalesce(a, 'null') ORDER BY k) AS c FROM leaf GROUP BY 1),
h AS (SELECT source_id, generation, doc_key, min(md5(to_json([to_json(title)::VARCHAR, to_json(coalesce(c, [e.entry]))::VARCHAR, to_json(secs)::VARCHAR])::VARCHAR)) AS h
      FROM e LEFT JOIN canon USING (entry) GROUP BY ALL),
n AS (SELECT h.source_id, g.generation, h.doc_key, h.h FROM h JOIN g USING (source_id, generation) WHERE g.prev IS NOT NULL),
o AS (SELECT h.source_id, g.generation, h.doc_key, h.h FROM h JOIN g ON g.source_id = h.source_id AND g.prev = h.generation)
SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.generation, o.generation) AS generation, coalesce(n.doc_key, o.doc_key) AS doc_key,
 CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.source_id = o.source_id AND n.generation = o.generation AND n.doc_key = o.doc_key
WHERE o.h IS NULL OR n.h IS NULL OR o.h <> n.h"""

_TRIM = r"nullif(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')"
_P6 = f"""
WITH r AS (
 SELECT 'typed_xedges' AS ref_table, edge_id AS ref_id, 'src_id' AS ref_field, src_store AS store, {_TRIM.format('src_id')} AS id, src_epoch AS epoch, asserted_at AS "at" FROM typed_xedges
 UNION ALL SELECT 'typed_xedges', edge_id, 'tgt_id', tgt_store, {_TRIM.format('tgt_id')}, tgt_epoch, asserted_at FROM typed_xedges
 UNION ALL SELECT 'orphaned_edges', report_id, 'to_id', 'knowledge', {_TRIM.format('to_id')}, NULL, reported_at FROM orphaned_edges),
t AS (SELECT 'estate' AS store, symbol AS id, bool_and(removed_at IS NOT NULL) AS gone, list(DISTINCT epoch) AS epochs, min(first_seen) AS since FROM nodes GROUP BY 2
 UNION ALL SELECT 'knowledge', node_id, bool_and(tombstoned_at IS NOT NULL), list(DISTINCT epoch), min(created_at) FROM knowledge_nodes GROUP BY 2),
s AS (SELECT r.*, CASE WHEN t.id IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN epoch IS NOT NULL AND NOT list_contains(epochs, epoch) THEN 'stale' WHEN since > "at" THEN 'late' END AS state
 FROM r LEFT JOIN t ON t.store = r.store AND t.id = r.id WHERE r.id IS NOT NULL AND r.store <> 'control')"""

ORACLE = {
    "p2_found": _P2, "p5_found": _P5,
    "p6_found": f"{_P6} SELECT ref_table, ref_id, ref_field, state FROM s WHERE state IS NOT NULL",
    "p6_report": f"""{_P6} SELECT ref_table, ref_field, strftime("at", '%Y-%m') AS period, state, count(*) AS n FROM s WHERE state IS NOT NULL GROUP BY ALL""",
}
