"""A typed property graph projected from the star-schema tables.

Every edge points from the dependent to what it depends on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.sources.tables import table


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, name, kind, file, scope); symbols are unique."""
    nation_scope = F.concat(F.lit("region:"), F.col("n_regionkey"), F.lit("/nation:"), F.col("n_nationkey"))
    nation = table(spark, d, "nation")
    where = nation.select(F.col("n_nationkey").alias("k"), nation_scope.alias("scope"))
    pick = lambda df, *c: df.select(*(x.alias(n) for x, n in zip(c, ("symbol", "name", "kind", "file", "scope"))))
    parts = [
        pick(table(spark, d, "region"), _id("region", "r_regionkey"), F.col("r_name"), F.lit("namespace"), F.lit("region"), F.concat(F.lit("region:"), F.col("r_regionkey"))),
        pick(nation, _id("nation", "n_nationkey"), F.col("n_name"), F.lit("module"), F.lit("nation"), nation_scope),
        pick(table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey").join(F.broadcast(where), F.col("k") == F.col("c_nationkey")),
             _id("customer", "c_custkey"), F.col("c_name"), F.lit("class"), F.concat(F.lit("customer/"), F.col("c_mktsegment")), F.col("scope")),
        pick(table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey").join(F.broadcast(where), F.col("k") == F.col("s_nationkey")),
             _id("supplier", "s_suppkey"), F.col("s_name"), F.lit("struct"), F.lit("supplier"), F.col("scope")),
        pick(table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type"), _id("part", "p_partkey"), F.col("p_name"), F.lit("interface"),
             F.concat_ws("/", "p_brand", "p_type"), F.lit("")),
        pick(table(spark, d, "orders", "o_orderkey", "o_orderdate"), _id("order", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey")), F.lit("function"),
             F.date_format("o_orderdate", "yyyy-MM"), F.lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, kind, confidence), one row per (source, target, kind)."""
    pick = lambda df, s, t, kind, conf: df.select(s.alias("source"), t.alias("target"), F.lit(kind).alias("kind"), conf.cast("double").alias("confidence"))
    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_discount")
    uses = items.groupBy("l_orderkey", "l_partkey").agg(F.max(F.round(1 - F.col("l_discount"), 2)).alias("conf"))
    made = items.select("l_partkey", "l_suppkey").distinct()
    parts = [
        pick(table(spark, d, "nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "imports", F.lit(1.0)),
        pick(table(spark, d, "customer", "c_custkey", "c_nationkey"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "imports", F.lit(1.0)),
        pick(table(spark, d, "supplier", "s_suppkey", "s_nationkey"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "imports", F.lit(1.0)),
        pick(table(spark, d, "orders", "o_orderkey", "o_custkey"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "calls", F.lit(0.9)),
        pick(made, _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "calls", F.lit(0.65)),
        pick(uses, _id("order", "l_orderkey"), _id("part", "l_partkey"), "calls", F.col("conf")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same projection for DuckDB, as the head of a WITH clause.
GRAPH_SQL = """WITH RECURSIVE n AS (
 SELECT 'region/' || r_regionkey AS symbol, r_name AS name, 'namespace' AS kind, 'region' AS file, 'region:' || r_regionkey AS scope FROM region
 UNION ALL SELECT 'nation/' || n_nationkey, n_name, 'module', 'nation', 'region:' || n_regionkey || '/nation:' || n_nationkey FROM nation
 UNION ALL SELECT 'customer/' || c_custkey, c_name, 'class', 'customer/' || c_mktsegment, 'region:' || n_regionkey || '/nation:' || n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey
 UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'struct', 'supplier', 'region:' || n_regionkey || '/nation:' || n_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION ALL SELECT 'part/' || p_partkey, p_name, 'interface', concat_ws('/', p_brand, p_type), '' FROM part
 UNION ALL SELECT 'order/' || o_orderkey, 'order ' || o_orderkey, 'function', strftime(o_orderdate, '%Y-%m'), '' FROM orders),
e AS (
 SELECT 'nation/' || n_nationkey AS source, 'region/' || n_regionkey AS target, 'imports' AS kind, 1.0::DOUBLE AS confidence FROM nation
 UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'imports', 1.0 FROM customer
 UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'imports', 1.0 FROM supplier
 UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey, 'calls', 0.9 FROM orders
 UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplier/' || l_suppkey, 'calls', 0.65 FROM lineitem
 UNION ALL SELECT 'order/' || l_orderkey, 'part/' || l_partkey, 'calls', max(round(1 - l_discount, 2)) FROM lineitem GROUP BY l_orderkey, l_partkey)"""
