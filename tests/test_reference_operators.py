"""Walks, ranking, resolvers, search and memories on hand-made graphs and against plain Python."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spandrel.operators import graph as G
from spandrel.operators import lookup as L
from spandrel.operators import memory as M
from spandrel.operators import rank as K
from spandrel.operators import resolve as R
from spandrel.operators import supports as S
from spandrel.operators import textsearch as T
from tests.conftest import rows

E = "source string, target string, kind string, confidence double"


def edges(spark, *pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, 1.0) for a, b in pairs], E)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def test_walks_against_brute_force(spark):
    r = random.Random(1)
    pairs = [(f"v{r.randrange(40)}", f"v{r.randrange(40)}") for _ in range(90)]
    df = edges(spark, *pairs)
    for direction in ("in", "out", "both"):
        want = {}
        for d in ("in", "out") if direction == "both" else (direction,):
            depth, frontier = {"v0": 0, "v1": 0}, {"v0", "v1"}
            for h in range(1, 4):
                step = {a if d == "in" else b for a, b in pairs if (b if d == "in" else a) in frontier} - depth.keys()
                depth |= dict.fromkeys(step, h)
                frontier = step
            for k, v in depth.items():
                if v:
                    want[k] = min(v, want.get(k, 99))
        assert dict(rows(G.traverse(df, ids(spark, "v0", "v1", "v0"), direction, 3))) == want
    assert G.traverse(df, ids(spark), "in", 3).count() == 0


def test_diamond_cycle_path_and_horizon(spark):
    df = edges(spark, ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), ("x", "x"))
    reached = G.traverse(df, ids(spark, "a"), "in", 2, keep_seeds=True)
    assert dict(rows(reached)) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert not G.depth_horizon(df, reached, 2).first()[0]
    assert G.depth_horizon(df, G.traverse(df, ids(spark, "a"), "in", 1, keep_seeds=True), 1).first()[0]
    assert [x[1:3] for x in rows(G.shortest_path(df, ids(spark, "d"), ids(spark, "a")))] == [("d", "b"), ("b", "a")]
    assert rows(G.shortest_path(df, ids(spark, "a"), ids(spark, "a"))) == [] == rows(G.shortest_path(df, ids(spark, "a"), ids(spark, "x")))
    assert rows(G.predecessor_via(df, reached).select("symbol", "via_target")) == [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=25))
def test_components_and_pagerank_laws(spark, pairs):
    named = [(f"n{a:02}", f"n{b:02}") for a, b in pairs]
    parent = {x: x for p in named for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in named:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    df = edges(spark, *named)
    assert dict(rows(K.connected_components(df))) == {x: find(x) for x in parent}
    rank = K.pagerank(ids(spark, *parent), df, iterations=4)
    assert abs(rank.agg(F.sum("score")).first()[0] - 1) < 1e-9


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1), 0.01 * i]) for i in range(9)] + [(9, [0.0, 0.0, 0.0]), (10, None), (11, [1.0])], "id bigint, v array<float>")
    near = K.vector_nearest(v, v.where("id = 0").withColumnRenamed("id", "query_id"), 3)
    assert [r.id for r in near.orderBy("rank").collect()] == [0, 3, 6]
    full = v.where("id < 9")
    assert len({r.cluster for r in K.kmeans_cosine(full, 3).collect()}) == 3
    assert {r.cluster for r in K.dbscan_cosine(full, 0.1, 3).collect()} == {0, 1, 2}


def test_resolvers(spark):
    nodes = spark.createDataFrame([("a", "f", "function", "p/x.py"), ("b", "f", "function", "p/y.py"), ("c", "g", "function", "q/z.py"), ("r", "db", "resource", "t.tf")], "symbol string, name string, kind string, file string")
    refs = spark.createDataFrame([(1, "m", "f", "p/x.py"), (2, "m", "f", "p/w.py"), (3, "m", "g", "k/l.py"), (4, "c", "g", "q/z.py"), (5, "m", None, "a"), (6, "m", "db", "a")], "ref_id int, from_symbol string, raw_name string, file string")
    assert [x[:2] for x in rows(R.resolve_name(refs, nodes))] == [(3, "c"), (6, "r")]
    assert [x[:3] for x in rows(R.resolve_scoped(refs, nodes))] == [(1, "a", 0.65), (3, "c", 0.6), (6, "r", 0.62)]
    assert [x[:2] for x in rows(R.resolve_infra(refs, nodes))] == [(6, "r")]
    files = spark.createDataFrame([("p/u.ts",), ("p/u/index.ts",), ("v.js",)], "path string")
    imports = spark.createDataFrame([(1, "./u", "p/x.ts"), (2, "./u/", "p/x.ts"), (3, "../v", "p/x.ts"), (4, "../../v", "p/x.ts"), (5, "v", "p/x.ts")], "ref_id int, raw_name string, file string")
    assert [x[:2] for x in rows(R.resolve_relative_import(imports, files))] == [(1, "p/u.ts"), (2, "p/u/index.ts"), (3, "v.js")]


def test_glob_drift_and_merges(spark):
    assets = spark.createDataFrame([("a.b.c",), ("a.x",), ("q",), (None,)], "asset string")
    profiles = spark.createDataFrame([("a.**",), ("a.b.c",), ("**",), ("a.%",)], "profile string")
    assert rows(R.resolve_glob(assets, profiles)) == [("a.b.c", "a.b.c", 1.0), ("a.x", "a.%", 0.5), ("q", "**", 0.5)]
    n = lambda *x: spark.createDataFrame([(y,) for y in x], "name string")
    assert rows(R.drift(n("A[0]", "b", None), n("a", "c"))) == [("a", "managed"), ("b", "undeployed"), ("c", "unmanaged")]
    s = "source string, target string, kind string, confidence double, evidence_count bigint"
    old = spark.createDataFrame([("a", "b", "k", 0.9, 1), ("c", "d", "k", 0.9, 1)], s)
    new = spark.createDataFrame([("a", "b", "k", 0.5, 1), ("c", "d", "k", 0.5, 2), ("e", "f", "k", 0.1, 1)], s)
    assert [x[3:] for x in rows(R.edge_upsert_merge(old, new))] == [(0.9, 1), (0.5, 2), (0.1, 1)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, None), (4, ""), (5, "alpha " * 3000)], "id bigint, text string")
    index = T.postings(docs)
    q = spark.createDataFrame([(1, "beta"), (1, "beta"), (1, "nix")], "query_id int, term string")
    assert [r.id for r in T.bm25(index, q).orderBy("rank").collect()] == [1, 2]
    names = [f"get_{a}_{b}" for a in ("node", "edge", "span") for b in ("list", "lists", "map")] + ["", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {tuple(x[:2]) for x in rows(T.fuzzy_candidates(df, df.withColumnRenamed("name", "probe"), 0.6))}

    def grams(s):
        s = f"  {s} "
        return {s[i : i + 3] for i in range(len(s) - 2)}

    plain = [n.replace("_", " ") for n in names if n]
    assert got == {(a, b) for a in plain for b in plain if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.6}
    nodes = spark.createDataFrame([("s1", "load_chunk"), ("s2", "load_chunks"), ("s3", "Load_Chunk")], "symbol string, name string")
    probes = spark.createDataFrame([("LOAD_CHUNK",), ("laod_chunk",), ("mod::load_chunks",), (None,)], "probe string")
    best = {r.probe: (r.symbol, r.tier) for r in T.name_suggest(nodes, probes).where("rank = 1").collect()}
    assert best == {"LOAD_CHUNK": ("s3", 0), "laod_chunk": ("s3", 3), "mod::load_chunks": ("s2", 1)}
    assert T.osa_distance("abcd", "acbd") == 1 and T.osa_distance("", "ab") == 2


def test_text_helpers():
    assert T.chunk_markdown("# a\nx\n```\n# no\n```\n## b\ny") == ["# a\nx\n```\n# no\n```", "## b\ny"]
    assert [len(c.split()) for c in T.chunk_markdown("w " * 1700, 800)] == [800, 800, 100] and T.chunk_markdown(None) == []
    assert T.fnv1a(b"a") == 0xE40C292C and sum(T.hash_embed("")) == 0
    assert L.ancestors("a/b") == ["", "a", "a/b"] and R.glob_regex("a.*") == r"^a\.[^.]*$"


def test_budgets_and_memory(spark):
    r = spark.createDataFrame([(1, 10, 1, 50), (1, 11, 2, 60), (1, 12, 3, 40), (1, 13, 4, 10)], "query_id int, id bigint, rank int, cost int")
    assert [x[2] for x in rows(M.budget_pack(r, 100))] == [10, 12, 13]
    assert [x[1] for x in rows(M.budget_prefix(r, 100))] == [10]
    w = spark.range(1).select(M.wilson_lower_bound(F.lit(0.0), F.lit(0)).alias("a"), M.decay(F.lit(-1.0)).alias("b"), M.salience(F.lit(9.0), F.lit(1.0), F.lit(999)).alias("c")).first()
    assert tuple(w) == (0.0, 1.0, 1.0)
    facets = spark.createDataFrame([(1, {"a": "x"}), (2, {}), (3, {"b": "y"})], "id int, facets map<string,string>")
    assert rows(facets.where(L.facet_admits(F.col("facets"), {"a": "x"})).select("id")) == [(1,), (2,)]


def test_plans_and_scopes(spark):
    k = lambda *x: spark.createDataFrame([(y,) for y in x], "k string")
    assert rows(S.plan_replacement(k("a", "b"), k("b", "c", "c"), ["k"])) == [("a", "delete"), ("b", "keep"), ("c", "insert")]
    s = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("",)], "scope string")
    assert rows(s.where(L.in_scope("scope", "a"))) == [("a",), ("a/b",)] and s.where(L.in_scope("scope", "")).count() == 4
    assert rows(s.where(L.above("scope", "a/b"))) == [("",), ("a",), ("a/b",)]
