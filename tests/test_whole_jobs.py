"""Queries and operators do the whole job: converged, all rows, all kinds."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from spandrel.operators import rank as K  # noqa: E402
from spandrel.sources.graph import graph_edges, graph_nodes  # noqa: E402
from tests.conftest import rows  # noqa: E402
from tests.test_reference_operators import edges, ids  # noqa: E402

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def power(names, pairs, seeds=(), most=30, epsilon=1e-6):
    """(scores, rounds) of the power iteration in plain Python."""
    weight = {n: 100.0 if n in seeds else 1.0 for n in names}
    t = {n: w / sum(weight.values()) for n, w in weight.items()}
    pairs = [(a, b) for a, b in pairs if a != b]
    out = dict.fromkeys(names, 0)
    for a, _ in pairs:
        out[a] += 1
    r = dict.fromkeys(names, 1 / len(names))
    for done in range(1, most + 1):
        base = 0.15 + 0.85 * sum(r[n] for n in names if not out[n])
        new = {n: base * t[n] for n in names}
        for a, b in pairs:
            new[b] += 0.85 * r[a] / out[a]
        change = sum(abs(new[n] - r[n]) for n in names)
        r = new
        if change < epsilon:
            break
    return r, done


def test_pagerank_runs_until_it_settles(spark):
    r = random.Random(3)
    names = [f"n{i}" for i in range(12)]
    pairs = [(a, r.choice(names)) for a in names for _ in range(6)]
    for seeds in ((), ("n4",)):
        want, done = power(names, pairs, seeds)
        assert 6 < done < 30
        got = dict(rows(K.pagerank(ids(spark, *names), edges(spark, *pairs), seeds=ids(spark, *seeds) if seeds else None)))
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in names)
    ring = [(f"n{i}", f"n{(i + 1) % 12}") for i in range(12)] + [("n0", "n5")]
    want, done = power(names, ring)
    got = dict(rows(K.pagerank(ids(spark, *names), edges(spark, *ring))))
    assert done == 30 and all(abs(got[n] - want[n]) < 1e-12 for n in names)


@tables
def test_pagerank_queries_run_thirty_rounds_or_settle(spark):
    n = graph_nodes(spark, DATA)
    names = [x.symbol for x in n.select("symbol").collect()]
    pairs = [(x.source, x.target) for x in graph_edges(spark, DATA).where(F.col("kind").isin("calls", "imports")).collect()]
    for query, seeds in (("pagerank", ()), ("pagerank_personalized", ("nation/3",))):
        want, _ = power(names, pairs, seeds)
        got = dict(rows(entry.queries()[query](spark, DATA)))
        assert got.keys() == want.keys() and all(abs(got[s] - want[s] * len(names)) < 1e-3 for s in names)
    want, _ = power(names, pairs)
    best = sorted(want, key=lambda s: (-round(want[s], 9), s))[:20]
    assert [x.symbol for x in entry.queries()["hotspots"](spark, DATA).collect()] == best


def merge_gains(pairs, of):
    """The greatest gain in modularity, times the number of edges, of merging two communities."""
    total, between = {}, {}
    for a, b in pairs:
        for x in (a, b):
            total[of[x]] = total.get(of[x], 0) + 1
        if of[a] != of[b]:
            key = tuple(sorted((of[a], of[b])))
            between[key] = between.get(key, 0) + 1
    return max((w - total[a] * total[b] / (2 * len(pairs)) for (a, b), w in between.items()), default=0.0)


def outvoted(pairs, of):
    """Nodes with a label that more of their neighbours bear than their own."""
    votes = {}
    for a, b in pairs + [(b, a) for a, b in pairs]:
        v = votes.setdefault(a, {})
        v[of[b]] = v.get(of[b], 0) + 1
    return [a for a, v in votes.items() if max(v.values()) > v.get(of[a], 0)]


def test_communities_settle_on_a_long_path(spark):
    names = [f"n{i:03}" for i in range(150)]
    pairs = list(zip(names, names[1:]))
    df, nodes = edges(spark, *pairs), ids(spark, *names, "alone")
    of = dict(rows(K.louvain(nodes, df)))
    assert of["alone"] == "alone" and merge_gains(pairs, of) <= 1e-9
    of = dict(rows(K.label_communities(nodes, df)))
    assert of["alone"] == "alone" and outvoted(pairs, of) == []
    with pytest.raises(RuntimeError):
        K.louvain(nodes, df, levels=1)


def test_distributed_moves_settle(spark):
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(23)]
    df, nodes = edges(spark, *pairs), ids(spark, *(f"n{i:02}" for i in range(24)))
    assert merge_gains(pairs, dict(rows(K.louvain(nodes, df, few=0)))) <= 1e-9
    assert outvoted(pairs, dict(rows(K.label_communities(nodes, df, few=0)))) == []
    with pytest.raises(RuntimeError):
        K.label_communities(nodes, df, rounds=1, few=0)


@tables
def test_community_queries_settle(spark):
    pairs = [(x.source, x.target) for x in graph_edges(spark, DATA).where(F.col("kind").isin("calls", "imports")).collect()]
    assert merge_gains(pairs, dict(rows(entry.queries()["louvain"](spark, DATA)))) <= 1e-9
    assert outvoted(pairs, dict(rows(entry.queries()["communities"](spark, DATA)))) == []


@tables
def test_source_definitions_cover_every_language_with_a_pattern(spark):
    import re

    from spandrel.operators.extract import DEFINITIONS
    from spandrel.plans.more_queries import texts

    by = {"py": "python", "rs": "rust", "go": "go", "rb": "ruby", "js": "javascript", "ts": "typescript", "java": "java", "sh": "shell"}
    want = {}
    for t in texts(spark, DATA).collect():
        language = by.get(t.path.rpartition(".")[2])
        for name in re.findall(DEFINITIONS[language], t.text, re.A) if language and t.text else ():
            want[t.path, name] = want.get((t.path, name), 0) + 1
    got = {(x.path, x.name): x.n for x in entry.queries()["source_definitions"](spark, DATA).collect()}
    assert got == want and {"js", "ts", "java", "sh"} <= {p.rpartition(".")[2] for p, _ in want}


@tables
def test_fuzzy_candidates_probe_with_every_name(spark):
    import re

    names = {re.sub(r"[\W_]+", " ", x.name.lower()).strip() for x in entry.queries()["scan_nodes"](spark, DATA).where("name is not null").collect()} - {""}
    grams = {n: {f"  {n} "[i : i + 3] for i in range(len(n) + 1)} for n in names}
    want = {(a, b) for a in names for b in names if len(grams[a] & grams[b]) >= 0.6 * len(grams[a] | grams[b]) - 1e-12}
    assert {(x.probe, x.name) for x in entry.queries()["fuzzy_candidates"](spark, DATA).collect()} == want


@tables
def test_kmeans_query_reaches_its_fixed_point(spark):
    import numpy as np

    v = {x.vec_id: np.array(x.embedding, float) for x in spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding is not null").collect()}
    of = {x.id: x.cluster for x in entry.queries()["kmeans_cosine"](spark, DATA).collect()}
    assert set(of.values()) == set(range(16))
    m = np.array([np.mean([v[i] for i in of if of[i] == c], axis=0) for c in range(16)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert all(of[i] == int(np.round(m @ (x / np.linalg.norm(x)), 12).argmax()) for i, x in v.items())


def test_correspond_scores_names_tied_at_the_edge_of_the_pool(spark):
    from spandrel.operators import knowledge as N

    s = "symbol string, name string, kind string, signature string"
    left = spark.createDataFrame([("l", "load_chunk", "function", "load_chunk(path, size)")], s)
    right = spark.createDataFrame([(f"r{i:02}", f"load_a{i:02}", "function", "f()") for i in range(30)] + [("z", "load_zz", "function", "load_chunk(path, size)")], s)
    got = N.correspond(left, right, k=1).collect()
    assert [(x.match, x["rank"]) for x in got] == [("z", 1)]


@tables
def test_correspond_query_gives_up_to_twenty(spark):
    n = entry.queries()["correspond"](spark, DATA.replace("0.001", "0.01")).groupBy("symbol").count().agg(F.max("count")).first()[0]
    assert 5 < n <= 20


def test_a_longer_query_vector_leaves_the_others_their_neighbours(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0])], "id bigint, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0, 0.0]), (5, [])], "query_id bigint, v array<double>")
    assert [(x.query_id, x.id) for x in K.vector_nearest(v, q).orderBy("query_id", "rank").collect()] == [(1, 1), (1, 2), (3, 3)]
