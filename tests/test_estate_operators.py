"""Reads, contexts, upkeep, recall, redaction, resolvers and paging on small cases."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spandrel.operators import context as C
from spandrel.operators import lookup as L
from spandrel.operators import memory as M
from spandrel.operators import rank as K
from spandrel.operators import reads as R
from spandrel.operators import recall as Q
from spandrel.operators import redaction as D
from spandrel.operators import resolve as V
from spandrel.operators import supports as S
from spandrel.operators import upkeep as U
from spandrel.sources import connectors as X
from tests.conftest import rows
from tests.test_reference_operators import edges, ids


def test_reads(spark):
    n = spark.createDataFrame([("a", "f", "function", "x/a.py", 9), ("b", "g", "parameter", "x/test/b.py", 1), ("c", None, None, None, None)], "symbol string, name string, kind string, file string, lines int")
    assert rows(R.get_node(n, "a").select("symbol")) == [("a",)] and R.get_node(n, "z").count() == 0
    assert rows(R.find_structural(n, 1).select("symbol")) == [("a",)] and R.find_structural(n).count() == 2
    assert rows(n.where(R.shown(trivial_lines=2)).select("symbol")) == [("a",), ("c",)] and n.where(R.shown(tests=True, ignored=["g"])).count() == 2
    assert R.clamp(5, "search") == (5, None) and R.clamp(500, "search")[0] == 100 and "500" in R.clamp(500, "search")[1]
    flags = spark.createDataFrame([(None,), (True,)], "truncated boolean")
    assert rows(R.truncated(flags)) == [(True,)] and rows(R.truncated(flags.where("false"))) == [(False,)]
    notes = spark.createDataFrame([("a", "k", "1", "advisory", 1), ("a", "k", "2", None, 5), ("a", "q", "3", None, 9), ("z", "k", "4", None, 1)], "symbol string, key string, value string, type string, ts int")
    o = R.annotation_overview(notes, 2).where("symbol = 'a'").first()
    assert (o.n, o.has_advisory, [x.value for x in o.inline], [tuple(x) for x in o.by_type]) == (3, True, ["1", "3"], [("", 2), ("advisory", 1)])
    assert R.annotations_of(notes, ids(spark, "a", "a")).count() == 3 and rows(R.retrieve_entity(n, ids(spark, "a", "c"), notes).select("symbol", "notes")) == [("a", 3), ("c", 0)]
    probes = spark.createDataFrame([("f",), ("ff",), (None,)], "probe string")
    s = spark.createDataFrame([("ff", "a", 1), ("ff", "b", 2)], "probe string, symbol string, rank int")
    assert rows(R.did_you_mean(probes, n, s)) == sorted([("f", True, []), ("ff", False, ["a", "b"]), (None, False, [])], key=repr)
    assert rows(R.nodes_export(n, kinds=("function",), annotations=notes, key="k").select("symbol")) == [("a",)]


def test_contexts(spark):
    e = edges(spark, ("b", "a"), ("c", "b"), ("d", "c"), ("e", "a"), ("e", "a"))
    n = spark.createDataFrame([(x, x * 10, "function", f"{x}.py") for x in "abcdef"] + [("g", None, None, None)], "symbol string, name string, kind string, file string")
    got = C.render_context(n, e, ids(spark, "a"), budget=20, depth=2)
    assert [r.symbol for r in got.orderBy("position").collect()][0] == "a" and {r.symbol for r in got.collect()} < set("abce")
    assert {r.symbol for r in C.render_context(n, e, ids(spark, "a")).collect()} == set("abce") and C.render_context(n, e, ids(spark)).count() == 0
    b = C.budget_context(n, e, ids(spark, "a"), ids(spark, "f", "b"), 250)
    assert [(r.symbol, r.score) for r in b.orderBy("position").collect()] == [("e", 4.0), ("b", 2.0)]
    src = spark.createDataFrame([("g", "a", "x" * 5), ("g", "b", "y" * 9), ("g", "c", "z" * 4), ("h", "d", None)], "group string, symbol string, source string")
    assert rows(C.source_bundle(src, 10)) == [("g", 0, "a"), ("g", 1, "c")]
    reached = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "symbol string, depth int")
    repos = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "q")], "symbol string, repo string")
    assert rows(C.crossings(e, reached, repos)) == [("b", "a", 1)]
    assert C.refine_horizon(e, reached, ids(spark, "d"), 2).first()[0] and not C.refine_horizon(e, reached, ids(spark, "f"), 2).first()[0]
    v = C.graph_view(n, e, spark.createDataFrame([(x, 1.0 / (1 + i)) for i, x in enumerate("abcdef")], "symbol string, score double"), limit=4)
    assert rows(v) == [("a", 2), ("b", 2), ("c", 1), ("e", 1)]
    f = C.graph_view(n, e, spark.createDataFrame([(x, 1.0) for x in "abcdef"], "symbol string, score double"), focus=ids(spark, "f"))
    assert rows(f) == [("f", 0)]


def test_upkeep(spark):
    c = spark.createDataFrame([("s", "a", 1), ("s", "b", 0), ("t", "a", 1), (None, "a", 1), ("u", "b", None), ("u", "b", None)], "symbol string, file string, is_def int")
    e = spark.createDataFrame([("s", "u", "calls", "b"), ("u", "t", "calls", "b"), ("s", "u", "calls", "a")], "source string, target string, kind string, file string")
    out = U.remove_files(c, e, spark.createDataFrame([("a",), ("zz",), (None,)], "file string"))
    assert rows(out["rehomed"]) == [("s", "b")] and rows(out["gone"]) == [("t",)] and rows(out["edges"]) == [("s", "u", "calls", "b")] and out["archived"].count() == 2
    s = "owner string, generation bigint, source string, target string, kind string, fact_id string, confidence double, evidence_count bigint"
    old = spark.createDataFrame([("o", 2, "a", "b", "k", "1", 0.5, 1), ("p", 1, "a", "b", "k", "2", 0.9, 1)], s)
    new = spark.createDataFrame([("a", "c", "k", "3", 0.7, 1)], "source string, target string, kind string, fact_id string, confidence double, evidence_count bigint")
    after, public = U.replace_supports(old, new, "o", 3)
    assert rows(public.select("source", "target", "confidence")) == [("a", "b", 0.9), ("a", "c", 0.7)] and after.count() == 2
    same = old.where("owner = 'o'").drop("owner", "generation")
    assert rows(U.replace_supports(old, same, "o", 2)[0]) == rows(old)
    for g, facts in ((1, new), (2, new)):
        with pytest.raises(ValueError):
            U.replace_supports(old, facts, "o", g)
    fresh = spark.createDataFrame([("a", None, None), ("b", "own", None)], "symbol string, description string, validated boolean")
    was = spark.createDataFrame([("a", "said", True), ("a", "said", True), ("b", "old", False)], "symbol string, description string, validated boolean")
    assert rows(U.restore_semantics(fresh, was)) == [("a", "said", True), ("b", "own", False)]
    a = spark.createDataFrame([("a", "k", "v", 1), ("a", "q", "v", 1), ("b", "k", "v", 2)], "symbol string, key string, value string, ts int")
    assert rows(U.annotate(a, a.withColumn("ts", F.lit(7)).where("symbol = 'a'")).select("symbol", "ts")) == [("a", 7), ("a", 7), ("b", 2)]
    d = spark.createDataFrame([("a", "q"), ("b", None)], "symbol string, key string")
    assert rows(U.delete_annotations(a, d)) == [("a", "k", "v", 1)]
    assert rows(U.set_semantics(was, fresh.where("symbol = 'b'")).select("symbol", "description")) == [("a", "said"), ("a", "said"), ("b", "own")]
    bound = spark.createDataFrame([("a", "b", "calls", "f", "scoped"), ("a", "c", "calls", "f", "parsed"), ("a", "d", "calls", "g", "scoped")], "source string, target string, kind string, name string, resolved_by string")
    assert [x[1] for x in rows(U.surviving_bindings(bound, spark.createDataFrame([("f",), ("f",)], "name string")))] == ["c", "d"]
    with pytest.raises(ValueError):
        U.scoped_to_repo(a, "x/y", "symbol")
    log = U.log_changes(spark.createDataFrame([(4, "w", "a", 1)], "seq bigint, op string, target string, ts bigint"), spark.createDataFrame([("w", "b"), ("d", "c")], "op string, target string"), 9)
    assert log.where("seq > 4").count() == 2 == log.where("seq > 4").select("seq").distinct().count()
    assert rows(U.cached(spark.createDataFrame([("k", 1), ("k", 2)], "key string, version int"), 2)) == [("k", 2)]


def test_keyword_candidates_against_brute_force(spark):
    r = random.Random(4)
    vocab = ["edge", "node", "walk", "the", "span", "of", "a", "fold"]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 9)))) for i in range(40)] + [(90, None), (91, "")]
    qs = [(1, "walk the edge"), (2, "the of"), (3, "node"), (4, None), (5, "edge edge node")]
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    full = {i: words(t) for i, t in docs if words(t)}
    n, avg = len(full), sum(map(len, full.values())) / len(full)

    def top(scored, k=32):
        return {d: i + 1 for i, (d, _) in enumerate(sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k])}

    want = {}
    for q, t in qs:
        lists = []
        for w in set(words(t)) - set(Q.FUNCTION_WORDS):
            if len(w) < 2:
                continue
            df = sum(w in ws for ws in full.values())
            sc = {d: round(math.log(1 + (n - df + 0.5) / (df + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / avg)), 6) for d, ws in full.items() if w in ws}
            lists.append(top(sc))
        p = words(t)
        if len(p) > 1:
            hits = {d: sum(ws[i : i + len(p)] == p for i in range(len(ws))) for d, ws in full.items()}
            lists.append(top({d: c for d, c in hits.items() if c}))
        fused = Counter()
        for x in lists:
            for d, rank in x.items():
                fused[d] += 1 / (60 + rank)
        for d, rank in top({d: round(s, 9) for d, s in fused.items()}).items():
            want[q, d] = rank
    got = Q.keyword_candidates(spark.createDataFrame(docs, "id bigint, text string").withColumn("term", F.lit("x")), spark.createDataFrame(qs, "query_id int, text string"))
    assert {(x.query_id, x.id): x["rank"] for x in got.collect()} == want


MEM = "id bigint, content string, scope string, tier string, created bigint, accesses bigint, good bigint, confidence double, invalid_at bigint, last_access bigint, facets map<string,string>"


def test_recall_gates_and_life_cycle(spark):
    m = spark.createDataFrame([
        (1, "Alpha walks the edge. It folds.", "a/b", "episodic", 0, 3, 6, 0.9, None, None, {}), (2, "alpha walks", "a", "semantic", 0, 3, 3, 0.9, None, None, {"lang": "py"}), (3, "alpha walks", "c", "semantic", 0, 3, 3, 0.9, None, None, {}),
        (4, "alpha walks", "operator:x", "semantic", 0, 9, 9, 0.9, None, None, None), (5, "alpha walks", "", "working", -90_000, 0, 0, 0.1, None, None, {}), (6, None, None, "semantic", 0, 0, 0, 0.0, None, None, {})], MEM)
    q = spark.createDataFrame([(7, "alpha walks", "a/b")], "query_id int, text string, scope string")
    got = lambda **k: sorted(x.id for x in Q.memory_recall(m, q, 100, 1_000, **k).collect())
    assert got() == [1, 4] and got(facets={"lang": "py"}) == [1, 2, 4] and got(facets={"lang": "py"}, subtree=True) == [1] and got(mode="graph", graph=spark.createDataFrame([(7, 1, 1)], "query_id int, id bigint, rank int")) == [1]
    assert got(floor=2.0) == []
    with pytest.raises(ValueError):
        got(mode="psychic")
    links = spark.createDataFrame([(1, "n"), (1, "n"), (2, "k")], "id bigint, target string")
    assert rows(Q.about(links, spark.createDataFrame([(7, "n")], "query_id int, target string"))) == [(7, 1, 1)]
    assert Q.capture(m, m).count() == 6 and rows(Q.erase(m, scope="a").select("id")) == [(3,), (4,), (5,), (6,)]
    with pytest.raises(ValueError):
        Q.erase(m)
    gone = Q.retire(m, m.where("id = 3").select("id"), 5)
    assert rows(gone.where("invalid_at is not null").select("id")) == [(3,)] and Q.retire(gone, m.select("id"), None).where("invalid_at is not null").count() == 0
    flat = m.withColumn("facets", F.lit(""))
    out = Q.consolidate(flat, spark.createDataFrame([("fact", "It folds", "a/b", "")], "kind string, content string, scope string, facets string"), 100)
    assert out["memories"].count() == 5 and rows(out["items"].select("kind", "content")) == [("entity", "Alpha"), ("entity", "It"), ("fact", "Alpha walks the edge")]
    assert out["promote_from"] == 0.3 and rows(out["links"].groupBy("rel").count()) == [("derived_from", 2), ("mentions", 2)]
    names = spark.createDataFrame([("Node Store", "x"), ("node  store.", "x"), ("node store", "y"), ("Nodes", "x"), (None, "x")], "name string, facets string")
    assert {(x.name, x.facets): x.entity for x in Q.entity_merge(names).collect()} == {("Node Store", "x"): "Node Store", ("node  store.", "x"): "Node Store", ("node store", "y"): "node store", ("Nodes", "x"): "Nodes"}
    pack = lambda *x: spark.createDataFrame(list(x), "id string, hash string")
    assert rows(Q.apply_pack(pack(("a", "1"), ("b", "1"), ("c", None)), pack(("b", "2"), ("c", None), ("d", "1")))) == [("a", "remove"), ("b", "update"), ("c", "keep"), ("d", "insert")]
    assert rows(M.reinforce(m, spark.createDataFrame([(1,), (1,)], "id bigint"), 5).where("last_access = 5").select("id", "accesses", "good")) == [(1, 5, 8)]
    assert rows(M.promote(m.withColumn("accesses", F.col("good")), 0.3).select("id")) == [(1,), (4,)]


def test_knowledge(spark):
    docs = spark.createDataFrame([(1, "# a\nalpha beta\n# b\ngamma"), (2, "alpha"), (3, None)], "id bigint, text string")
    nodes, ties = Q.knowledge_ingest(docs)
    assert rows(nodes.groupBy("class_name").count()) == [("doc", 3), ("piece", 3)] and rows(ties.select("source", "target")) == [("1#0", "1"), ("1#1", "1"), ("2#0", "2")]
    k = nodes.select("node_id", F.lit("s").alias("source_id"), F.lit("source:s/x").alias("scope"))
    assert rows(Q.knowledge_forget(k, ids=spark.createDataFrame([("1",), ("2#0",)], "i string")).select("node_id")) == [("2",), ("3",)]
    assert Q.knowledge_forget(k, source="s").count() == 0 == Q.knowledge_forget(k, scope="source:").count()
    q = spark.createDataFrame([(9, "alpha beta"), (8, None)], "query_id int, text string")
    assert [(x.query_id, x.doc, x.chunk) for x in Q.knowledge_recall(docs, q, docs.where("id = 1").select("id", "text")).collect()] == [(9, 1, 0)]
    l = spark.createDataFrame([("o", 1, "1", "2", "r"), ("o", 2, "1", "2", "r"), ("o", 2, "1", "1", "r"), ("o", 2, "1", "9", "r"), ("o", 2, "1", "2", None)], "owner string, generation int, source string, target string, rel string")
    good, bad = Q.doc_links(l, nodes.select(F.col("node_id").alias("id")), ("r",))
    assert [x[1] for x in rows(good)] == [2] and sorted(x.wrong for x in bad.collect()) == ["loop", "relation", "target"]


def test_redaction():
    assert D.redact_shapes("a ghp_" + "x1" * 20 + "!") == "a " + "*" * 44 + "!" and D.redact_shapes("git@host https://git@h/x https://u:p@h/x") == "git@host https://git@h/x https://***@h/x"
    key = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    assert D.redact_shapes(key) == key.replace("abc", "***")
    assert D.redact_free_text('dbPassword = "hun ter", user: me, API_KEY=zz; the token ring') == 'dbPassword = "*******", user: me, API_KEY=**; the token ring'
    assert D.value_ranges("ab12" * 8) == [(0, 32)] and D.value_ranges("plain words only, nothing-else") == [] and D.value_ranges("Zx9" * 6) == [(0, 18)]
    assert D.redact_config('{"a": "Zz 9", "b": "on", "c": 1}', "x.json") == '{"a": "****", "b": "on", "c": 1}' and D.redact_config("k: v9/x # c\nn: 3\n", "a.yml") == "k: **** # c\nn: 3\n"
    assert D.merged([(3, 5), (0, 4), (7, 8)]) == [(0, 5), (7, 8)] and D.mask("", []) == "" and D.entropy("") == 0 and D.entropy("ab") == 1.0
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice(["password=", "é", " ", "\n", "ghp_", "a1B2", '"', "://", "@", "token: "]) for _ in range(12))
        for f in (D.redact_free_text, D.redact_shapes, D.redact_values):
            assert len(f(t)) == len(t)


def test_more_resolvers(spark):
    n = spark.createDataFrame([("s1", "rs", "rule_set", "drl"), ("s2", "rs2", "rule_set", "drl"), ("m", "PAY", "module", "cobol"), ("m2", "dup", "module", "cobol"), ("m3", "DUP", "module", "pli"), ("r", "db", "resource", ""), ("c", "db", "function", "py")], "symbol string, name string, kind string, language string")
    ref = lambda *x: spark.createDataFrame([(i, f, r) for i, (f, r) in enumerate(x)], "ref_id int, from_symbol string, raw_name string")
    assert rows(V.resolve_rules_bridge(ref(("s1", "rules-engine:x"), ("q", "rules-engine:x"), ("q", "other")), n).select("ref_id", "target")) == [(0, "s2"), (1, "s1"), (1, "s2")]
    assert rows(V.resolve_dynamic_call(ref(("q", "dynamic:pay"), ("q", "dynamic:dup"), ("m", "dynamic:pay"), ("q", None)), n).select("ref_id", "target")) == [(0, "m")]
    assert rows(V.resolve_infra(ref(("q", "db"), ("r", "db"), ("s1", "db")), n).select("ref_id")) == [] and rows(V.resolve_infra(ref(("r2", "db")), n.unionByName(spark.createDataFrame([("r2", "x", "resource", "")], n.schema))).select("target", "confidence")) == [("r", 1.0)]
    comp = spark.createDataFrame([("app/p1/x", "x", "page"), ("app/p1/y/x", "x", "region"), ("app/p2/z", "z", "page")], "symbol string, name string, type string")
    assert rows(V.resolve_component(ref(("q", "app/p1|page|x"), ("q", "app/p1||x"), ("q", "app/p2||z"), ("q", "app/p1|page|z"), ("q", "bad")), comp).select("ref_id", "target", "confidence")) == [(0, "app/p1/x", 1.0), (2, "app/p2/z", 0.5)]
    kinds = spark.createDataFrame([("s", "rule_set"), ("g", "rule_group"), ("r1", "rule"), ("r2", "rule"), ("t", "rule_set")], "symbol string, kind string")
    e = spark.createDataFrame([("s", "g", "contains"), ("r1", "g", "contains"), ("s", "r2", "contains"), ("s", "r1", "contains"), ("s", "f", "invoked_by")], "source string, target string, kind string")
    assert rows(V.rules_inventory(kinds, e)) == [("s", ["f"], 1, 1), ("t", [], 0, 0)]
    urls = spark.createDataFrame([("https://User@Host.org/a/B.git",), ("git@host.org:a/b",), ("ssh://git@host.org/a/b.git#main",)], "u string").select(V.repo_identity(F.col("u")).alias("i"))
    assert {x.i for x in urls.collect()} == {"host.org/a/b"}
    d = spark.createDataFrame([("p", "python", "My_Lib", "registry", None), ("p", "npm", "q", "git", "git@h:o/q.git"), ("p", "npm", "q", "git", "git@h:o/none"), ("p", "npm", "q", "path", "r"), ("p", "npm", "two", "registry", None), ("p", "npm", "p-own", "registry", None), ("p", "gem", "x", "registry", None), ("p", "npm", " ", "registry", None), ("p", "npm", "lost", "registry", None)], "repo string, ecosystem string, name string, kind string, source string")
    p = spark.createDataFrame([("l", "python", "my-lib"), ("q", "npm", "q"), ("a", "npm", "two"), ("b", "npm", "two"), ("p", "npm", "p-own")], "repo string, ecosystem string, name string")
    repos = spark.createDataFrame([("q", "https://h/o/q"), ("r", "https://h/o/r")], "repo string, url string")
    links, bounds = V.link_repos(d, p, repos)
    assert rows(links.select("name", "target")) == [("My_Lib", "l"), ("q", "q")]
    assert sorted(x.reason for x in bounds.collect()) == ["ambiguous", "itself", "no_name", "not_provided", "other_provider", "unknown_ecosystem", "unknown_repository"]


def test_paging_refuses_stale_cursors(spark):
    df = spark.range(7).withColumnRenamed("id", "n")
    seen, cursor = [], None
    while True:
        part, cursor = S.page(df, ["n"], 3, cursor, "q")
        seen += [x.n for x in part.collect()]
        if cursor is None:
            break
    assert seen == list(range(7))
    _, c = S.page(df, ["n"], 3, None, "q")
    for rows_, cur, what in ((df, "nonsense", "q"), (df, c, "other"), (df.where("n <> 5"), c, "q")):
        with pytest.raises(ValueError):
            S.page(rows_, ["n"], 3, cur, what)
    assert [x.n for x in S.cap_rows_to_budget(df, ["n"], 20).collect()] == [0, 1]


def test_sources_and_names(spark):
    t = lambda *x: spark.createDataFrame(list(x), "file string, text string")
    j = X.scan_jcl(t(("a.jcl", "//S1 EXEC PGM=PAY\n//* S2 EXEC PGM=NO\n//IN DD DISP=SHR,DSN=A.B.C\n"), ("b", None)))
    assert rows(j.select("name", "kind", "target")) == [("IN", "data", "A.B.C"), ("S1", "step", "PAY")]
    assert rows(X.scan_rules(t(("a.drl", 'rule "Big one"\nend\n// rule no\nrule two\n'), ("b.clp", "(defrule x =>) ; (defrule no"), ("c.drl", None)))) == [("a.drl", "drools", "Big one"), ("a.drl", "drools", "two"), ("b.clp", "clips", "x")]
    good, bad = X.scan_evidence(spark.createDataFrame([('{"producer":"p","snapshot":"s","facts":[{"fact_id":"1","source":"a","target":"b","kind":"k","confidence":0.5}]}',), ('{"producer":"p","snapshot":"s","facts":[{"fact_id":"1"}]}',), ("{",), (None,)], "text string"))
    assert rows(good.select("producer", "fact_id")) == [("p", "1")] and sorted(x.why for x in bad.collect()) == ["envelope", "envelope", "fact"]
    assert spark.range(1).select(X.file_digest(F.lit("a")) != X.file_digest(F.lit("b"))).first()[0]
    n = spark.createDataFrame([("s", "d1"), ("t", "d1"), ("u", "d2"), ("s", "d1")], "symbol string, directory string")
    assert rows(K.package_ring(n, 1.0).select("source", "target")) == [("s", "t"), ("t", "s")]
    assert K.singleton_rate(ids(spark, "a", "b", "c"), spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "symbol string, community int")).first()[0] == 0.333333
    assert L.parse_edge_kind("calls") == "calls" and L.parse_edge_kind("other:x") == "other:x"
    for wrong in ("call", "other:", "Calls"):
        with pytest.raises(ValueError):
            L.parse_edge_kind(wrong)
    nodes = spark.createDataFrame([("f", "x"), ("g", "f"), ("h", "g")], "symbol string, name string")
    assert [rows(L.resolve_operand(nodes, x).select("symbol")) for x in ("f", "x", "zz")] == [[("f",)], [("f",)], []]
    with pytest.warns(UserWarning):
        L.rules_recall(spark.createDataFrame([], "id int, severity string, weight int, retired boolean, effect string, projects array<string>"), {}, limit=900)
