"""Whole results of the queries the second round's findings name, against plain Python."""

import random

from pyspark.sql import functions as F

from spandrel.operators import textsearch as T


def test_name_suggest_finds_every_name_within_the_edits(spark):
    r = random.Random(9)
    names = sorted({"".join(r.choice("abcX_") for _ in range(r.randrange(1, 9))) for _ in range(150)} | {"load_chunk", "oad_chunk", "xload_chunk", "é" * 12, "aaaaaaaaaaaaaaaaaa"})
    nodes = [(f"s{i % 97:02}", n) for i, n in enumerate(names * 2)] + [("s0", None)]
    probes = ["laod_chunk", "qoad_chunk", "a", "ab", "B", "m::abc", "é" * 11, "aaaaaaaaaaaaaaaaa", "", None, "z" * 257, *(r.choice(names).upper() for _ in range(20)), *(r.choice(names)[::-1] for _ in range(20))]
    want = set()
    for p in {x for x in probes if x is not None and len(x) <= 256}:
        f, found = p.lower(), {}
        for s, n in nodes:
            if n is None:
                continue
            g, tiers = n.lower(), []
            if g == f:
                tiers.append((0, 0))
            if "::" in f and g == f.rpartition("::")[2]:
                tiers.append((1, 0))
            if f and g.startswith(f) and g != f:
                tiers.append((2, len(g) - len(f)))
            if 0 < (d := T.osa_distance(f, g)) <= max(1, len(f) // 4):
                tiers.append((3, d))
            if tiers:
                found[s, n] = min(tiers)
        want |= {(p, s, n, t, d, i + 1) for i, (t, d, n, s) in enumerate(sorted((t, d, n, s) for (s, n), (t, d) in found.items())[:3])}
    got = T.name_suggest(spark.createDataFrame(nodes, "symbol string, name string"), spark.createDataFrame([(p,) for p in probes], "probe string")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert ("qoad_chunk", "load_chunk") in {(x.probe, x.name) for x in got}


def test_edits_of_many_pairs_at_once():
    import numpy as np

    from spandrel.operators.nearnames import EditBlock, Texts, osa_pairs

    r = random.Random(2)
    words = ["", "a", "ba", "ab" * 20, *("".join(r.choice("abcd") for _ in range(r.randrange(1, 14))) for _ in range(60))]
    t, (i, j) = Texts(words), np.divmod(np.arange(len(words) ** 2), len(words))
    for most in (1, 3):
        want = [min(T.osa_distance(words[a], words[b]), most + 1) for a, b in zip(i, j)]
        assert np.minimum(osa_pairs(t, i, t, j, most), most + 1).tolist() == want
    names = sorted(set(words) - {""})
    p, n, d = EditBlock(names).nearest(words, np.full(len(words), 2), np.full(len(words), 1))
    for k, w in enumerate(words):
        near = {x: e for x in names if 0 < (e := T.osa_distance(w, x)) <= 2}
        assert {names[y]: e for x, y, e in zip(p, n, d) if x == k} == {x: e for x, e in near.items() if e == min(near.values())}


def test_gram_blocks_find_every_pair(spark, monkeypatch):
    from spandrel.operators import nearnames

    monkeypatch.setattr(nearnames.name_blocks, "__defaults__", (40,))  # several blocks
    r = random.Random(3)
    word = lambda: "_".join(r.choice(("get", "set", "node", "nodes", "ed", "edge", "x", "9")) for _ in range(r.randrange(1, 5)))
    names, probes = sorted({word() for _ in range(120)}), sorted({word() for _ in range(60)} | {"zzz", "Get-Nodes", "", "ünode"})
    plain = lambda x: x.lower().replace("_", " ").replace("-", " ")
    got = T.fuzzy_candidates(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in probes], "probe string"), 0.5).collect()
    want = {}
    for a in map(plain, filter(None, probes)):
        for b in map(plain, names):
            x, y = nearnames.grams(a), nearnames.grams(b)
            if len(x & y) / len(x | y) >= 0.5:
                want[a, b] = len(x & y) / len(x | y)
    assert len(got) == len(want) and {(x.probe, x.name): x.score for x in got} == want


def test_moves_in_order_leave_no_gain():
    import numpy as np

    from spandrel.operators import rank as K

    r = random.Random(7)
    n = 60
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(150)} | {(i, i + 1) for i in range(n - 1)}
    a, b = np.array(sorted(pairs)).T
    links = K._laid_out(np.concatenate((a, b)), np.concatenate((b, a)), np.ones(2 * len(a)), n)
    near = [[y for x, y in pairs if x == i] + [x for x, y in pairs if y == i] for i in range(n)]
    label, moved = list(range(n)), True  # every node in every round, as the former code did
    while moved:
        moved = False
        for i in range(n):
            votes = {d: sum(label[y] == d for y in near[i]) for d in {label[y] for y in near[i]}}
            best = min(votes, key=lambda d: (-votes[d], d != label[i], d))
            if votes[best] > votes.get(label[i], 0):
                label[i], moved = best, True
    assert K._settled_in_order(*links, 1.0, 0.0)[0].tolist() == label
    c = K._settled_in_order(*links, 2.0 * len(a), 1.0)[0].tolist()
    degree = [len(x) for x in near]
    for i in range(n):
        worth = lambda d: sum(c[y] == d for y in near[i]) - degree[i] * sum(degree[y] for y in range(n) if c[y] == d and y != i) / (2 * len(a))  # noqa: B023, E731
        assert all(worth(d) <= worth(c[i]) + 1e-9 for d in {c[y] for y in near[i]})


def test_levels_go_from_joins_to_the_driver(spark):
    from spandrel.operators import rank as K

    e = [(f"{s}{i}", f"{s}{j}", "calls", 1.0) for s in "abc" for i in range(5) for j in range(i)] + [("a0", "b0", "calls", 1.0), ("b1", "c1", "calls", 1.0)]
    nodes = spark.createDataFrame([(f"{s}{i}",) for s in "abc" for i in range(5)] + [("alone",)], "symbol string")
    df = spark.createDataFrame(e, "source string, target string, kind string, confidence double")
    got = {x.symbol: x.community for x in K.louvain(nodes, df, few=20).collect()}  # 64 links, then fewer than 20
    assert [len({got[f"{s}{i}"] for i in range(5)}) for s in "abc"] == [1, 1, 1] and len(set(got.values())) == 4 and got["alone"] == "alone"


def recorded(monkeypatch):
    """Columns and rows of what recall stores."""
    from spandrel.operators import recall as Q

    kept, real = [], Q.stored

    def store(df):
        out = real(df)
        kept.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(Q, "stored", store)
    return kept


DOCS = [(i, f"alpha walks the edge {'of node ' * (i % 3)} w{i} {'beta' if i % 7 == 0 else ''}") for i in range(60)] + [(90, None), (91, "")]
ASKED = [(1, "walks the edge"), (2, "beta"), (3, "node of node"), (4, None), (5, "of"), (6, "nothing here")]


def test_keyword_candidates_keep_counts_alone(spark, monkeypatch):
    from spandrel.operators import recall as Q

    kept = recorded(monkeypatch)
    docs, q = spark.createDataFrame(DOCS, "id bigint, text string"), spark.createDataFrame(ASKED, "query_id int, text string")
    got = sorted(map(tuple, Q.keyword_candidates(docs, q).collect()))
    assert all("term" not in c and "text" not in c for c, _ in kept) and max(n for _, n in kept) == 60
    assert {x[0] for x in got} == {1, 2, 3} and sum(x[0] == 3 for x in got) == 32 and [x[1] for x in got if x[0] == 2] == [0, 7, 14, 21, 28, 35, 42, 49, 56]
    monkeypatch.setattr(Q, "QUESTION_BLOCK", 2)
    assert sorted(map(tuple, Q.keyword_candidates(docs, q).collect())) == got


def test_memory_recall_moves_only_what_a_list_holds(spark, monkeypatch):
    from spandrel.operators import recall as Q

    kept = recorded(monkeypatch)
    m = spark.createDataFrame([(i, t, "", "semantic", 0, 3, 3, 0.9, None, None, {}) for i, t in DOCS], "id bigint, content string, scope string, tier string, created bigint, accesses bigint, good bigint, confidence double, invalid_at bigint, last_access bigint, facets map<string,string>")
    q = spark.createDataFrame([(2, "beta", "")], "query_id int, text string, scope string")
    assert sorted(x.id for x in Q.memory_recall(m, q, 100, 10_000, mode="keyword").collect()) == [0, 7, 14, 21, 28, 35, 42, 49, 56]
    assert [n for c, n in kept if "content" in c] == [9]


def test_knowledge_recall_stores_no_text(spark, monkeypatch):
    from spandrel.operators import recall as Q

    kept = recorded(monkeypatch)
    docs = spark.createDataFrame(DOCS, "id bigint, text string")
    got = Q.knowledge_recall(docs, spark.createDataFrame([(2, "beta")], "query_id int, text string"), docs.where("id < 30")).collect()
    assert sorted((x.doc, x.chunk) for x in got) == [(i, 0) for i in (0, 7, 14, 21, 28)]
    assert all("text" not in c for c, _ in kept) and max(n for _, n in kept) == 30


def test_correspond_works_signatures_out_once_a_symbol(spark, monkeypatch):
    from spandrel.operators import knowledge as N

    kept, real = [], N.stored

    def store(df):
        out = real(df)
        kept.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(N, "stored", store)
    s = "symbol string, name string, kind string, signature string"
    left = spark.createDataFrame([(f"l{i}", "load_node", ("function", "class")[i % 2], f"load_node(a, b{i})") for i in range(6)] + [("l9", None, None, None)], s)
    right = spark.createDataFrame([(f"r{i}", "node_load", ("method", "struct", None)[i % 3], f"x(a, b{i})") for i in range(9)], s)
    got = sorted(map(tuple, N.correspond(left, right, k=2).collect()))
    assert [n for c, n in kept if "ls" in c or "rs" in c] == [6, 9]
    # names: load, node against node; kinds 0.8 and 0.6; two parameters each; b2 is in the signature of l2 and of no method
    words = lambda x: {w for w in x.replace("(", " ").replace(")", " ").replace(",", " ").split() if len(w) > 1}
    want = []
    for i in range(6):
        scored = []
        for j in range(9):
            km = {(0, 0): 0.8, (1, 1): 0.6}.get((i % 2, j % 3), 0)
            a, b = {"load", "node", f"b{i}"}, words(f"x(a, b{j})")
            nj = len({"load", "node"} & {"node", "load"}) / 2
            if km:
                scored.append((-round(0.5 * nj + 0.25 * len(a & b) / len(a | b) + 0.15 * km + 0.1, 6), f"r{j}"))
        want += [(f"l{i}", m, -x, n + 1) for n, (x, m) in enumerate(sorted(scored)[:2])]
    assert got == sorted(want)


def test_rounds_over_arrays_leave_no_gain(monkeypatch):
    import numpy as np

    from spandrel.operators import rank as K

    r = random.Random(11)
    n = 90
    pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(260)})
    a, b = np.array(pairs, np.int32).T
    for weight in (None, np.array([r.randrange(1, 4) for _ in pairs], float)):
        w = np.ones(len(pairs)) if weight is None else weight
        for block in (7, 10_000):
            monkeypatch.setattr(K, "LINK_BLOCK", block)
            key = np.concatenate((a << 7 | b, b << 7 | a)).astype(np.int64)
            start, to, x = K._unpacked(key, None if weight is None else np.concatenate((weight, weight)), n)
            near: list[dict] = [{} for _ in range(n)]
            for (i, j), v in zip(pairs, w):
                near[i][j] = near[j][i] = v
            for i in range(n):
                at = slice(start[i], start[i + 1])
                assert dict(zip(to[at].tolist(), [1.0] * n if x is None else x[at].tolist())) == near[i]
            k = np.array([sum(m.values()) for m in near])
            two_m = k.sum()
            c, moves = K._settled_at_once(start, to, x, k, two_m, 1.0, 1_000)
            assert moves
            for i in range(n):
                worth = lambda d: sum(v for j, v in near[i].items() if c[j] == d) - k[i] * sum(k[j] for j in range(n) if c[j] == d and j != i) / two_m  # noqa: B023, E731
                assert all(worth(d) <= worth(c[i]) + 1e-9 for d in {c[j] for j in near[i]})
            of = K._levels_at_once(start, to, x, k, two_m, 1.0, 1_000, 50)
            q = lambda o: sum(v for (i, j), v in zip(pairs, w) if o[i] == o[j]) * 2 / two_m - sum((k[o == d].sum() / two_m) ** 2 for d in set(o))  # noqa: B023, E731
            in_order = K._settled_in_order(start, to, np.ones(len(to)) if x is None else x, two_m, 1.0)[0]
            assert q(of) >= q(c) - 1e-9 and q(of) > q(in_order) - 0.05


def test_louvain_of_many_links_makes_no_job_a_round(spark, monkeypatch):
    from spandrel.operators import rank as K

    e = [(f"{s}{i}", f"{s}{j}", "calls", 1.0) for s in "abc" for i in range(5) for j in range(i)] + [("a0", "b0", "calls", 1.0), ("a0", "b0", "imports", 1.0), ("b1", "c1", "calls", 1.0), ("c2", "c2", "calls", 1.0)]
    nodes = spark.createDataFrame([(f"{s}{i}",) for s in "abc" for i in range(5)] + [("alone",)], "symbol string")
    df = spark.createDataFrame(e, "source string, target string, kind string, confidence double")

    def check(**how):
        got = {x.symbol: x.community for x in K.louvain(nodes, df, **how).collect()}
        assert [len({got[f"{s}{i}"] for i in range(5)}) for s in "abc"] == [1, 1, 1] and len(set(got.values())) == 4 and got["alone"] == "alone"

    check(few=0, many=0)  # joins alone
    check(few=0, many=20)  # 64 links by joins, the next level over arrays
    with monkeypatch.context() as m:
        m.setattr(K, "_hashed", lambda *x: None)  # as if two symbols shared a hash
        check(few=0)
        check()
    monkeypatch.setattr(K, "_settled", None)
    check(few=0)
    assert {x.symbol: x.community for x in K.louvain(nodes, df.where("kind = 'none'"), few=0).collect()} == {x.symbol: x.symbol for x in nodes.collect()}


def test_signatures_bound_edits_and_leave_few_pairs(monkeypatch):
    import numpy as np

    from spandrel.operators import nearnames as N

    monkeypatch.setattr(N, "TILE", 50)  # several tiles
    r = random.Random(5)
    words = ["", "a", "ba", "a" * 30, "a" * 31, "é" * 9, "é" * 10, *("".join(r.choice("abz_9é") for _ in range(r.randrange(1, 12))) for _ in range(80))]
    block, texts = N.EditBlock(sorted(set(words))), N.Texts(words)
    signs, bound = N.signatures(texts), {}
    for stage in range(32):
        for i, j in block.bounded(texts.length, signs, np.arange(len(words)), stage):
            for p in zip(i.tolist(), j.tolist()):
                assert p not in bound
                bound[p] = stage
    assert len(bound) == len(words) * len(block.names)  # no pair is left out
    assert all(b <= T.osa_distance(words[i], block.names[block.by[j]]) for (i, j), b in bound.items())
    # verbs and nouns: what is measured for a name with neighbours is a small part of all pairs
    names = sorted({f"{a}_{b}_{i}x{j}" for a in ("read", "keep", "decode", "archive") for b in ("owner", "queue", "reference", "policy") for i in range(9) for j in range(10, 40)})
    pairs, real = [], N.osa_pairs
    monkeypatch.setattr(N, "osa_pairs", lambda a, i, b, j, most: pairs.append(len(i)) or real(a, i, b, j, most))
    N.EditBlock(names).nearest(names[::40], np.full(len(names[::40]), 4), np.full(len(names[::40]), 3))
    assert sum(pairs) < len(names[::40]) * len(names) / 50
