"""Manifests, survivors, snapshots and references on small cases, against plain Python."""

import json
import random
from datetime import datetime, timedelta

import pytest

from spandrel.functions.jsonudf import canonical_json
from spandrel.operators.incremental import CommitConflict, ManifestStore, changed_by_run
from spandrel.operators.references import estate_references, estate_targets, orphan_references
from spandrel.operators.snapshots import source_changes
from tests.conftest import rows

T0 = datetime(2025, 1, 1)
FILES = "obs_id bigint, repo string, path string, digest string, git_sha string, observed_at timestamp_ntz, arrived_at timestamp_ntz, idx string"
RUNS = "run_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string, path string"


def brute_changes(files, runs):
    plain = lambda p: p.replace("\\", "/").replace("//", "/").removeprefix("./")
    known = {r[4]: r[3].lower() for r in files if r[4] and (r[3] or "").strip()}
    ok = sorted((r for r in runs if r[3] == "succeeded"), key=lambda r: (r[1], r[0]))
    out, before = set(), {}
    for run in ok:
        state = {}
        for r in files:
            if r[2] is None or r[6] is None or r[6] > run[1]:
                continue
            d = (r[3] or "").strip().lower() or known.get(r[4]) or (f"sha:{r[4]}" if r[4] else "")
            key = (r[5] or datetime.min, r[6], r[0])
            p = plain(r[2])
            if p not in state or key > state[p][0]:
                state[p] = (key, d)
        out |= {(run[0], p) for p, (_, d) in state.items() if p not in before or before[p] != d}
        before = {p: d for p, (_, d) in state.items()}
    return sorted(out)


def test_changed_by_run_against_brute_force(spark):
    r = random.Random(3)
    files = []
    for i in range(220):
        sha = f"{r.randrange(9):040x}" if r.random() < 0.8 else None
        digest = r.choice([None, "", " ", "AB%02d" % r.randrange(9), "ab%02d" % r.randrange(9)]) if sha is None else r.choice([None, f"aa{sha[-1]}", f"AA{sha[-1]}"])
        path = "hot/a.py" if r.random() < 0.4 else r.choice(["./x//b.py", "x/b.py", "x\\b.py", None, "x/c.py"])
        seen = None if r.random() < 0.05 else T0 + timedelta(hours=r.randrange(300))
        files.append((i, "x", path, digest, sha, seen, T0 + timedelta(hours=r.randrange(400)), "clash"))
    files += files[:20]  # delivered twice
    runs = [(k, T0 + timedelta(hours=r.choice([5, 30, 30, 31, 100, 101, 250, 390])), None, r.choice(["succeeded", "succeeded", "failed"]), "clash") for k in range(9)]
    got = changed_by_run(spark.createDataFrame(files, FILES), spark.createDataFrame(runs, RUNS))
    assert rows(got) == brute_changes(files, runs)


def test_changed_by_run_on_empty_tables(spark):
    nothing, no_runs = spark.createDataFrame([], FILES), spark.createDataFrame([], RUNS)
    some = spark.createDataFrame([(1, "x", "a", "d", None, T0, T0, "")], FILES)
    run = spark.createDataFrame([(1, T0, None, "succeeded", "")], RUNS)
    assert rows(changed_by_run(nothing, run)) == [] == rows(changed_by_run(some, no_runs))
    assert rows(changed_by_run(some, run)) == [(1, "a")]


def listing_of(spark, *x):
    return spark.createDataFrame(list(x), "path string, size bigint, checksum string")


def test_manifest_store_survives_failures(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path / "m"))
    assert store.read() is None and store.manifest().count() == 0
    assert store.run("b1", listing_of(spark, ("a", 1, "x"), ("b", None, None)), lambda df: df)
    assert not store.run("b1", listing_of(spark, ("c", 1, "z")), lambda df: df)  # a retry of a committed batch is nothing

    def crash(df):
        df.write.parquet(str(tmp_path / "half"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.run("b2", listing_of(spark, ("a", 1, "x"), ("b", None, None), ("c", 2, "y")), crash)
    assert store.committed() == ["b1"] and store.clean(0) == 1
    assert store.run("b2", listing_of(spark, ("a", 1, "x2"), ("b", None, None), ("c", 2, "y")), lambda df: df)
    assert rows(store.read().select("path", "checksum")) == [("a", "x"), ("a", "x2"), ("b", None), ("c", "y")]
    assert rows(store.pending(listing_of(spark, ("a", 1, "x2"), ("b", None, None), ("d", 1, "q"))).select("path")) == [("d",)]
    with pytest.raises(ValueError):
        store.run("../x", listing_of(spark), lambda df: df)
    with pytest.raises(ValueError):
        store.replay("h", listing_of(spark).selectExpr("*", "1L as batch"), lambda df: df)


@pytest.mark.parametrize("other", ["b2", "b1"])
def test_overlapping_batches_take_every_record_once(spark, tmp_path, other):
    """A second run, of another or the same name, starts and commits inside the first one's work."""
    store, two = ManifestStore(spark, str(tmp_path / "m")), ManifestStore(spark, str(tmp_path / "m"))
    files = listing_of(spark, ("a", 1, "x"), ("b", 1, "y"))
    inner = []

    def process(df):
        if not inner:
            inner.append(two.run(other, files, lambda d: d))
        return df

    won = store.run("b1", files, process)
    assert inner == [True] and won == (other != "b1")
    assert rows(store.read().select("path")) == [("a",), ("b",)] and store.committed()[0] == other
    assert rows(store.manifest().select("path", "batch")) == [("a", 1), ("b", 1)]


def test_runs_in_threads_and_compaction(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    stores = [ManifestStore(spark, str(tmp_path / "m"), compact_every=2) for _ in range(4)]
    files = listing_of(spark, *((f"p{i}", i, str(i)) for i in range(6)))
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(lambda i: stores[i].run(f"t{i}", files, lambda d: d), range(4)))
    store = stores[0]
    assert sorted(x.path for x in store.read().collect()) == [f"p{i}" for i in range(6)]
    for i in range(9, 12):  # names needn't sort in the order of their runs
        assert store.run(f"b{i}", listing_of(spark, ("p0", i, "n")), lambda d: d)
    assert rows(store.manifest().where("path = 'p0'").select("size")) == [(11,)]
    assert len(store.committed()) == 7 and store.pending(listing_of(spark, ("p0", 11, "n"))).count() == 0
    with pytest.raises(CommitConflict):
        store.run("z", files, lambda d: (stores[1].run(f"w{len(store.committed())}", listing_of(spark), lambda x: x), d)[1], attempts=2)


def test_canonical_json_is_by_value():
    assert canonical_json('{"b": 1.0, "a": [1, 2]}') == canonical_json('{"a":[1e0,2],\n"b":1}')
    assert canonical_json('"\\u00e9"') == canonical_json('"é"')
    assert len({canonical_json(x) for x in ("[1,2]", "[2,1]", "1", "true", '"1"', "null", "{", None, "0.1", "0.10000000000000001")}) == 10


SG = "source_id string, generation bigint, catalog string, docs array<struct<key:string,title:string,entry:string,sections:array<struct<key:string,text:string>>>>, hash string"


def test_source_changes(spark):
    doc = lambda k, t="t", e='{"a":1,"b":2}', s=(("x", "1"),): (k, t, e, list(s))
    cat = lambda n: json.dumps({"doc_count": n})
    data = [
        ("s", 1, cat(2), [doc("a"), doc("b"), doc("b")], ""), ("s", 3, cat(2), [doc("b", e='{"b":2,"a":1.0}'), doc("c")], ""),
        ("s", 3, cat(2), [doc("c"), doc("b")], ""), ("s", 2, cat(9), [doc("z")], ""), ("s", 4, cat(0), [], ""), ("s", 5, cat(1), [doc("c", None)], ""),
        ("s", 6, cat(1), [doc("c", "")], ""), ("s", 7, cat(1), [doc("c", "", s=(("x", "1"), ("x", "1")))], ""), ("s", 8, "{", [doc("c")], ""), ("u", 1, cat(1), [doc("q")], ""), (None, 1, cat(0), [], ""), ("v", 2, cat(0), None, ""), ("v", 3, cat(1), [doc("k")], "")]
    got = rows(source_changes(spark.createDataFrame(data, SG)))
    assert got == sorted([("s", 3, "a", "removed"), ("s", 3, "c", "added"), ("s", 4, "b", "removed"), ("s", 4, "c", "removed"), ("s", 5, "c", "added"), ("s", 6, "c", "changed"), ("v", 3, "k", "added")], key=repr)
    assert source_changes(spark.createDataFrame([], SG)).count() == 0


def test_orphan_references(spark):
    e = "edge_id bigint, src_store string, src_id string, src_epoch bigint, tgt_store string, tgt_id string, tgt_epoch bigint, asserted_at timestamp_ntz, state string"
    edges = [(1, "knowledge", "k1", 0, "estate", "　n1\t", 0, T0, ""), (2, "knowledge", "gone", 0, "estate", "n1", 1, T0, ""), (3, "control", "zz", 0, "estate", " ", 0, T0, ""),
             (4, "knowledge", "k1", None, "estate", "late", 0, T0, ""), (5, "other", "k1", 0, None, "n1", 0, T0, ""), (6, "knowledge", "k1", 0, "estate", "late", 0, None, "")]
    nodes = [("n1", 0, T0, None), ("n1", 0, T0, None), ("late", 0, T0 + timedelta(days=1), None)]
    kn = [("k1", 0, T0, None), ("gone", 5, T0, T0)]
    refs = estate_references(spark.createDataFrame(edges, e), spark.createDataFrame([(9, "k1", T0), (8, None, T0), (7, "gone", T0), (6, "nix", None)], "report_id bigint, to_id string, reported_at timestamp_ntz"))
    targets = estate_targets(spark.createDataFrame(nodes, "symbol string, epoch bigint, first_seen timestamp_ntz, removed_at timestamp_ntz"), spark.createDataFrame(kn, "node_id string, epoch bigint, created_at timestamp_ntz, tombstoned_at timestamp_ntz"))
    got = rows(orphan_references(refs, targets).select("ref_table", "ref_id", "ref_field", "state"))
    assert got == sorted([("typed_xedges", 2, "src_id", "deleted"), ("typed_xedges", 2, "tgt_id", "stale"), ("typed_xedges", 4, "tgt_id", "late"), ("typed_xedges", 5, "src_id", "missing"),
                          ("orphaned_edges", 7, "to_id", "deleted"), ("orphaned_edges", 6, "to_id", "missing")], key=repr)
