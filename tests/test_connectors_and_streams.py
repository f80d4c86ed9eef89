"""Sources, sinks, streams, extraction rules, communities and knowledge upkeep on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from spandrel.operators import extract as X
from spandrel.operators import knowledge as N
from spandrel.operators import rank as K
from spandrel.sources import connectors as C
from spandrel.streaming import changes
from tests.conftest import rows


def test_tree_tfstate_cloud_and_batches(spark, tmp_path):
    (tmp_path / "t/a").mkdir(parents=True)
    (tmp_path / "t/a/x.py").write_text("x = 1\n")
    (tmp_path / "t/b.bin").write_bytes(b"a\x00b")
    (tmp_path / "t/min.js").write_text("x" * 9_000)
    got = C.walk_source_tree(spark, str(tmp_path / "t"))
    assert sorted((r.path.rsplit("/t/", 1)[1], r.text is not None, r.skipped) for r in got.collect()) == [("a/x.py", True, None), ("b.bin", False, "binary"), ("min.js", False, "minified")]
    state = json.dumps({"resources": [{"mode": "managed", "type": "b", "name": "n", "instances": [{"dependencies": ["v.w"]}]}, {"mode": "data", "type": "q", "name": "z", "instances": []}]})
    t = spark.createDataFrame([(state,), ("{",), (None,)], "text string")
    nodes, refs = C.scan_tfstate(t)
    assert rows(nodes) == [("b.n", "n", "b", "live")] and rows(refs) == [("b.n", "v.w")]
    cloud = spark.createDataFrame([('[{"type": "AWS::S3::Bucket", "id": "i", "name": "n"}, {"type": "Q", "id": "j"}, {"type": "Q"}]',), (None,)], "text string")
    assert rows(C.scan_cloud(cloud)) == [("i", "n", "bucket", "live"), ("j", None, "other:Q", "live")]
    (tmp_path / "b.ndjson").write_text('{"op": "node", "symbol": "a", "name": "n"}\n{"op": "annotate", "symbol": "a"}\nnope\n{"op": "annotate", "symbol": "a", "key": "k"}\n')
    good, bad = C.read_write_batch(spark, str(tmp_path / "b.ndjson"))
    assert (good.count(), bad.count()) == (2, 2)
    C.export_ndjson(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    html = spark.createDataFrame([("<p>a&lt;b</p><script>x</script><br>c",)], "h string").select(C.html_to_text("h")).first()[0]
    assert html.split() == ["a<b", "c"]


def test_watch_is_exactly_once_and_counts(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "event_id bigint, ts timestamp_ntz, event_type string"

    def put(n, k):
        spark.range(k, k + n).selectExpr("id as event_id", "timestamp_ntz'2025-01-01 00:00:00' as ts", "'view' as event_type").write.mode("append").parquet(src)

    def handle(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    put(5, 0)
    changes.watch(changes.follow(spark, src, schema), handle, ck, once=True).awaitTermination()
    put(3, 5)
    changes.watch(changes.follow(spark, src, schema), handle, ck, once=True).awaitTermination()
    changes.watch(changes.follow(spark, src, schema), handle, ck, once=True).awaitTermination()
    assert spark.read.parquet(out).select("event_id").distinct().count() == 8 == spark.read.parquet(out).count()
    put(2, 0)  # delivered again
    q = changes.access_counts(changes.follow(spark, src, schema)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 8


def test_extraction(spark):
    t = spark.createDataFrame([("a/x.js", 'q = require("./y")'), ("x.ts", 'require("z")'), ("b.js", None)], "path string, text string")
    assert rows(X.extra_edges(t, X.EdgeRule("r", "**.js", r'require\("([^"]+)"\)', "m:{0}")).select("source", "target")) == [("a/x.js", "m:./y")]
    r = spark.createDataFrame([(1, "```py\na\n```\nx\n```\nb\n```"), (2, None), (3, "no")], "id int, text string")
    assert rows(X.embedded_regions(r)) == [(1, 0, "py", "a\n"), (1, 1, "", "b\n")]
    p = X.parameters(spark.createDataFrame([("f", "fn f(a: int, mut b)"), ("g", "g(x)"), ("h", "h()"), ("i", None)], "symbol string, signature string"))
    calls = spark.createDataFrame([(1, "f", "g"), (2, "g", "f"), (2, "g", "h")], "site_id int, caller string, target string")
    assert rows(X.value_flow(calls, p)) == [("f#a", "g#x", 0)]


def test_louvain_finds_two_cliques(spark):
    e = [(f"{s}{i}", f"{s}{j}", "calls", 1.0) for s in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", "calls", 1.0)]
    df = spark.createDataFrame(e, "source string, target string, kind string, confidence double")
    nodes = spark.createDataFrame([(f"{s}{i}",) for s in "ab" for i in range(5)] + [("alone",)], "symbol string")
    got = dict(rows(K.louvain(nodes, df)))
    assert len({got[f"a{i}"] for i in range(5)}) == 1 == len({got[f"b{i}"] for i in range(5)}) and got["a0"] != got["b0"] and got["alone"] == "alone"
    q = K.modularity(df, spark.createDataFrame(list(got.items()), "symbol string, community string")).first().q
    assert q > 0.4


def test_knowledge_upkeep(spark):
    k = lambda *x: spark.createDataFrame(list(x), "key string, hash string")
    assert rows(N.replace_source(k(("a", "1"), ("b", "1")), k(("b", "2"), ("c", "1")), 1, 2)) == [("a", "tombstone"), ("b", "write"), ("c", "write")]
    assert rows(N.replace_source(k(("a", "1")), k(("a", "1")), 2, 2)) == []
    for old, new in ((3, 2), (2, 2)):
        with pytest.raises(ValueError):
            N.replace_source(k(("a", "1")), k(("a", "2")), old, new)
    t = spark.createDataFrame([("getUserName",), ("set_x_value",), ("get",), ("",)], "n string").select(N.name_tokens("n").alias("t"))
    assert sorted(r.t for r in t.collect()) == [[], ["get"], ["user", "name"], ["value"]]
    s = "symbol string, name string, kind string, signature string"
    a = spark.createDataFrame([("l1", "load_node", "function", "f(a, b)"), ("l2", None, "function", None)], s)
    b = spark.createDataFrame([("r1", "loadNode", "method", "g(a, b)"), ("r2", "unrelated", "function", "f(a, b)")], s)
    assert [x[:2] for x in rows(N.correspond(a, b))] == [("l1", "r1")]
    q = spark.createDataFrame([(1, "submitted"), (2, "applied")], "id int, state string")
    assert rows(N.advance(q, "approve")) == [(1, "approved"), (2, "applied")]
