"""Stores, indexes, paths, memories and folders on literal rows."""

import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloft import storage
from sparkloft.operators import embedding, graph, memory, ordered, store, telemetry
from sparkloft.operators.keyword_index import KeywordIndex
from sparkloft.service import Engine, Request
from sparkloft.sources import files

EDGE = "id string, source_id string, target_id string, label string, source_file string, valid_from string, valid_until string"


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
    assert storage.shared_dir(spark)


def test_shortest_paths(spark):
    rows = [("1", "a", "b"), ("2", "c", "b"), ("3", "c", "d"), ("4", "a", "x"), ("5", "x", "d"), ("6", "a", "b"), ("7", "d", "e")]
    e = spark.createDataFrame([(i, s, t, "calls", "f", "2020", None) for i, s, t in rows] + [("8", "a", "d", "calls", "f", "2020", "2021")], EDGE)
    nodes = spark.createDataFrame([(k, k, "n", "in" if k != "x" else "out") for k in "abcdex"], "id string, name string, label string, domain string")
    got = [(r["nodes"], r["edges"], r["length"]) for r in graph.shortest_paths(nodes, e, "a", "d").orderBy("path").collect()]
    assert got == [(["a", "x", "d"], ["4", "5"], 2)]  # closed edges are not walked
    inside = [(r["nodes"], r["edges"]) for r in graph.shortest_paths(nodes, e, "a", "d", domains=("in",)).orderBy("path").collect()]
    assert inside == [(["a", "b", "c", "d"], ["1", "2", "3"]), (["a", "b", "c", "d"], ["6", "2", "3"])]  # parallel edges
    assert graph.shortest_paths(nodes, e, "a", "d", domains=("in",), limit=1).count() == 1
    assert graph.shortest_paths(nodes, e, "a", "a").first()["length"] == 0
    assert graph.shortest_paths(nodes, e, "a", "nobody").count() == 0 and graph.shortest_paths(nodes, e, "a", "e", max_depth=2).count() == 0


def test_running_totals(spark):
    rows = spark.createDataFrame([(i % 7, i, (i * 13) % 5) for i in range(300)], "day int, id int, size int")
    got = {r["id"]: r["before"] for r in ordered.running_total(rows, ("day", "id"), "size", 8).collect()}
    total, want = 0, {}
    for r in sorted(rows.collect()):
        want[r["id"]] = total
        total += r["size"]
    assert got == want
    assert ordered.running_total(rows.limit(0), ("day", "id"), "size").count() == 0
    logs = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 5.0)], "mode string, latency_ms double")
    assert {
        r["mode"]: (r["n"], r["avg"], r["p50"], r["p95"]) for r in telemetry.latency(logs, "mode").collect()
    } == {"a": (2, 15.0, 10.0, 20.0), "b": (1, 5.0, 5.0, 5.0)}
    assert telemetry.latency(logs.limit(0)).first()["p50"] is None


MEMORY = "id string, text string, section string, origin string, confidence double, created_at string, last_referenced_at string, active boolean, sensitivity string, embedding array<double>"


def test_memory_add(spark):
    rows = [
        ("m1", "Use tabs", "Style", "user", 0.9, "2024-01-01", None, True, "normal", [1.0, 0.0]),
        ("m2", "old note of a session", "Style", "session:1", 0.1, "2023-01-01", None, True, "normal", [0.0, 1.0])
    ]
    table = spark.createDataFrame(rows, MEMORY)
    new = lambda i, text, v: spark.createDataFrame([(i, text, "Style", "user", 0.9, "2024-02-01", None, True, "normal", v)], MEMORY)
    assert memory.add(table, new("m3", "  use   TABS ", [0.5, 0.5]), [0.5, 0.5]).count() == 2
    out = {r["id"]: r["active"] for r in memory.add(table, new("m4", "Use spaces", [0.99, 0.05]), [0.99, 0.05]).collect()}
    assert out == {"m2": True, "m4": True}
    told = memory.add(table, new("m6", "Tabs are eight wide", [0.1, -1.0]), [0.1, -1.0], supersedes="use TABS")
    assert {r["id"] for r in told.collect()} == {"m2", "m6"}
    full = memory.add(table, new("m5", "Name files in lower case", [-1.0, 0.0]), [-1.0, 0.0], cap=40)
    assert {r["id"] for r in full.collect()} == {"m1", "m5"}


def test_embeddings(spark):
    embedding.check_compatible({}, "p", "m", 8)
    embedding.check_compatible({"provider": "p", "model": "m", "dimensions": 8}, "p", "m", 8)
    with pytest.raises(ValueError, match="model 'x' is not 'm'"):
        embedding.check_compatible({"provider": "p", "model": "x", "dimensions": 8}, "p", "m", 8)
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "bb")], "id int, text string")
    none = spark.createDataFrame([], "content_hash string, embedding array<float>")
    out, new = embedding.embed(texts, none, lambda xs: [[float(len(x))] for x in xs], 1)
    assert {r["id"]: r["embedding"] for r in out.collect()} == {1: [1.0], 2: [1.0], 3: None, 4: [2.0]} and new.count() == 2
    with pytest.raises(Exception, match="components"):
        embedding.embed(texts, none, lambda xs: [[1.0, 2.0] for _ in xs], 1)[0].collect()


def test_store(spark):
    chunks = spark.createDataFrame([("c1", "t", "a"), ("c2", "t", "b")], "chunk_id string, text string, source string")
    assert store.delete(chunks, None)[1] == 0 and store.delete(chunks, F.col("source") == "a")[1] == 1
    with pytest.raises(ValueError, match="no manifest"):
        store.orphan_chunks(chunks, chunks.limit(0))
    assert [r[0] for r in store.orphan_chunks(chunks, chunks.where("source = 'a'")).collect()] == ["c2"]
    hits = chunks.withColumn("score", F.lit(0.5)).withColumn("page", F.lit(3))
    r = store.results(hits.where("chunk_id = 'c1'")).first()
    assert (r["source_type"], r["language"], r["metadata"]) == ("doc", None, {"page": "3"})


def test_keyword_index_segments(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "i"))
    assert index.search(["x"], 5).count() == 0 and index.postings().count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, text string")
    index.add(rows(("a", "x y"), ("b", "x x z"), ("e", "")))
    index.remove(rows(("a", "")))
    assert {r["chunk_id"] for r in index.search(["x", "y"], 5).collect()} == {"b"}
    index.add(rows(("a", "y again"), ("b", "now z only")))
    assert {r["chunk_id"] for r in index.search(["x"], 5).collect()} == set()
    assert {r["chunk_id"] for r in index.search(["y", "only"], 5).collect()} == {"a", "b"}
    assert {(r["chunk_id"], r["dl"]) for r in index.compact(str(tmp_path / "j")).live().collect()} == {("a", 2), ("b", 3), ("e", 0)}


def test_folder_landmarks(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p><w:r><w:t>Bye</w:t></w:r></w:p></w:body></w:document>'
    made = {
        ".gitignore": "*.log\n/out/\n", "a.md": "# A", "x.log": "no", "out/o.md": "no", "sub/.gitignore": "!keep.log\n/skip.md\n", "sub/keep.log": "log", "sub/skip.md": "no", "sub/deep/skip.md": "yes",
        "env/pyvenv.cfg": "home", "env/lib/m.py": "no", "nested/.project/x": "", "nested/n.md": "no", "page.html": "<html><script>x</script><p>One &amp; two</p></html>", "broken.docx": "no zip",
    }
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        z.writestr("word/document.xml", body)
    marks = files.landmarks(spark, str(tmp_path), project_mark=".project")
    assert [p for p, _ in marks.ignore] == ["", "sub"] and marks.skipped == ("env", "nested")
    got = {r["source"].split(tmp_path.name + "/")[1]: r["text"] for r in files.scan(spark, str(tmp_path), marks=marks).collect()}
    assert got == {"a.md": "# A", "sub/deep/skip.md": "yes", "page.html": "One & two", "w.docx": "Hello there\nBye"}
    logs = files.scan(spark, str(tmp_path), ["*.log"], marks=marks).collect()
    assert [r["file_name"] for r in logs] == ["keep.log"]
    assert files.read_file(spark, str(tmp_path / "x.log")).first()["text"] == "no"


def test_service_graph(spark):
    sf = "/root/testdata/sf0.001"
    engine = Engine(spark, sf, hidden=("code",))
    hits = engine.execute(Request("what is in ASIA", "graph", top_k=4)).collect()
    assert hits and {r["source_type"] for r in hits} <= {"doc", "session_decision"} and all(0.5 <= r["score"] <= 1 for r in hits)
    assert engine.execute(Request("the AFRICA", "multi", top_k=3)).count() <= 3
    assert engine.execute(Request("zzz qqq", "graph")).count() == 0
    assert engine._vocabulary(
        Request("purchases in d1")
    )["metric"] == ["purchase"] and engine._vocabulary(Request("purchases in d1"))["domain"] == ["d1"]


def test_the_last_in_the_order_wins_wherever_it_lies(spark):
    from sparkloft.operators import graph, ingest, store

    rows = [(f"k{k}", v, f"t{(v * 7) % 10}", {"a": str(v)}) for k in range(20) for v in range(10)] + [("k0", 3, None, {"a": "x"})]
    want = {f"k{k}": max((r for r in rows if r[0] == f"k{k}"), key=lambda r: (r[2] is not None, r[2] or "")) for k in range(20)}
    new = spark.createDataFrame(rows, "id string, v long, at string, properties map<string,string>")
    old = spark.createDataFrame([("k1", -1, "t", {"b": "1"}), ("zz", -2, "t", {"b": "2"})], new.schema)
    plain = [c for c in new.columns if c != "properties"]
    for dealt in (new.repartition(7), new.orderBy("v").coalesce(1), new.orderBy(new["v"].desc()).repartition(3, "at")):
        nodes = {r["id"]: (r["v"], r["properties"]["a"]) for r in graph.upsert_nodes(old, dealt, "at").where("id <> 'zz'").collect()}
        assert nodes == {k: (r[1], r[3]["a"]) for k, r in want.items()}
        edges = graph.upsert_edges(old.select("id", "v").selectExpr("*", "'s' AS valid_from"), dealt.selectExpr("id", "v", "at", "CAST(NULL AS STRING) AS valid_from"), "now", "at")
        assert {r["id"]: r["v"] for r in edges.collect()} == {k: r[1] for k, r in want.items()} | {"zz": -2}
        props = graph.set_properties(old, dealt.select("id", "at", "properties"), "at")
        assert {r["id"]: r["properties"] for r in props.collect()} == {"k1": {"b": "1", "a": want["k1"][3]["a"]}, "zz": {"b": "2"}}
        chunks, some = old.select(*plain).withColumnRenamed("id", "chunk_id"), dealt.select(*plain).withColumnRenamed("id", "chunk_id")
        assert {r["chunk_id"]: r["v"] for r in store.insert_only(chunks, some, "at").collect()} == {k: r[1] for k, r in want.items()} | {"zz": -2, "k1": -1}
        assert {r["chunk_id"]: r["v"] for r in store.update(chunks, some, "at").collect()} == {"k1": want["k1"][1], "zz": -2}
        gone = some.where("false").select("chunk_id")
        assert {r["chunk_id"]: r["v"] for r in store.swap(chunks, some, gone, "at").collect()} == {k: r[1] for k, r in want.items()} | {"zz": -2}
        assert {r["id"]: r["v"] for r in ingest.upsert(old.select(*plain), dealt.select(*plain), ["id"], "at").collect()} == {k: r[1] for k, r in want.items()} | {"zz": -2}
