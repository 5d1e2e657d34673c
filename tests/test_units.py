"""Operators on literal rows, compilers and the service."""

import time

import pytest
from pyspark.sql import functions as F

from sparkloft.functions import text as ft
from sparkloft.functions import vector as fv
from sparkloft.operators import graph, identity, ingest, memory, records, retrieval, scan, telemetry
from sparkloft.plans import compilers as c
from sparkloft.service import Engine, Request

REC = "id int, subject string, metric string, value double, unit string, ts string, confidence double, source string, source_id string, domain string, sensitivity string"


def recs(spark, *rows):
    return records.with_buckets(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REC))


def test_week_buckets_and_unknown_times(spark):
    df = recs(
        spark, ("a", "sales", 100.0, "USD", "2026-01-05T00:00:00", 1.0, "s", "1", "d", "normal"),
        ("a", "sales", 9.0, "USD", "garbage", 1.0, None, "1", "d", "normal"),
        ("b", "sales", 400.0, "USD", "2026-01-12T00:00:00", 1.0, "s", "1", "d", None),
        ("c", "sales", 7.0, "USD", "2026-01-12T00:00:00", 0.3, "s", "1", "d", "normal")
    )
    assert [(r["label"], r["value"]) for r in records.aggregate(df, "sales", "sum", "week").collect()] == [("2026-W03", 400.0), ("2026-W02", 100.0)]
    assert records.aggregate(df, "sales", "sum").first()["value"] == 509.0
    assert records.aggregate(df, "none", "sum").first()["value"] == 0.0
    assert records.aggregate(df, "sales", "count", exclude_sources=("s",)).first()["value"] == 1.0
    assert records.aggregate(df, "sales", "sum", "week", "asc", 1).first()["label"] == "2026-W02"


def test_absence_is_not_in(spark):
    df = recs(
        spark, ("run", "distance", 1.0, None, "t", 1.0, "s", "1", "d", "normal"), ("run", "duration", 1.0, None, "t", 1.0, "s", None, "d", "normal"),
        ("walk", "distance", 1.0, None, "t", 1.0, "s", "2", "d", "normal"), ("walk", "duration", 1.0, None, "t", 0.3, "s", "2", "d", "normal")
    )
    assert [r[0] for r in records.absent(df, "metric", "distance", "duration").collect()] == ["walk"]
    assert records.absent(df, "metric", "distance", "duration", "source_id").count() == 0  # a null on the absent side


def test_confidence_and_rules(spark):
    df = recs(
        spark, ("a", "amount", 1.0, "USD", None, 1.0, None, None, "d", None), ("a", "amount", float("nan"), "EUR", None, 1.0, None, None, "d", None),
        ("a", "decisions", 2.0, "count", None, 1.0, None, None, "d", None)
    )
    assert [r[0] for r in df.select(records.confidence(F.col("metric"), F.col("unit"), F.col("value"))).collect()] == [1.0, 0.3, 1.0]
    rules = spark.createDataFrame(
        [("amount", None, 0.0, 5.0, 0.6), ("amount", "USD", None, None, 1.0)],
        "metric string, unit string, value_min double, value_max double, tier double"
    )
    assert [r["rule_tier"] for r in records.taught(df, rules).orderBy("id").collect()] == [1.0, None, None]


def test_scan_phrase_does_not_overlap(spark):
    turns = spark.createDataFrame(
        [("s", 0, "user", "text", "a a a. A b a", "2026-01-05", "2026-W02", "x", "normal")],
        "session_id string, idx int, role string, kind string, text string, day string, iso_week string, tool string, sensitivity string"
    )
    assert scan.scan(turns, ["a", "a"]).first()["value"] == 2  # a a | a a
    assert scan.scan(turns, ["a"], "week").first()["value"] == 5
    assert scan.scan(turns, ["a"], since="2026-01-06T00:00:00").count() == 0


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([-1.0, 0.0],)], "v array<float>")
    q = fv.literal([2.0, 0.0])
    assert [r[0] for r in df.select(fv.score(F.col("v"), q)).collect()] == [1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(fv.score(F.col("v"), q, "l2")).collect()] == [0.5, 1 / 3, 0.25]


def test_keyword_limit_comes_before_filter(spark):
    chunks = spark.createDataFrame(
        [(f"c{i:02d}", "x " * (10 - i) + "y", "code" if i < 6 else "doc") for i in range(9)], "chunk_id string, text string, source_type string"
    )
    where = F.col("source_type") == "doc"
    assert retrieval.keyword_search(chunks, ["x"], 2, where).count() == 0
    assert retrieval.keyword_search(chunks, ["x"], 2, where, exact=True).count() == 2
    assert retrieval.keyword_search(chunks, ["zz"], 2).count() == 0
    n, mean = chunks.count(), chunks.agg(F.avg(F.size(ft.tokens(F.col("text"))))).first()[0]
    a = {r["chunk_id"]: round(r["score"], 9) for r in retrieval.bm25_scores(chunks, ["x", "y"]).collect()}
    b = {r["chunk_id"]: round(r["score"], 9) for r in retrieval.bm25_from_postings(retrieval.postings(chunks), n, mean, ["x", "y"]).collect()}
    assert a == b


def test_fusion(spark):
    v = spark.createDataFrame([("a", 0.8), ("b", 0.4)], "chunk_id string, score double")
    b = spark.createDataFrame([("b", 2.0), ("c", 1.0)], "chunk_id string, score double")
    assert {r["chunk_id"]: r["score"] for r in retrieval.hybrid(v, b).collect()} == {"a": 0.5, "b": 0.75, "c": 0.25}
    assert {r["chunk_id"]: round(r["score"], 9) for r in retrieval.rrf(v, b).collect()} == {
        "a": round(1 / 61, 9), "b": round(1 / 62 + 1 / 61, 9), "c": round(1 / 62, 9)
    }
    assert max(r["score"] for r in retrieval.weighted_rrf([0.5, 0.5], v, b).collect()) == 1.0


EDGE = "id string, source_id string, target_id string, label string, source_file string, valid_from string, valid_until string"


def test_graph(spark):
    e = spark.createDataFrame(
        [
            ("1", "h", "help", "calls", "f", "2020", None), ("2", "api", "lib", "imports", "f", "2020", None),
            ("3", "help", "lib", "references", "f", "2020", None), ("4", "commit", "lib", "modifies", "f", "2020", None),
            ("5", "x", "h", "calls", "f", "2020", "2021"), ("6", "lib", "lib", "calls", "f", "2020", None)
        ],
        EDGE
    )
    assert [(r["id"], r["depth"]) for r in graph.impact(e, "lib").collect() if r["id"] != "lib"] == [("api", 1), ("help", 1), ("h", 2)]
    assert graph.shortest_path_length(e, "h", "api") == 3
    assert graph.shortest_path_length(e, "h", "x") is None
    assert {r["node"]: r["degree"] for r in graph.degrees(e).collect()}["lib"] == 4  # a loop counts once
    assert e.where(graph.valid("2020-06")).count() == 6 and e.where(graph.valid("2021")).count() == 5
    assert graph.query_entities("What calls HttpClient and my_func in MAX_SIZE?") == ["What", "HttpClient", "my_func", "MAX_SIZE", "calls"]
    new = spark.createDataFrame([("5", "x", "h", "calls", "f", None, None)], EDGE)
    again = graph.upsert_edges(e, new, "2022").where("id = '5'").first()
    assert (again["valid_from"], again["valid_until"]) == ("2022", None)
    nodes = spark.createDataFrame([("a", "Folder"), ("b", "Folder"), ("f", "File")], "id string, label string")
    inside = spark.createDataFrame([("1", "b", "a", "in_folder", "f", "2020", None), ("2", "gone", "b", "in_folder", "f", "2020", None)], EDGE)
    assert [r["id"] for r in graph.sweep_empty_folders(nodes, inside).collect()] == ["f"]


def test_windows_drop_the_tail(spark):
    turns = spark.createDataFrame([("s", i, "u", str(i)) for i in range(5)], "session_id string, idx int, role string, text string")
    assert [(r["window"], r["span"]) for r in ingest.session_windows(turns).collect()] == [(0, 4)]
    assert sorted((r["window"], r["span"]) for r in ingest.session_windows(turns, keep_tail=True).collect()) == [(0, 4), (1, 3), (2, 1)]


def test_manifest_and_upsert(spark):
    prior = spark.createDataFrame(
        [("a", "1", 1, False), ("b", "1", 1, False), ("c", "1", 1, True), ("d", "1", 1, False)],
        "path string, checksum string, mtime int, pending_reindex boolean"
    )
    disk = spark.createDataFrame([("a", "1", 2), ("b", "2", 2), ("c", "1", 1), ("e", "1", 1)], "path string, checksum string, mtime int")
    assert {r["path"]: r["state"] for r in ingest.manifest_diff(prior, disk).collect()} == {
        "a": "unchanged", "b": "changed", "c": "changed", "d": "deleted", "e": "added"
    }
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(2, "p", 1), (2, "q", 2), (3, "z", 1)], "k int, v string, n int")
    assert sorted((r["k"], r["v"]) for r in ingest.upsert(old, new, ["k"], "n").collect()) == [(1, "x"), (2, "q"), (3, "z")]


def test_telemetry(spark):
    log = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,)], "latency_ms double")
    r = telemetry.latency(log).first()
    assert (r["n"], r["avg"], r["p50"], r["p95"]) == (4, 25.0, 30.0, 40.0)  # 1.5 rounds to even
    assert telemetry.bench_stats(log).first()["p50"] == 30.0
    assert telemetry.should_pause(90, 100, False) and not telemetry.should_pause(80, 100, False) and not telemetry.should_pause(99, 100, True)


def test_identity_and_memory(spark):
    a = spark.createDataFrame(
        [("Bo", None, "p1", None, None), ("bo", "team", "p2", "2024", "2025")],
        "surface string, scope string, person_id string, valid_from string, valid_to string"
    )
    assert {r[0] for r in identity.resolve(a, "BO", "team", "2024-06").collect()} == {"p1", "p2"}
    assert {r[0] for r in identity.resolve(a, "bo", "team", "2025").collect()} == {"p1"}
    lines = spark.createDataFrame([(0, "# m"), (1, "## Facts"), (2, "- one <!-- id -->"), (3, "## Rules"), (4, "- two")], "line_no int, value string")
    assert [(r["section"], r["text"]) for r in memory.parse_markdown(lines).collect()] == [("Facts", "one"), ("Rules", "two")]


METRICS = ["sales", "files_touched", "duration"]


def test_compilers():
    assert c.compile_compute("which week had the highest sales", METRICS) == c.ComputePlan("sales", "sum", "week", "desc", 1)
    assert c.compile_compute("how many sales entries", METRICS) == c.ComputePlan("sales", "count")
    assert c.compile_compute("total files in december 2025", METRICS) == c.ComputePlan(
        "files_touched", "sum", None, "desc", None, "2025-12-01T00:00:00", "2026-01-01T00:00:00"
    )
    assert c.compile_compute("how are you", METRICS) is None
    assert c.compile_scan("which week did I mention retries most?") == c.ScanPlan("retries", "week", "desc", 1)
    assert c.compile_scan("profile") is None and c.compile_scan("profile", explicit=True) == c.ScanPlan("profile")
    assert c.compile_absence("has sales but not duration", METRICS, [], []) == c.AbsencePlan("metric", "sales", "duration")
    assert c.compile_absence("planned but never done", METRICS, [], []) is None
    assert c.compile_timeline("how did the login flow evolve over time?") == c.TimelinePlan("login flow")
    assert c.compile_timeline("what did it used to do") == c.TimelinePlan("what did it")
    assert c.intents("which week did I mention retries most?") == ["scan", "hybrid"]
    assert c.intents("what depends on the parser") == ["graph", "hybrid"]


def test_service(spark):
    sf = "/root/testdata/sf0.001"
    vec = spark.read.parquet(f"{sf}/embeddings.parquet").first()["embedding"]
    engine = Engine(spark, sf, lambda text: vec)
    assert engine.route(Request("which week had the highest purchase"))[0] == "compute"
    assert engine.route(Request("how often did I say 'the'"))[0] == "scan"
    assert engine.route(Request("purchase but not error"))[0] == "absence"
    assert engine.route(Request("history of europe"))[0] == "timeline"
    assert engine.route(Request("the and of"))[0] == "hybrid"
    for mode in ("vector", "bm25", "multi", "graph"):
        assert engine.execute(Request("the order of commit", mode, languages=("en",) if mode != "graph" else ())).count() <= 5


def test_text_functions(spark):
    row = spark.createDataFrame([("src/a/b.py", "x  y\n z", "2027-01-01T00:00:00")], "p string, t string, ts string")
    out = row.select(
        ft.prefix_swap(F.col("p"), "src", "lib"), ft.collapse(F.col("t"), 4), ft.iso_week(F.col("ts")),
        F.col("p").rlike(ft.glob_to_regex("src/**/*.py"))
    ).first()
    assert tuple(out) == ("lib/a/b.py", "x y…", "2026-W53", True)


def test_feed_upsert(spark, tmp_path, monkeypatch):
    from sparkloft.streaming.feeds import FeedTable, event_stream, upsert_feed

    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    table = FeedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    assert table.read() is None
    run = lambda: upsert_feed(event_stream(spark, src), table, "n", state, once=True).awaitTermination()
    rows = lambda: sorted((r["k"], r["v"]) for r in table.read().collect())
    put = lambda new: spark.createDataFrame(new, "k int, v string, n int").coalesce(1).write.mode("append").parquet(src)
    put([(1, "a", 1), (2, "b", 1)])
    run()
    put([(2, "c", 2), (2, "d", 1), (7, "e", 1)])
    real = FeedTable._commit
    monkeypatch.setattr(FeedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("crash before the manifest")))
    with pytest.raises(Exception, match="crash"):
        run()
    assert rows() == [(1, "a"), (2, "b")]  # what was there is there still
    monkeypatch.setattr(FeedTable, "_commit", real)
    run()
    assert rows() == [(1, "a"), (2, "c"), (7, "e")]
    table.apply(spark.createDataFrame([(1, "again", 9)], "k int, v string, n int"), "n", 1)  # a batch that is repeated
    assert rows() == [(1, "a"), (2, "c"), (7, "e")]
    for n in range(5):
        put([(1, f"v{n}", n)])
        run()
    assert rows() == [(1, "v4"), (2, "c"), (7, "e")] and len(list((tmp_path / "t").glob("batch-*"))) <= 5


def test_late_rows_are_dropped(spark, tmp_path):
    from datetime import datetime

    from sparkloft.streaming.feeds import minute_counts

    src = str(tmp_path / "events")
    for k, stamps in enumerate(
        [
            ["2024-01-01 00:00:10", "2024-01-01 00:00:20"], ["2024-01-01 01:00:00"], ["2024-01-01 01:00:10"],
            ["2024-01-01 00:00:30", "2024-01-01 01:00:40"]
        ]
    ):
        rows = [(datetime.fromisoformat(x), "view", 1.0) for x in stamps]
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in the order of their times
    start = int(datetime.fromisoformat("2024-01-01 00:00:00+00:00").timestamp()) // 60
    got = {r["minute"] - start: (r["n"], r["total"]) for r in minute_counts(spark, src, "10 minutes", 1).collect()}
    assert got == {0: (2, 2.0), 60: (3, 3.0)}
    late = {r["minute"] - start: r["n"] for r in minute_counts(spark, src, "2 hours", 1).collect()}
    assert late == {0: 3, 60: 3}


def test_language():
    from sparkloft.functions.language import stem_english

    stems = {
        "consistently": "consist", "conspiracy": "conspiraci", "knightly": "knight", "knitting": "knit", "happiness": "happi", "hopping": "hop", "hoped": "hope",
        "cries": "cri", "ties": "tie", "gas": "gas", "this": "this", "kiwis": "kiwi", "agreed": "agre", "luxuriating": "luxuri", "by": "by", "say": "say",
        "communication": "communic", "rationalize": "ration", "adoption": "adopt", "controlling": "control", "falling": "fall", "inning": "inning", "skies": "sky",
    }
    assert {w: stem_english(w) for w in stems} == stems


def test_analysis(spark):
    from sparkloft.functions import language

    rows = spark.createDataFrame(
        [(0, "The cafe\u0301s were closing the queries"), (1, None), (2, "der Hund und die Katze sind nicht im Haus"), (3, "xyzzy")],
        "id int, t string"
    )
    got = {
        r["id"]: (r["w"], r["l"]) for r in rows.select(
            "id", language.analyzed(F.col("t")).alias("w"), language.language_of(F.col("t"), ("en", "de", "xx")).alias("l")
        ).collect()
    }
    assert got[0] == (["café", "close", "queri"], "en") and got[1] == ([], "en") and got[2][1] == "de" and got[3][1] == "en"
    plain = rows.where("id = 2").select(language.analyzed(F.col("t"), "de")).first()[0]
    assert plain == ["hund", "katze", "haus"]


STEMS = {  # pairs of the algorithms' published examples
    "de": "aufeinander aufeinand aufeinanderbiss aufeinanderbiss aufeinanderfolge aufeinanderfolg aufeinanderfolgend aufeinanderfolg aufeinanderschlügen aufeinanderschlug "
    "kategorie kategori kategorien kategori kategorisch kategor kategorische kategor kater kat katers kat katze katz katzen katz kätzchen katzch freundlichkeit freundlich",
    "fr": "continu continu continua continu continuait continu continuant continu continuation continu continué continu continuel continuel continuelle continuel "
    "continuellement continuel continuera continu continuité continu continuons continuon contorsions contors contour contour contraction contract contradictoirement contradictoir "
    "contraignit contraign contraindre contraindr mains main maintenaient mainten maintenant mainten maintenir mainten maintenue maintenu maintien maintien majesté majest "
    "majestueusement majestu majestueux majestu majeur majeur malheureusement malheur",
    "es": "chicana chican chicas chic chicos chic chicuela chicuel chihuahua chihuahu chileno chilen chimenea chimene tonta tont torbellino torbellin torcido torc torear tor "
    "torero torer tormenta torment toronto toront torpedearon torped torrealba torrealb torres torr trabajadores trabaj rápidamente rapid cheques chequ",
}


@pytest.mark.parametrize("language", sorted(STEMS))
def test_published_stems(language):
    from sparkloft.functions.language import STEMMERS

    words = STEMS[language].split()
    for word, stem in zip(words[::2], words[1::2], strict=True):
        assert STEMMERS[language](word) == stem, word
    for odd in ("", "a", "é", "ß", "y", "qu", "ss", "1", "ñ"):
        assert isinstance(STEMMERS[language](odd), str)
