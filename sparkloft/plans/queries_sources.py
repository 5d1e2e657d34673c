"""Transcripts, commit logs, files, chunkers, code, tiers, text functions and question compilers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloft.functions import language, text
from sparkloft.operators import chunking, code_graph, graph, ingest, memory, records, retrieval, telemetry, tiers
from sparkloft.operators.ordered import spread
from sparkloft.plans import compilers
from sparkloft.plans.catalog import query, rounded
from sparkloft.sources import files, history, sessions

_COLLAPSED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))".format
_CUT = "CASE WHEN length({0}) > {1} THEN concat(substr({0}, 1, {1} - 1), '…') ELSE {0} END".format


def _lines(t, value):
    """Turns as lines of a transcript file for each session."""
    path = F.concat(F.lit("s"), F.col("session_id").cast("string"))
    return t("turns").select(path.alias("source_path"), F.col("idx").cast("int").alias("line_no"), value.alias("value"))


_PLACE = "concat('s', CAST(session_id AS STRING)) AS source_path"
_SAID = f"(SELECT session_id, idx, role, {_CUT(_COLLAPSED('text'), 1500)} AS text FROM turns WHERE role <> 'system') AS x"


@query(
    "transcript_messages",
    f"SELECT {_PLACE}, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS idx, role, 'text' AS kind, text FROM {_SAID}", "turns"
)
def _messages(t, spark, sf):
    said = F.struct(F.col("role").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))
    plain = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    line = lambda m: F.to_json(F.struct(F.col("role").alias("type"), m.alias("message")))
    value = F.when(F.col("idx") % 2 == 0, line(said)).otherwise(line(plain))
    return sessions.message_turns(_lines(t, value)).select("source_path", "idx", "role", "kind", "text")


@query(
    "transcript_rollout", f"SELECT {_PLACE}, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS idx, role, text FROM {_SAID}", "turns"
)
def _rollout(t, spark, sf):
    block = F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text")))
    role = F.when(F.col("role") == "system", "developer").otherwise(F.col("role"))
    payload = F.struct(F.lit("message").alias("type"), role.alias("role"), block.alias("content"))
    return sessions.rollout_turns(
        _lines(t, F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload"))))
    ).select("source_path", "idx", "role", "text")


@query(
    "transcript_steps",
    f"SELECT {_PLACE}, idx, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, {
        _CUT(_COLLAPSED('text'), 1500)
    } AS text, idx % 3 <> 2 AS terminal FROM turns",
    "turns",
)
def _steps(t, spark, sf):
    user = F.col("role") == "user"
    content = F.when(user, F.concat(F.lit("<USER_REQUEST>"), "text", F.lit("</USER_REQUEST> more"))).otherwise(F.col("text"))
    status = F.when(F.col("idx") % 3 == 2, "RUNNING").otherwise("DONE")
    step = F.struct(
        F.col("idx").alias("step_index"), F.when(user, "USER_EXPLICIT").otherwise("MODEL").alias("source"), F.lit("TEXT").alias("type"),
        status.alias("status"), content.alias("content")
    )
    return sessions.step_turns(_lines(t, F.to_json(step))).select("source_path", "idx", "role", "text", "terminal")


@query(
    "transcript_titles",
    f"SELECT {_PLACE}, substr(trim(split_part(min_by(text, idx), chr(10), 1)), 1, 80) AS title FROM turns WHERE role = 'user' GROUP BY session_id",
    "turns"
)
def _titles(t, spark, sf):
    return sessions.session_titles(t("turns").withColumn("source_path", F.concat(F.lit("s"), F.col("session_id").cast("string"))))


@query("transcript_final", "SELECT session_id, idx FROM turns WHERE (session_id + idx) % 5 <> 4 AND role <> 'user'", "turns")
def _final(t, spark, sf):
    turns = t("turns").withColumn("terminal", (F.col("session_id") + F.col("idx")) % 5 != 4)
    return sessions.final_turns(turns, include_user=False).select("session_id", "idx")


@query(
    "archive_stats",
    "SELECT tool, count(DISTINCT session_id) AS sessions, count(*) AS turns, min(day) AS first_day, max(day) AS last_day FROM turns WHERE session_id % 4 <> 1 GROUP BY 1",
    "turns"
)
def _archive(t, spark, sf):
    rows = t("turns").withColumn("source_path", F.col("session_id"))
    live = rows.where("session_id % 4 <> 1").select("source_path")
    known = spark.createDataFrame([(2, "2023-01-01")], "source_path long, deleted_at string")
    return sessions.archive_stats(sessions.reconciled(rows, sessions.tombstones(rows, live, known, "2024-02-01")))


@query(
    "commit_log",
    "SELECT CAST(o_orderkey AS STRING) AS sha, concat('c', CAST(o_custkey AS STRING)) AS author, o_orderpriority AS subject, array_to_string(list(CAST(l_partkey AS STRING) ORDER BY l_partkey, l_linenumber), ' ') AS files, "
    "CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines_added FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, o_orderkey",
)
def _log(t, spark, sf):
    stat = F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))
    stats = t("lineitem").groupBy("l_orderkey").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("l_partkey", "l_linenumber", stat.alias("s")))), lambda x: x["s"]), "\n"
        ).alias("stats")
    )
    head = F.concat_ws(
        "\n", F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit("e@x"),
        F.lit("2024-01-01T00:00:00+00:00"), "o_orderpriority", F.lit("")
    )
    logs = t("orders").join(stats, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit(history.COMMIT), head, F.lit(history.END), F.lit("\n"), "stats").alias("value")
    )
    return history.parse_log(logs).select("sha", "author", "subject", F.array_join("files_changed", " ").alias("files"), "lines_added")


@query(
    "commit_chunks",
    "SELECT CAST(o_orderkey AS STRING) AS sha, concat(o_orderpriority, chr(10), chr(10), 'Files:', chr(10), string_agg(f, chr(10) ORDER BY r)) AS text FROM (SELECT l_orderkey, concat('part', CAST(l_partkey AS STRING)) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS r FROM lineitem) AS x JOIN orders ON o_orderkey = l_orderkey WHERE r <= 3 GROUP BY o_orderkey, o_orderpriority"
)
def _commit_chunks(t, spark, sf):
    name = F.concat(F.lit("part"), F.col("l_partkey").cast("string"))
    changed = t("lineitem").groupBy("l_orderkey").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_partkey", "l_linenumber", name.alias("f")))), lambda x: x["f"]).alias("files_changed")
    )
    rows = t("orders").join(changed, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderpriority").alias("subject"), F.lit("").alias("body"), "files_changed"
    )
    return history.commit_chunks(rows, 3)


@query(
    "commit_state",
    "SELECT 'r' AS repository, CAST(max(o_orderkey) AS STRING) AS sha, 7 + count(*) AS indexed FROM orders UNION ALL SELECT 'other', 'x', 5"
)
def _state(t, spark, sf):
    state = spark.createDataFrame([("r", "0", 7), ("other", "x", 5)], "repository string, sha string, indexed long")
    return history.advance(state, t("orders"), "r", str(t("orders").agg(F.max("o_orderkey")).first()[0]))


_PATHS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('src/a', CAST(doc_id AS STRING), '.py') WHEN 1 THEN concat('docs/x', CAST(doc_id AS STRING), '.log') WHEN 2 THEN concat('docs/build/y', CAST(doc_id AS STRING), '.md') WHEN 3 THEN 'docs/keep.log' WHEN 4 THEN concat('sub/deep/z', CAST(doc_id AS STRING), '.rs') ELSE concat('sub/w', CAST(doc_id AS STRING)) END AS path FROM documents"


def _paths(t):
    i = F.col("doc_id").cast("string")
    kinds = [
        F.concat(F.lit("src/a"), i, F.lit(".py")), F.concat(F.lit("docs/x"), i, F.lit(".log")), F.concat(F.lit("docs/build/y"), i, F.lit(".md")),
        F.lit("docs/keep.log"), F.concat(F.lit("sub/deep/z"), i, F.lit(".rs")), F.concat(F.lit("sub/w"), i),
    ]
    return t("documents").select("doc_id", "text", F.get(F.array(*kinds), (F.col("doc_id") % 6).cast("int")).alias("path"))


@query(
    "files_ignored",
    f"SELECT doc_id, (path LIKE '%.log' AND path <> 'docs/keep.log') OR path LIKE 'docs/build/%' OR path LIKE 'sub/w%' AS ignored FROM ({_PATHS}) AS p"
)
def _ignored(t, spark, sf):
    layers = [("", ["*.log", "# note"]), ("docs", ["!keep.log", "build/"]), ("sub", ["/w*", "/z*"])]
    return _paths(t).select("doc_id", files.layered_ignore(F.col("path"), layers).alias("ignored"))


@query(
    "files_language",
    f"SELECT doc_id, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.rs' THEN 'rust' END AS language FROM ({_PATHS}) AS p"
)
def _language(t, spark, sf):
    return _paths(t).select("doc_id", files.detect_language(F.col("path"), F.col("text")).alias("language"))


@query("files_presets", "SELECT * FROM (VALUES ('*.c'), ('*.h'), ('*.md'), ('*.txt'), ('*.rst')) AS v(pattern)")
def _presets(t, spark, sf):
    return spark.createDataFrame([(g,) for g in files.preset_globs(["c", "text", "c"])], "pattern string")


@query(
    "files_dependencies",
    "SELECT concat('p', CAST(s_suppkey AS STRING), '/package.json') AS source, s_name AS package, concat('dep', CAST(s_nationkey AS STRING)) AS dependency FROM supplier"
)
def _dependencies(t, spark, sf):
    name = F.concat(F.lit("dep"), F.col("s_nationkey").cast("string"))
    body = F.to_json(F.struct(F.col("s_name").alias("name"), F.create_map(name, F.lit("1")).alias("dependencies")))
    rows = t("supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string"), F.lit("/package.json")).alias("source"), body.alias("text"))
    return files.manifest_dependencies(spark, rows)


@query("text_chunks", "SELECT doc_id, true AS fits, true AS whole FROM documents WHERE trim(text) <> ''")
def _text_chunks(t, spark, sf):
    """Every chunk is within its size, and a document's chunks hold all of its words in order."""
    docs = t("documents").select(
        F.col("doc_id").cast("string").alias("source"), "text", F.lit("doc").alias("source_type"), F.lit(None).cast("string").alias("language")
    )
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    parts = chunking.chunk_files(docs).groupBy("source").agg(
        F.max(F.length("text")).alias("most"),
        F.array_distinct(
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: words(x["text"])))
        ).alias("held")
    )
    out = parts.join(docs.select("source", words(F.col("text")).alias("all")), "source")
    return out.select(
        F.col("source").cast("long").alias("doc_id"), (F.col("most") <= 4 * chunking.SIZE).alias("fits"),
        (F.col("held") == F.col("all")).alias("whole")
    )


@query(
    "code_chunks",
    "SELECT p_partkey AS id, CAST(k AS INT) AS chunk_index, CAST(1 + k * 25 AS INT) AS start_line, CAST(least(n, 40 + k * 25) AS INT) AS end_line FROM "
    "(SELECT p_partkey, 1 + p_size * 3 AS n FROM part) AS p, (SELECT unnest(range(0, 40)) AS k) AS s WHERE k = 0 OR 15 + k * 25 < n",
)
def _code_chunks(t, spark, sf):
    lines = F.array_join(F.transform(F.sequence(F.lit(1), 1 + F.col("p_size") * 3), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    rows = spread(t("part").select("p_partkey", "p_size"), "p_partkey").select(
        F.col("p_partkey").cast("string").alias("source"), lines.alias("text"), F.lit("code").alias("source_type"), F.lit("go").alias("language")
    )
    return chunking.chunk_files(rows).select(F.col("source").cast("long").alias("id"), "chunk_index", "start_line", "end_line")


def _modules(t):
    """A small Python module for each part: a class with a decorated method that calls a function of the module."""
    key = F.col("p_partkey").cast("string")
    body = F.concat(
        F.lit("import os\nfrom lib"), (F.col("p_partkey") % 3).cast("string"), F.lit(" import x\n\nclass C"), key, F.lit(
            "(Base):\n    @cached\n    def run(self):\n        return helper(self.stop())\n\n    def stop(self):\n        pass\n\ndef helper(x):\n    return os.getcwd()\n"
        )
    )
    return spread(t("part").select("p_partkey"), "p_partkey").select(
        "p_partkey", F.concat(F.lit("m"), key, F.lit(".py")).alias("source"), body.alias("text"), F.lit("python").alias("language"),
        F.lit("code").alias("source_type")
    )


@query(
    "code_triples",
    "SELECT concat('m', k, '.py') AS source_file, concat('m', k, '.py', s) AS subject, p AS predicate, CASE WHEN o LIKE ':%' THEN concat('m', k, '.py', replace(o, 'C.', concat('C', k, '.'))) WHEN o = 'lib' THEN concat('lib', CAST(n % 3 AS STRING)) ELSE o END AS object FROM "
    "(SELECT p_partkey AS n, CAST(p_partkey AS STRING) AS k FROM part) AS x, (SELECT * FROM (VALUES ('', 'imports', 'os'), ('', 'imports', 'lib'), (':helper', 'calls', 'os.getcwd'), (':helper', 'defined_in', '')) AS v(s, p, o)) AS y WHERE p <> 'defined_in' "
    "UNION ALL SELECT concat('m', k, '.py'), concat('m', k, '.py:C', k, s), p, CASE WHEN o LIKE ':C%' THEN concat('m', k, '.py:C', k, substr(o, 3)) WHEN o LIKE ':%' THEN concat('m', k, '.py', o) ELSE o END FROM "
    "(SELECT CAST(p_partkey AS STRING) AS k FROM part) AS x, (SELECT * FROM (VALUES ('', 'extends', 'Base'), ('', 'contains', ':C.run'), ('', 'contains', ':C.stop'), ('.run', 'decorated_by', 'cached'), ('.run', 'calls', ':helper'), ('.run', 'calls', ':C.stop')) AS v(s, p, o)) AS y",
)
def _code_triples(t, spark, sf):
    return code_graph.triples(_modules(t)).where("predicate <> 'defined_in'").select("source_file", "subject", "predicate", "object")


@query("code_symbols", "SELECT concat('m', CAST(p_partkey AS STRING), '.py') AS source, 'helper' AS symbol_name, 'function' AS symbol_kind FROM part")
def _symbols(t, spark, sf):
    return chunking.chunk_files(_modules(t)).select("source", "symbol_name", "symbol_kind")


@query(
    "code_imports",
    "SELECT source_file, object, CASE WHEN n % 2 = 0 THEN concat('pkg/lib', CAST(n % 3 AS STRING), '.py') ELSE concat('lib', CAST(n % 3 AS STRING), '/__init__.py') END AS target FROM (SELECT p_partkey AS n, concat(CASE WHEN p_partkey % 2 = 0 THEN 'pkg/' ELSE 'other/' END, 'm', CAST(p_partkey AS STRING), '.py') AS source_file, concat('lib', CAST(p_partkey % 3 AS STRING)) AS object FROM part) AS x"
)
def _imports(t, spark, sf):
    moved = _modules(t).withColumn("source", F.concat(F.when(F.col("p_partkey") % 2 == 0, "pkg/").otherwise("other/"), "source"))
    found = code_graph.triples(moved).where("predicate = 'imports' and object like 'lib%'").select("source_file", "object")
    known = spark.createDataFrame([(f"pkg/lib{k}.py",) for k in range(3)] + [(f"lib{k}/__init__.py",) for k in range(3)], "source string")
    return code_graph.resolve_imports(found, known)


@query(
    "code_import_patterns",
    "SELECT concat('f', CAST(n_nationkey AS STRING)) AS source_file, CASE n_nationkey % 3 WHEN 0 THEN './mod' WHEN 1 THEN 'net/http' ELSE 'a.b.C' END AS object FROM nation"
)
def _patterns(t, spark, sf):
    kinds = F.array(F.lit("import {x} from './mod'\nconst y = 1"), F.lit('import (\n  z "net/http"\n)'), F.lit("import static a.b.C;\nclass D {}"))
    langs = F.array(F.lit("typescript"), F.lit("go"), F.lit("java"))
    at = (F.col("n_nationkey") % 3).cast("int")
    rows = t("nation").select(
        F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("source"), F.get(kinds, at).alias("text"), F.get(langs, at).alias("language")
    )
    return code_graph.import_triples(rows).select("source_file", "object")


@query(
    "code_types",
    "SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'README' WHEN 1 THEN 'Class' ELSE 'odd' END AS type, CASE n_nationkey % 3 WHEN 0 THEN 'File' WHEN 1 THEN 'Error' END AS subject_type, CASE n_nationkey % 3 WHEN 1 THEN 'Decision' END AS object_type FROM nation"
)
def _types(t, spark, sf):
    at = (F.col("n_nationkey") % 3).cast("int")
    raw, relation = F.get(F.array(F.lit("readme"), F.lit("CLASS"), F.lit("odd")), at), F.get(
        F.array(F.lit("touches"), F.lit("fixed-by"), F.lit("none")), at
    )
    ends = code_graph.relation_ends(relation)
    return t("nation").select(
        F.col("n_nationkey").alias("id"), code_graph.normalize_type(raw).alias("type"), ends[0].alias("subject_type"), ends[1].alias("object_type")
    )


def _items(t, spark):
    registry = tiers.Registry()
    registry.domain("shop")
    kinds = F.array(*[F.lit(x) for x in ("record", "reference", "document", "entity", "other")])
    emit = lambda rows: rows.select(
        F.col("event_id").alias("id"), F.get(
            kinds, (F.col("event_id") % 5).cast("int")
        ).alias("tier"), F.when(F.col("event_id") % 7 == 0, "nowhere").otherwise("shop").alias("domain"),
        F.when(F.col("event_id") % 11 != 0, "s1").otherwise("").alias("source_id"), F.lit("2024-01-08T00:00:00").alias("ts"),
    )
    registry.adapter("events", emit, "shop")
    return registry.emit("events", t("events"))


@query(
    "tier_route",
    "SELECT event_id AS id, CASE WHEN event_id % 5 = 4 THEN 'unknown tier' WHEN event_id % 11 = 0 THEN 'no provenance' WHEN event_id % 7 = 0 THEN 'unknown domain' ELSE CASE event_id % 5 WHEN 0 THEN 'record 2024-W02' WHEN 1 THEN 'reference' WHEN 2 THEN 'document' ELSE 'entity' END END AS fate FROM events",
)
def _route(t, spark, sf):
    out = _items(t, spark)
    parts = [out[k].select("id", (F.concat(F.lit("record "), "iso_week") if k == "record" else F.lit(k)).alias("fate")) for k in tiers.TIERS]
    rejected = out["rejected"].select("id", F.col("problem").alias("fate"))
    for p in parts:
        rejected = rejected.unionByName(p)
    return rejected


@query("tier_forget", "SELECT event_id AS id FROM events WHERE event_id % 5 = 2 AND event_id % 11 = 0 AND event_id % 7 <> 0 AND false")
def _forget(t, spark, sf):
    return tiers.forget({"document": _items(t, spark)["document"]}, "s1")["document"].select("id")


@query(
    "tier_inject",
    "SELECT doc_id, 'base' AS team, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS STRING) END AS size, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'c' END AS note FROM chunks",
    "chunks"
)
def _inject(t, spark, sf):
    own = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("note"), F.lit("own")))
    rows = t("chunks").select("doc_id", "n_chars", own.alias("extra"))
    out = tiers.inject_by(
        rows, lambda c: {"size": c["n_chars"], "doc_id": 0, "list": [1]} if c["doc_id"] % 2 == 0 else 1 // 0, {"note": "c", "team": "base"}
    )
    get = lambda k: F.try_element_at("extra", F.lit(k)).alias(k)
    return out.select("doc_id", get("team"), get("size"), get("note"))


@query(
    "tier_extract",
    "SELECT doc_id, 'USD' AS unit, CASE WHEN value > 500 THEN 1.0 ELSE 0.6 END AS confidence FROM (SELECT doc_id, CAST(replace(a, ',', '') AS DOUBLE) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\$\\s?([0-9][0-9,]*(?:\\.[0-9]+)?)', 1)) AS a FROM documents) AS x) AS y"
)
def _extract(t, spark, sf):
    registry = tiers.Registry()
    registry.extractors.append(lambda rows: records.currency(rows).withColumn("metric", F.lit("price")))
    registry.validators.append(lambda metric, unit, value: F.when(value > 500, 1.0))
    found = registry.extract(t("documents"))
    return found.select("doc_id", "unit", registry.confidence(F.col("metric"), F.col("unit"), F.col("value")).cast("double").alias("confidence"))


@query(
    "tier_salience",
    "SELECT id, round(greatest(power(0.5, greatest(0.0, (epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(CAST(ts AS TIMESTAMP))) / 86400.0) / 30.0), CASE WHEN metric = 'purchase' THEN 0.9 ELSE 0.0 END), 6) AS salience FROM records",
    "records"
)
def _salience(t, spark, sf):
    registry = tiers.Registry()
    registry.scorers.append(F.when(F.col("metric") == "purchase", 0.9))
    return rounded(t("records").select("id", registry.salience(F.col("ts"), "2024-02-01 00:00:00", 30.0).alias("salience")), "salience")


@query(
    "records_add_rule",
    "SELECT owner, metric, CAST(version AS INT) AS version, retired_at FROM (VALUES ('me', 'click', 1, '2024'), ('me', 'click', 2, NULL), ('you', 'click', 1, NULL)) AS v(owner, metric, version, retired_at)"
)
def _rule(t, spark, sf):
    schema = "owner string, metric string, unit string, value_min double, value_max double, tier double, version int, created_at string, retired_at string"
    rules = spark.createDataFrame(
        [("me", "click", None, None, None, 0.6, 1, "2023", None), ("you", "click", None, None, None, 0.6, 1, "2023", None)], schema
    )
    return records.with_rule(rules, {"owner": "me", "metric": "click", "tier": 1.0}, "2024").select("owner", "metric", "version", "retired_at")


@query(
    "text_times",
    "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE strftime(date_trunc('second', ts) - CASE WHEN event_id % 4 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') END AS at FROM events"
)
def _times(t, spark, sf):
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    forms = F.array(plain, F.concat(plain, F.lit("+02:00")), F.concat(plain, F.lit("Z")), F.lit("no time"))
    return t("events").select(
        "event_id", F.date_format(text.parse_time(F.get(forms, (F.col("event_id") % 4).cast("int"))), "yyyy-MM-dd HH:mm:ss").alias("at")
    )


@query(
    "text_weeks",
    "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%G-W%V') END AS week, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m') END AS month FROM events"
)
def _weeks(t, spark, sf):
    said = F.when(F.col("event_id") % 9 == 0, "garbage").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00")))
    rows = t("events").select("event_id", said.alias("said"))
    return rows.select("event_id", text.iso_week(F.col("said")).alias("week"), text.year_month(F.col("said")).alias("month"))


@query(
    "text_ids",
    "SELECT id, concat('rec_', substr(sha1(concat_ws('|', CAST(id AS STRING), metric, coalesce(CASE WHEN id % 2 = 0 THEN source END, ''))), 1, 16)) AS record_id FROM records",
    "records"
)
def _ids(t, spark, sf):
    return t("records").select(
        "id", records.record_id(F.col("id"), F.col("metric"), F.when(F.col("id") % 2 == 0, F.col("source"))).alias("record_id")
    )


@query("text_short", f"SELECT doc_id, {_CUT(_COLLAPSED('text'), 60)} AS short FROM documents")
def _short(t, spark, sf):
    return t("documents").select("doc_id", text.collapse(F.col("text"), 60).alias("short"))


@query(
    "text_turns",
    "SELECT session_id, idx, CASE idx % 4 WHEN 0 THEN concat(role, ': ', text) WHEN 1 THEN concat(role, ' (thinking): ', text) WHEN 2 THEN concat(role, ' [tool: ', tool, ']') ELSE concat('[result]: ', text) END AS line FROM turns",
    "turns"
)
def _turns(t, spark, sf):
    kind = F.get(F.array(F.lit("text"), F.lit("thinking"), F.lit("tool_use"), F.lit("tool_result")), (F.col("idx") % 4).cast("int"))
    return t("turns").select("session_id", "idx", text.rendered_turn(F.col("role"), kind, F.col("text"), F.col("tool")).alias("line"))


@query(
    "text_paths", f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'two words' ELSE path END AS path, doc_id % 7 <> 0 AS is_path FROM ({_PATHS}) AS p"
)
def _canonical(t, spark, sf):
    said = F.when(F.col("doc_id") % 7 == 0, "two words").when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("/home/me/"), "path")
    ).otherwise(F.concat(F.lit("./"), "path"))
    rows = _paths(t).withColumn("said", said)
    return rows.select("doc_id", text.canonical_path(F.col("said"), "/home/me").alias("path"), text.path_like(F.col("said")).alias("is_path"))


@query(
    "text_display_sources",
    "SELECT doc_id, concat('d', CAST(doc_id % 3 AS STRING), '://', source, '/', CAST(doc_id AS STRING)) AS shown, CASE WHEN doc_id % 4 <> 0 THEN source END AS source FROM documents"
)
def _display(t, spark, sf):
    domain, key = F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")), F.col("doc_id").cast("string")
    shown = text.display_source(domain, F.col("source"), key)
    other = F.when(F.col("doc_id") % 4 == 0, F.lit("elsewhere")).otherwise(domain)
    return t("documents").select("doc_id", shown.alias("shown"), text.raw_source(shown, other, key).alias("source"))


@query("text_fences", "SELECT doc_id, doc_id % 3 <> 2 AS fenced, CASE doc_id % 3 WHEN 0 THEN 'python' ELSE '' END AS languages FROM documents")
def _fences(t, spark, sf):
    mark = F.get(F.array(F.lit("```Python\nx\n```\n~~~\ny\n~~~"), F.lit("```\nz\n```"), F.lit("no `code` here")), (F.col("doc_id") % 3).cast("int"))
    return t("documents").select("doc_id", text.has_fence(mark).alias("fenced"), F.array_join(text.fenced_languages(mark), ",").alias("languages"))


@query("text_doc_comments", "SELECT p_partkey AS id, concat('Makes ', p_name, ' from Foo now. ', p_brand) AS comment FROM part")
def _comments(t, spark, sf):
    code = F.concat(
        F.lit("  /// <summary>Makes "), "p_name", F.lit('\n  /// from <see cref="Foo"/> now.</summary>\n  /// <returns> '), "p_brand",
        F.lit(" </returns>\n  public void Run() {")
    )
    return t("part").select(F.col("p_partkey").alias("id"), text.doc_comment(code).alias("comment"))


@query("text_html", "SELECT p_partkey AS id, concat(p_name, ' & ', p_brand) AS text FROM part")
def _html(t, spark, sf):
    page = F.concat(
        F.lit("<html><head><title>x</title></head><body><!-- c --><script>var a = '<p>';</script><h1>"), "p_name", F.lit("</h1>\n&amp;&nbsp;<b>"),
        "p_brand", F.lit("</b></body></html>")
    )
    return t("part").select(F.col("p_partkey").alias("id"), text.html_text(page).alias("text"))


@query("text_language", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'en' END AS language FROM documents")
def _natural(t, spark, sf):
    said = F.array(
        F.lit("der Hund und die Katze sind nicht im Haus"), F.lit("le chat est dans la maison avec les enfants"),
        F.lit("the cat is in the house with the children"), F.lit("zzz")
    )
    return t("documents").select(
        "doc_id", language.language_of(F.get(said, (F.col("doc_id") % 4).cast("int")), ("en", "de", "fr", "hr")).alias("language")
    )


@query(
    "text_stems", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'café close queri' WHEN 1 THEN 'relat happi' ELSE '' END AS terms FROM part"
)
def _stems(t, spark, sf):
    said = F.array(F.lit("The cafés are closing the queries"), F.lit("Relational happiness"), F.lit("of the and"))
    return t("part").select(
        F.col("p_partkey").alias("id"), F.array_join(language.analyzed(F.get(said, (F.col("p_partkey") % 3).cast("int"))), " ").alias("terms")
    )


_SAID = {  # texts of each language and their stems, from the algorithms' published examples
    "de": ("Die aufeinanderfolgenden Kategorien und Katzen der Häuser", "aufeinanderfolg kategori katz haus"),
    "fr": ("La continuation maintenaient majestueusement les contorsions", "continu mainten majestu contors"),
    "es": ("Los trabajadores rápidamente con torres y chicas", "trabaj rapid torr chic"),
    "en": ("The cafés are closing the queries", "café close queri"),
}


@query(
    "text_stems_languages",
    "SELECT doc_id, lang, CASE lang " + " ".join(f"WHEN '{x}' THEN '{stems}'" for x, (_, stems) in _SAID.items()) + " END AS terms FROM documents WHERE lang IN ('de', 'fr', 'es', 'en')"
)
def _stems_languages(t, spark, sf):
    out = F.lit(None).cast("string")
    for x, (said, _) in _SAID.items():
        text = F.concat(F.lit(said), F.when(F.col("doc_id") < 0, F.lit("x")).otherwise(F.lit("")))  # a column: the row's own text
        out = F.when(F.col("lang") == x, F.array_join(language.analyzed(text, x, stem=True), " ")).otherwise(out)
    return t("documents").where(F.col("lang").isin(*_SAID)).select("doc_id", "lang", out.alias("terms"))


@query(
    "memory_sections",
    "SELECT doc_id * 3 + 2 AS line_no, concat('Section ', CAST(doc_id AS STRING)) AS section, split_part(trim(text), chr(10), 1) AS text FROM documents WHERE doc_id < 100 AND length(split_part(trim(text), chr(10), 1)) > 0"
)
def _sections(t, spark, sf):
    """A memory file is a page or two: the first hundred documents make its sections."""
    first = F.split_part(F.trim("text"), F.lit("\n"), F.lit(1))
    parts = F.posexplode(
        F.array(F.concat(F.lit("## Section "), F.col("doc_id").cast("string")), F.lit(""), F.concat(F.lit("- "), first, F.lit(" <!-- id -->")))
    ).alias("k", "value")
    lines = t("documents").where("doc_id < 100").where(F.length(first) > 0).select("doc_id", parts)
    return memory.parse_markdown(lines.select((F.col("doc_id") * 3 + F.col("k")).alias("line_no"), "value"))


@query("session_tool_windows", """, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM turns),
    w AS (SELECT k.*, s.v AS wnd FROM k, (SELECT unnest(generate_series(0, 200)) AS v) AS s WHERE s.v * 2 <= k.i AND k.i < s.v * 2 + 4 AND (s.v = 0 OR s.v * 2 + 4 <= k.n))
    SELECT session_id, CAST(wnd AS INT) AS "window", coalesce(string_agg(DISTINCT CASE WHEN idx % 2 = 1 THEN concat('tool', CAST(idx % 3 AS STRING)) END, ',' ORDER BY CASE WHEN idx % 2 = 1 THEN concat('tool', CAST(idx % 3 AS STRING)) END), '') AS tools,
    coalesce(string_agg(DISTINCT CASE WHEN idx % 2 = 1 THEN concat('f', CAST(idx % 2 AS STRING)) END, ','), '') AS files FROM w GROUP BY 1, 2""", "turns")
def _tool_windows(t, spark, sf):
    call = F.col("idx") % 2 == 1
    rows = t("turns").withColumn("kind", F.when(call, "tool_use").otherwise("text")).withColumn(
        "tool_name", F.when(call, F.concat(F.lit("tool"), (F.col("idx") % 3).cast("string")))
    )
    rows = rows.withColumn("tool_inputs", F.when(call, F.create_map(F.lit("file_path"), F.concat(F.lit("f"), (F.col("idx") % 2).cast("string")))))
    out = ingest.session_windows(rows, with_tools=True)
    return out.select("session_id", "window", F.array_join("tools", ",").alias("tools"), F.array_join("files", ",").alias("files"))


@query(
    "manifest_deferred",
    "SELECT path, CASE WHEN doc_id % 7 = 0 THEN CASE WHEN size_bytes >= 1500 AND doc_id % 2 = 0 THEN 'deferred' ELSE 'changed' END ELSE 'unchanged' END AS state FROM disk",
    "disk"
)
def _deferred(t, spark, sf):
    disk = t("disk")
    prior = disk.select(
        "path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("checksum")).alias("checksum"), (F.col("mtime") - 1).alias("mtime"),
        F.lit(False).alias("pending_reindex"), F.when(F.col("doc_id") % 2 == 0, 950.0).otherwise(100.0).alias("embedded_at")
    )
    return ingest.manifest_diff(prior, disk, large=1500, now=1000.0, cooldown=300.0)


@query(
    "retrieve_distinct_hits",
    "SELECT pos, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(chunk_id, path) ORDER BY pos) AS n FROM (SELECT event_id AS pos, CASE WHEN event_id % 3 <> 0 THEN concat('c', CAST(user_id AS STRING)) END AS chunk_id, CASE WHEN event_id % 6 <> 0 THEN concat('p', event_type) END AS path FROM events) AS e) AS x WHERE n = 1 OR (chunk_id IS NULL AND path IS NULL)"
)
def _distinct(t, spark, sf):
    hits = t("events").select(
        F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))).alias("chunk_id"),
        F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("p"), "event_type")).alias("path")
    )
    return retrieval.distinct_hits(hits).select("pos", "chunk_id")


@query(
    "queue_pause",
    "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 5 >= 100 ELSE n_nationkey * 5 > 80 END AS pause FROM nation"
)
def _pause(t, spark, sf):
    rows = t("nation").select("n_nationkey").collect()  # a rule of the driver's, not of rows
    return spark.createDataFrame([(r[0], telemetry.should_pause(r[0] * 5, 100, r[0] % 2 == 0)) for r in rows], "id long, pause boolean")


@query(
    "question_plans",
    "SELECT * FROM (VALUES ('which week had the highest purchase', 'compute,hybrid', 'purchase sum week desc 1'), ('average error per month in march 2024', 'compute,hybrid', 'error avg month desc 2024-03-01T00:00:00 2024-04-01T00:00:00'), "
    "('how often did I say ''retry'' per day', 'scan,hybrid', 'retry day desc'), ('signup but not purchase', 'absence,hybrid', 'metric signup purchase'), "
    "('how has the parser changed over time?', 'timeline,hybrid', 'parser'), ('what depends on the parser', 'graph,hybrid', ''), ('tell me a story', 'hybrid', '')) AS v(question, modes, plan)",
)
def _plans(t, spark, sf):
    metrics = [r[0] for r in t("records").select("metric").distinct().orderBy("metric").collect()]
    out = []
    asked = (
        "which week had the highest purchase", "average error per month in march 2024", "how often did I say 'retry' per day", "signup but not purchase",
        "how has the parser changed over time?", "what depends on the parser", "tell me a story",
    )
    for q in asked:
        modes = compilers.intents(q)
        made = {
            "scan": lambda q=q: compilers.compile_scan(q), "compute": lambda q=q: compilers.compile_compute(q, metrics),
            "absence": lambda q=q: compilers.compile_absence(q, metrics, [], []), "timeline": lambda q=q: compilers.compile_timeline(q),
        }
        plan = next((p for m in ("scan", "compute", "absence", "timeline") if m in modes and (p := made[m]()) is not None), None)
        told = [] if plan is None else [str(v) for k, v in plan.__dict__.items() if v is not None and k != "key"]
        out.append((q, ",".join(modes), " ".join(told)))
    return spark.createDataFrame(out, "question string, modes string, plan string")


@query("question_entities", "SELECT * FROM (VALUES (0, 'HttpClient'), (1, 'my_func'), (2, 'MAX_SIZE'), (3, 'calls')) AS v(pos, entity)")
def _question_entities(t, spark, sf):
    return spark.createDataFrame(list(enumerate(graph.query_entities("what calls HttpClient and my_func with MAX_SIZE?"))), "pos int, entity string")


@query(
    "code_endpoints",
    "SELECT concat('GET /part/', CAST(p_partkey AS STRING)) AS subject, 'handled_by' AS predicate, concat('r', CAST(p_partkey AS STRING), '.py:show') AS object FROM part",
)
def _endpoints(t, spark, sf):
    key = F.col("p_partkey").cast("string")
    code = F.concat(F.lit('@app.get("/part/'), key, F.lit('")\n@app.event("/no")\ndef show():\n    pass\n'))
    rows = t("part").select(F.concat(F.lit("r"), key, F.lit(".py")).alias("source"), code.alias("text"), F.lit("python").alias("language"))
    return code_graph.triples(rows).where("predicate = 'handled_by'").select("subject", "predicate", "object")


@query(
    "code_folders",
    "SELECT DISTINCT concat('src/m', CAST(p_size % 5 AS STRING), '/f', CAST(p_partkey AS STRING), '.py') AS subject, concat('src/m', CAST(p_size % 5 AS STRING)) AS object FROM part "
    "UNION SELECT concat('src/m', CAST(p_size % 5 AS STRING)), 'src' FROM part",
)
def _in_folders(t, spark, sf):
    name = F.concat(F.lit("src/m"), (F.col("p_size") % 5).cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return code_graph.folder_triples(t("part").select(name.alias("source"))).select("subject", "object")


@query(
    "code_references",
    "SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN concat('f', CAST(l_suppkey AS STRING)) ELSE concat('f', CAST(l_suppkey AS STRING), ':g', CAST(l_linenumber AS STRING)) END AS subject, "
    "CASE WHEN l_linenumber % 2 = 0 THEN 'calls' ELSE 'references' END AS predicate, concat('f', CAST(l_partkey AS STRING), ':h') AS object FROM lineitem WHERE l_partkey % 3 <> 0",
)
def _cross_references(t, spark, sf):
    line = F.col("l_linenumber")
    rows = t("lineitem").select(
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("source_file"), F.when(line != 1, F.concat(F.lit("g"), line.cast("string"))).alias("caller"),
        F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("target_file"), F.when(F.col("l_partkey") % 3 != 0, "h").alias("target"),
        F.when(line % 2 == 0, "call").otherwise("use").alias("kind"),
    )
    return code_graph.reference_triples(rows).select("subject", "predicate", "object")


@query("triplets_by_provider", "SELECT chunk_id AS id, substr(split_part(trim(text), ' ', 1), 1, 20) AS subject, 'starts' AS predicate, 'chunk' AS object FROM chunks WHERE trim(text) <> '' AND length(trim(split_part(trim(text), ' ', 1))) > 0 AND NOT contains(split_part(trim(text), ' ', 1), '|') AND NOT contains(split_part(trim(text), ' ', 1), chr(10))", "chunks")
def _by_provider(t, spark, sf):
    def provider(prompts):
        return [f"{p.split(chr(10) * 2, 1)[1].strip(' ').split(' ')[0][:20]} | Word | starts | chunk | Thing\nnot a fact" for p in prompts]

    plain = t("chunks").where(~F.split_part(F.trim("text"), F.lit(" "), F.lit(1)).rlike(r"[|\n]"))
    return ingest.extract_triplets(plain, provider).select("id", "subject", "predicate", "object")


@query("session_unseen_chunks", "SELECT DISTINCT chunk_id FROM chunks WHERE doc_id % 4 <> 0", "chunks")
def _unseen(t, spark, sf):
    rows = t("chunks").select("chunk_id", "doc_id")
    return ingest.unseen_chunks(rows.union(rows), rows.where("doc_id % 4 = 0")).select("chunk_id")


@query("folders_due", "SELECT folder, count(DISTINCT path) AS files FROM disk WHERE folder NOT IN ('src1', 'src2') GROUP BY 1", "disk")
def _due(t, spark, sf):
    queued = spark.createDataFrame([("src1", 95.0), ("src2", 50.0), ("src2", 99.0), ("src3", 80.0)], "folder string, at double")
    return ingest.due_folders(t("disk").union(t("disk")), queued, 100.0)


@query("retrieve_metadata", "SELECT chunk_id FROM chunks WHERE language = 'fr' AND domain = 'd1'", "chunks")
def _contains(t, spark, sf):
    held = F.when(F.col("doc_id") >= 0, F.create_map(F.lit("lang"), "language", F.lit("domain"), "domain"))
    return t("chunks").withColumn("metadata", held).where(retrieval.contains_metadata("metadata", {"lang": "fr", "domain": "d1"})).select("chunk_id")


_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')".format


@query(
    "retrieve_weighted_index",
    f", w AS (SELECT chunk_id, {_TOKENS('folder')} AS a, {_TOKENS('text')} AS b FROM chunks), n AS (SELECT chunk_id, " + ", ".join(f"len(list_filter({f}, lambda x: x = '{v}')) AS {f}{i}" for f in "ab" for i, v in enumerate(("the", "of"))) + " FROM w), "
    "s AS (SELECT chunk_id, 1.0 * a0 / (a0 + 1.0) + 0.2 * b0 / (b0 + 1.0) + 1.0 * a1 / (a1 + 1.0) + 0.2 * b1 / (b1 + 1.0) AS raw FROM n WHERE a0 + b0 > 0 AND a1 + b1 > 0 ORDER BY 2 DESC, 1 LIMIT 12) SELECT chunk_id, round(raw / (SELECT max(raw) FROM s), 6) AS score FROM s",
    "chunks",
)
def _weighted_index(t, spark, sf):
    return rounded(retrieval.weighted_search(retrieval.weighted_terms(t("chunks"), {"folder": 1.0, "text": 0.2}), ("the", "of"), 12), "score")


@query("request_fetch_sizes", "SELECT k, CAST(least(100, k * 10) AS BIGINT) AS reranked, CAST(least(100, k * 5) AS BIGINT) AS filtered, k AS plain FROM (SELECT unnest([1, 5, 15, 30]) AS k) AS x")
def _sizes(t, spark, sf):
    from sparkloft.service import Request

    rows = [(k, Request("x", top_k=k, rerank=True).stage_one(), Request("x", top_k=k, languages=("en",)).stage_one(), Request("x", top_k=k).stage_one()) for k in (1, 5, 15, 30)]
    return spark.createDataFrame(rows, "k int, reranked long, filtered long, plain int")


@query("text_token_counts", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def _token_counts(t, spark, sf):
    return t("documents").select("doc_id", language.token_count(F.col("text")).alias("tokens"))
