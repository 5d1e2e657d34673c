"""Operators on cases that the given tables have rows for, and question plans of whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloft.operators import chunking, graph, identity, language_profiles, records, tiers
from sparkloft.operators.ordered import spread
from sparkloft.plans import compilers, queries_knowledge  # noqa: F401 (registers graph_chunks, whose SQL is read below)
from sparkloft.plans.catalog import _SQL, query, rounded
from sparkloft.sources import files

_DAY = "ts >= '2024-01-05T00:00:00' AND ts < '2024-01-06T00:00:00'"
_WITHIN = {"since": "2024-01-05T00:00:00", "until": "2024-01-06T00:00:00"}
_SEEN = f"sensitivity = 'normal' AND confidence >= 0.7 AND {_DAY}"


def _absent_sql(key: str, column: str, here: str, missing: str, extra: str = "") -> str:
    side = f"SELECT {key} FROM records WHERE {column} = '{{}}' AND {_SEEN} {extra}".format
    return f"SELECT DISTINCT {key} AS label FROM ({side(here)}) AS a WHERE {key} NOT IN ({side(missing)})"


@query("absence_metric_day", _absent_sql("subject", "metric", "purchase", "signup"), "records")
def _metric_day(t, spark, sf):
    p = compilers.compile_absence("who has purchase but not signup", ["purchase", "signup"], [], [])
    return records.absent(t("records"), p.partition, p.present_in, p.absent_from, p.key, **_WITHIN)


@query("absence_domain_day", _absent_sql("subject", "domain", "d1", "d3"), "records")
def _domain_day(t, spark, sf):
    return records.absent(t("records"), "domain", "d1", "d3", **_WITHIN)


@query("absence_source_day", _absent_sql("source_id", "source", "src0", "src1"), "records")
def _source_day(t, spark, sf):
    return records.absent(t("records"), "source", "src0", "src1", "source_id", **_WITHIN)


_DEPENDS = "SELECT source_id, target_id, label FROM edges WHERE valid_until IS NULL AND label IN ('calls', 'depends_on')"


@query(
    "graph_impact_hub",
    f""", d AS ({_DEPENDS}), hub AS (SELECT target_id AS id FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    l1 AS (SELECT source_id AS id, min(label) AS via FROM d WHERE target_id = (SELECT id FROM hub) AND source_id <> target_id GROUP BY 1),
    l2 AS (SELECT source_id AS id, min(label) AS via FROM d JOIN l1 ON d.target_id = l1.id WHERE source_id NOT IN (SELECT id FROM l1 UNION SELECT id FROM hub) GROUP BY 1),
    l3 AS (SELECT source_id AS id, min(label) AS via FROM d JOIN l2 ON d.target_id = l2.id WHERE source_id NOT IN (SELECT id FROM l1 UNION SELECT id FROM l2 UNION SELECT id FROM hub) GROUP BY 1)
    SELECT id, depth, via FROM (SELECT id, 1 AS depth, via FROM l1 UNION ALL SELECT id, 2, via FROM l2 UNION ALL SELECT id, 3, via FROM l3) AS x ORDER BY depth, id LIMIT 200""",
    "edges"
)
def _impact_hub(t, spark, sf):
    """What a change of the most used part reaches."""
    edges = t("edges").where("valid_until IS NULL AND label IN ('calls', 'depends_on')")
    hub = edges.groupBy("target_id").count().orderBy(F.desc("count"), "target_id").first()["target_id"]
    return graph.impact(t("edges"), hub)


@query(
    "graph_by_type_files",
    ", f AS (SELECT a.name AS subject, e.label AS predicate, b.name AS object, a.label AS subject_type, b.label AS object_type FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id "
    "WHERE e.valid_until IS NULL AND e.label IN ('calls', 'depends_on') ORDER BY 1, 2, 3 LIMIT 60) SELECT subject, predicate, object FROM f WHERE lower(predicate) = 'calls' ORDER BY 1, 2, 3 LIMIT 20",
    "nodes", "edges"
)
def _by_type_files(t, spark, sf):
    rows = graph.triplets(t("nodes"), t("edges"), labels=("calls", "depends_on"))
    return graph.by_type(rows, ("File",), ("CALLS",), 20).select("subject", "predicate", "object")


@query(
    "graph_chunks_nations",
    _SQL["graph_chunks"].replace("WHERE e.valid_until IS NULL)", "WHERE e.valid_until IS NULL AND e.source_id LIKE 'nation:%')"),
)
def _chunks_nations(t, spark, sf):
    """The hits of a graph question whose edges come from chunks."""
    source = t("chunks").join(t("nation"), F.col("n_nationkey") == F.col("doc_id") % 25).select(
        F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"), F.lit("|in|region:"), F.col("n_regionkey").cast("string")).alias("id"),
        "chunk_id", (1.0 - (F.col("doc_id") % 10) / 20.0).alias("weight")
    )
    edges = t("edges").where("source_id LIKE 'nation:%'").join(source, "id", "left")
    out = graph.graph_chunks(t("nodes"), edges, t("chunks"), "which NATION_1 has ASIA", 10)
    return rounded(out.select("chunk_id", "score", "entity", "subject", "predicate", "object"), "score")


@query(
    "tier_forget_source",
    "SELECT 'record' AS tier, source_id, count(*) AS n FROM records WHERE source_id <> 's7' GROUP BY 2 UNION ALL SELECT 'document', folder, count(*) FROM chunks GROUP BY 2",
    "records", "chunks"
)
def _forget_source(t, spark, sf):
    """What each tier has left of every source once one is forgotten."""
    tables = {"record": t("records").select("id", "source_id"), "document": t("chunks").select("chunk_id", F.col("folder").alias("source_id"))}
    left = tiers.forget(tables, "s7")
    return left["record"].groupBy("source_id").count().select(F.lit("record").alias("tier"), "source_id", F.col("count").alias("n")).unionByName(
        left["document"].groupBy("source_id").count().select(F.lit("document").alias("tier"), "source_id", F.col("count").alias("n"))
    )


@query(
    "tier_extract_orders",
    "SELECT o_orderkey AS id, 'USD' AS unit, CAST(v AS DOUBLE) AS value, CAST(CASE WHEN v > 500 THEN 1.0 ELSE 0.6 END AS DOUBLE) AS confidence FROM (SELECT o_orderkey, unnest([o_custkey + 0.5, 1000 + o_orderkey % 1000]) AS v FROM orders) AS x"
)
def _extract_orders(t, spark, sf):
    """Amounts in the text of every order."""
    registry = tiers.Registry()
    registry.extractors.append(lambda rows: records.currency(rows).withColumn("metric", F.lit("price")))
    registry.validators.append(lambda metric, unit, value: F.when(value > 500, 1.0))
    thousands = F.concat(F.lit("1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    text = F.concat(F.lit("paid $"), F.col("o_custkey").cast("string"), F.lit(".50 of $"), thousands, F.lit(" in all"))
    found = registry.extract(t("orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    confidence = registry.confidence(F.col("metric"), F.col("unit"), F.col("value")).cast("double")
    return found.select(F.col("doc_id").alias("id"), "unit", "value", confidence.alias("confidence"))


@query(
    "files_of_presets",
    "SELECT path, doc_id % 3 = 1 AS wanted FROM (SELECT concat('src/', p, CASE doc_id % 3 WHEN 0 THEN '.bin' WHEN 1 THEN '.h' ELSE '.xyz' END) AS path, doc_id FROM (SELECT doc_id, CAST(doc_id AS STRING) AS p FROM documents) AS d) AS x"
)
def _of_presets(t, spark, sf):
    """Which of all files a list of presets takes in."""
    from sparkloft.functions.text import glob_to_regex

    wanted = "|".join(f"(?:{glob_to_regex('**/' + g)})" for g in files.preset_globs(["c", "text", "c"]))
    ending = F.element_at(F.array(F.lit(".bin"), F.lit(".h"), F.lit(".xyz")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), ending)
    return t("documents").select(path.alias("path")).select("path", F.col("path").rlike(wanted).alias("wanted"))


@query(
    "records_rules_by_metric",
    "SELECT owner, metric, CAST(version AS INT) AS version, retired_at FROM (SELECT DISTINCT subject AS owner, metric FROM records) AS r, LATERAL (SELECT 1 AS version, CASE WHEN owner = 'u7' AND metric = 'click' THEN '2024' END AS retired_at "
    "UNION ALL SELECT 2, CAST(NULL AS STRING) WHERE owner = 'u7' AND metric = 'click') AS v",
    "records"
)
def _rules(t, spark, sf):
    """A rule for what each subject measures; one of them gets a successor."""
    rules = t("records").select(F.col("subject").alias("owner"), "metric").distinct().selectExpr(
        "owner", "metric", "CAST(NULL AS STRING) AS unit", "CAST(NULL AS DOUBLE) AS value_min", "CAST(NULL AS DOUBLE) AS value_max", "CAST(0.6 AS DOUBLE) AS tier",
        "1 AS version", "'2023' AS created_at", "CAST(NULL AS STRING) AS retired_at"
    )
    return records.with_rule(rules, {"owner": "u7", "metric": "click", "tier": 1.0}, "2024").select("owner", "metric", "version", "retired_at")


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("term", "unit", "direction")]))
def _scan_plan(questions: pd.Series) -> pd.DataFrame:
    plans = [compilers.compile_scan(q) for q in questions]
    return pd.DataFrame([(p.term, p.group_by, p.order) if p else (None, None, None) for p in plans], columns=["term", "unit", "direction"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _modes(questions: pd.Series) -> pd.Series:
    different = {q: list(compilers.intents(q)) for q in questions.unique()}  # a question that is asked again is routed once a batch
    return questions.map(different)


@query(
    "question_scan_plans",
    "SELECT p_partkey AS id, concat('part ', CAST(p_partkey AS STRING)) AS term, CASE p_partkey % 2 WHEN 0 THEN 'day' ELSE 'week' END AS unit, 'desc' AS direction FROM part"
)
def _scan_plans(t, spark, sf):
    """A question about every part, compiled."""
    unit = F.when(F.col("p_partkey") % 2 == 0, "day").otherwise("week")
    asked = F.concat(F.lit("how often did I say 'part "), F.col("p_partkey").cast("string"), F.lit("' per "), unit)
    return t("part").select(F.col("p_partkey").alias("id"), _scan_plan(asked).alias("p")).select("id", "p.*")


@query(
    "question_routes",
    "SELECT id, CASE id % 3 WHEN 0 THEN 'compute,hybrid' WHEN 1 THEN 'graph,hybrid' ELSE 'hybrid' END AS modes FROM records",
    "records"
)
def _routes(t, spark, sf):
    """Where a question about every record goes."""
    asked = F.when(F.col("id") % 3 == 0, F.concat(F.lit("which week had the highest "), "metric")).when(
        F.col("id") % 3 == 1, F.concat(F.lit("what depends on the "), "metric")
    ).otherwise(F.concat(F.lit("tell me a story of "), "metric"))
    return t("records").select("id", F.array_join(_modes(asked), ",").alias("modes"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _named(questions: pd.Series) -> pd.Series:
    return questions.map(lambda q: list(graph.query_entities(q)))


@query(
    "question_names",
    "SELECT c_custkey AS id, concat('Client', CAST(c_custkey AS STRING)) AS first, concat('my_func_', CAST(c_custkey % 10 AS STRING)) AS second FROM customer"
)
def _names(t, spark, sf):
    """The names in a question about every customer."""
    key = F.col("c_custkey")
    asked = F.concat(F.lit("what calls Client"), key.cast("string"), F.lit(" and my_func_"), (key % 10).cast("string"), F.lit("?"))
    return t("customer").select(key.alias("id"), _named(asked).alias("n")).select("id", F.get("n", F.lit(0)).alias("first"), F.get("n", F.lit(1)).alias("second"))


_LETTERS = r"regexp_extract_all(lower(text), '\p{L}+')"


@query(
    "language_detected",
    f"""
    WITH w AS (SELECT doc_id, lang, concat('_', unnest({_LETTERS}), '_') AS w FROM documents),
    g AS (SELECT doc_id, lang, substr(w, CAST(i AS BIGINT), 3) AS gram FROM (SELECT doc_id, lang, w, unnest(range(1, length(w) - 1)) AS i FROM w) AS x),
    c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2), v AS (SELECT count(DISTINCT gram) AS v FROM c), t AS (SELECT lang, sum(n) + any_value(v) AS total FROM c, v GROUP BY 1),
    mine AS (SELECT doc_id, gram, count(*) AS m FROM g GROUP BY 1, 2),
    s AS (SELECT doc_id, t.lang, sum(m * ln((coalesce(c.n, 0) + 1) / total)) AS score FROM mine CROSS JOIN t LEFT JOIN c ON c.lang = t.lang AND c.gram = mine.gram GROUP BY 1, 2),
    p AS (SELECT doc_id, lang, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM s),
    b AS (SELECT doc_id, lang, e / sum(e) OVER (PARTITION BY doc_id) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY e DESC, lang) AS r FROM p)
    SELECT d.doc_id, CASE WHEN b.p >= 0.6 THEN b.lang ELSE 'en' END AS language FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1
    """
)
def _detected(t, spark, sf):
    """Every document's language by profiles of all documents."""
    profiles = language_profiles.Profiles.of(language_profiles.counts(t("documents")))
    return t("documents").select("doc_id", language_profiles.detected(F.col("text"), profiles).alias("language"))


@query(
    "identity_resolve_history",
    "WITH a AS (SELECT concat('n', CAST(c_custkey % 300 AS STRING)) AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('s', CAST(c_nationkey % 4 AS STRING)) END AS scope, c_custkey AS person_id, lpad(CAST(c_custkey % 200 AS STRING), 4, '0') AS f, lpad(CAST(c_custkey % 200 + 60 AS STRING), 4, '0') AS u FROM customer "
    "UNION ALL SELECT concat('n', CAST(c_custkey % 300 AS STRING)), concat('s', CAST(c_custkey % 4 AS STRING)), c_custkey, lpad(CAST(c_custkey % 200 + 30 AS STRING), 4, '0'), NULL FROM customer), "
    "m AS (SELECT o_orderkey AS mention_id, concat('n', CAST(o_orderkey % 310 AS STRING)) AS k, CASE WHEN o_custkey % 5 = 4 THEN NULL ELSE concat('s', CAST(o_custkey % 5 AS STRING)) END AS scope, lpad(CAST(o_orderkey % 290 AS STRING), 4, '0') AS t FROM orders) "
    "SELECT mention_id, CASE WHEN count(DISTINCT person_id) = 1 THEN min(person_id) END AS person_id, count(DISTINCT person_id) AS candidates FROM m LEFT JOIN a ON a.k = m.k AND (a.scope IS NULL OR a.scope = m.scope) AND f <= t AND (u IS NULL OR u > t) GROUP BY 1",
)
def _resolve_history(t, spark, sf):
    """Every order as a mention of a name that many share over time, each person with two aliases that overlap."""

    def at(n):
        return F.lpad(n.cast("string"), 4, "0")

    key, name = F.col("c_custkey"), F.concat(F.lit("N"), (F.col("c_custkey") % 300).cast("string")).alias("surface")
    first = t("customer").select(
        name, F.when(key % 3 != 0, F.concat(F.lit("s"), (F.col("c_nationkey") % 4).cast("string"))).alias("scope"), key.alias("person_id"),
        at(key % 200).alias("valid_from"), at(key % 200 + 60).alias("valid_to")
    )
    second = t("customer").select(
        name, F.concat(F.lit("s"), (key % 4).cast("string")).alias("scope"), key.alias("person_id"), at(key % 200 + 30).alias("valid_from"),
        F.lit(None).cast("string").alias("valid_to")
    )
    o = F.col("o_orderkey")
    asked = t("orders").select(
        o.alias("mention_id"), F.concat(F.lit("n"), (o % 310).cast("string")).alias("surface"),
        F.when(F.col("o_custkey") % 5 != 4, F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string"))).alias("scope"), at(o % 290).alias("at")
    )
    return identity.resolve_all(asked, first.unionByName(second))


_BLOCKS = "SELECT p_partkey AS id, p_partkey % 4 AS lang, 25 + p_size % 10 AS h, 1 + p_size % 4 AS n FROM part"


@query(
    "code_chunks_blocks",
    f"WITH p AS ({_BLOCKS}) SELECT id, CAST(j AS INT) AS chunk_index, CAST(1 + j * h AS INT) AS start_line, CAST((j + 1) * h AS INT) AS end_line, concat('F', CAST(j AS STRING)) AS symbol_name, 'function' AS symbol_kind "
    "FROM p, (SELECT unnest(range(0, 4)) AS j) AS s WHERE j < n UNION ALL "
    "SELECT id, CAST(n + j AS INT), CAST(n * h + 1 + j * (h + 1) AS INT), CAST(n * h + (j + 1) * (h + 1) AS INT), concat('M', CAST(j AS STRING)), 'method' FROM p, (SELECT unnest(range(0, 2)) AS j) AS s WHERE lang IN (1, 2)",
)
def _chunks_blocks(t, spark, sf):
    """Chunks of a file in Go, Java, TypeScript or Rust for each part: functions, and a class that is larger than a chunk; braces also in comments and strings."""
    lang, size = F.col("p_partkey") % 4, F.col("p_size") % 10

    def block(head, inner: str, j):
        body = F.array_repeat(F.lit(inner + '  call("}"); // {'), (size + 22).cast("int"))
        return F.array_join(F.concat(F.array(F.concat(F.lit(inner + "// {"), j), head), body, F.array(F.lit(inner + "}"))), "\n")

    def pick(go: str, java: str, ts: str, rust: str, j):
        one = F.when(lang == 0, go).when(lang == 1, java).when(lang == 2, ts).otherwise(rust)
        return F.replace(one, F.lit("#"), j)

    def function(j):
        j = j.cast("string")
        heads = ("func F#(x int) int {", "public static int F#(int x) {", "export function F#(x: number): number {", "pub fn F#<'a>(x: &'a str) -> i64 {")
        return block(pick(*heads, j), "", j)

    def method(j: str):
        return block(pick("", "  private int M#(int x) {", "  M#(x: number): number {", "", F.lit(j)), "  ", F.lit(j))

    functions = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), function), "\n")
    body = F.when(lang.isin(1, 2), F.concat_ws("\n", functions, F.lit("class T {"), method("0"), method("1"), F.lit("}"))).otherwise(functions)
    rows = spread(t("part").select("p_partkey", "p_size"), "p_partkey").select(
        F.col("p_partkey").cast("string").alias("source"), body.alias("text"), F.lit("code").alias("source_type"),
        F.when(lang == 0, "go").when(lang == 1, "java").when(lang == 2, "typescript").otherwise("rust").alias("language")
    )
    out = chunking.chunk_files(rows)
    return out.select(F.col("source").cast("long").alias("id"), "chunk_index", "start_line", "end_line", "symbol_name", "symbol_kind")
