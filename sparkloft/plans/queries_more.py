"""Listings, jobs, weighted fields, extraction fan-out and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloft.functions.text import analyze, prefix_swap
from sparkloft.operators import graph, identity, records, retrieval, sessions, store, telemetry
from sparkloft.plans.catalog import query, rounded

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')".format
_JOBS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_orderkey % 3 AS changed, o_custkey AS created FROM orders"


@query(
    "documents_list",
    "SELECT source, count(*) AS chunks, max(created_at) AS newest FROM chunks WHERE contains(source, 'src1') GROUP BY 1 ORDER BY 1 LIMIT 20 OFFSET 10",
    "chunks"
)
def _documents(t, spark, sf):
    return store.documents(t("chunks"), "src1", 10, 20)


@query(
    "documents_counts", "SELECT CASE WHEN source_type = 'code' THEN 'code' ELSE 'doc' END AS kind, folder, count(*) AS n FROM chunks GROUP BY 1, 2",
    "chunks"
)
def _counts(t, spark, sf):
    return store.document_counts(t("chunks"))


def _jobs(t):
    return t("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
        (F.col("o_orderkey") % 3).alias("changed"), F.col("o_custkey").alias("created")
    )


@query(
    "jobs_visible",
    f"SELECT id, status FROM ({_JOBS}) AS j WHERE NOT (status = 'done' AND changed = 0) ORDER BY created DESC, id DESC LIMIT 15 OFFSET 3"
)
def _visible(t, spark, sf):
    return telemetry.visible_jobs(_jobs(t), 15, 3).select("id", "status")


@query("jobs_stats", f"SELECT status, count(*) AS n FROM ({_JOBS}) AS j GROUP BY 1")
def _stats(t, spark, sf):
    return telemetry.queue_stats(_jobs(t))


@query(
    "cache_economics",
    "SELECT model, CAST(sum(calls) AS BIGINT) AS hits, CAST(sum(errors) AS BIGINT) AS misses, round(sum(calls) * p * 200 / 1e6, 6) AS saved, round(sum(errors) * p * 200 / 1e6, 6) AS spent, round(sum(calls) / (sum(calls) + sum(errors)), 6) AS hit_rate FROM (SELECT u.*, CASE model WHEN 'm0' THEN 20.0 WHEN 'm1' THEN 130.0 ELSE 0.0 END AS p FROM usage u) AS x GROUP BY model, p",
    "usage"
)
def _economics(t, spark, sf):
    prices = spark.createDataFrame([("m0", 20.0), ("m1", 130.0)], "model string, price double")
    cache = t("usage").select("model", F.col("calls").alias("hits"), F.col("errors").alias("misses"))
    return rounded(telemetry.cache_economics(cache, prices, 200.0), "saved", "spent", "hit_rate")


@query(
    "retrieve_weighted_fields",
    f", w AS (SELECT chunk_id, {_TOK('folder')} AS a, {_TOK('text')} AS c FROM chunks), s AS (SELECT chunk_id, 1.0 * len(list_filter(a, lambda x: x = 'the')) / (len(list_filter(a, lambda x: x = 'the')) + 1.0) + 0.2 * len(list_filter(c, lambda x: x = 'the')) / (len(list_filter(c, lambda x: x = 'the')) + 1.0) + 1.0 * len(list_filter(a, lambda x: x = 'src3')) / (len(list_filter(a, lambda x: x = 'src3')) + 1.0) + 0.2 * len(list_filter(c, lambda x: x = 'src3')) / (len(list_filter(c, lambda x: x = 'src3')) + 1.0) AS raw FROM w WHERE (list_contains(a, 'the') OR list_contains(c, 'the')) AND (list_contains(a, 'src3') OR list_contains(c, 'src3')) ORDER BY 2 DESC, 1 LIMIT 10) SELECT chunk_id, round(raw / (SELECT max(raw) FROM s), 6) AS score FROM s",
    "chunks"
)
def _fields(t, spark, sf):
    return rounded(retrieval.field_search(t("chunks"), ("the", "src3"), {"folder": 1.0, "text": 0.2}, 10).select("chunk_id", "score"), "score")


@query(
    "rerank_scores",
    "SELECT event_id, least(greatest(coalesce(CAST(nullif(regexp_extract(concat('score: ', CAST(event_id % 15 AS STRING), '.5 of 10'), '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE), 0.0), 0.0), 10.0) AS score FROM events"
)
def _scores(t, spark, sf):
    said = F.concat(F.lit("score: "), (F.col("event_id") % 15).cast("string"), F.lit(".5 of 10"))
    return t("events").select("event_id", retrieval.first_number(said).alias("score"))


@query("analyze_stopwords", f"SELECT doc_id, len(list_filter({_TOK('text')}, lambda x: x NOT IN ('the', 'and', 'of'))) AS n FROM documents")
def _stop(t, spark, sf):
    return t("documents").select("doc_id", F.size(analyze(F.col("text"), ("the", "and", "of"))).cast("long").alias("n"))


_TRI = "SELECT s.name AS subject, s.label AS subject_type, e.label AS predicate, t.name AS object, t.label AS object_type FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.valid_until IS NULL AND s.sensitivity = 'normal' AND t.sensitivity = 'normal'"


@query(
    "graph_by_type",
    f", f AS ({_TRI} AND e.label IN ('in', 'calls') ORDER BY 1, 3, 4 LIMIT 60) SELECT subject, predicate, object FROM f WHERE (subject_type IN ('File') OR object_type IN ('File')) AND lower(predicate) IN ('calls', 'in') ORDER BY 1, 2, 3 LIMIT 20",
    "nodes", "edges"
)
def _by_type(t, spark, sf):
    rows = graph.triplets(t("nodes"), t("edges"), labels=("in", "calls"))
    return graph.by_type(rows, ("File",), ("CALLS", "in"), 20).select("subject", "predicate", "object")


@query(
    "graph_context",
    f", f AS ({_TRI} AND e.label = 'in') SELECT (SELECT count(DISTINCT name) FROM (SELECT subject AS name FROM f UNION ALL SELECT object FROM f) AS n) AS entities, (SELECT count(*) FROM (SELECT DISTINCT subject, predicate, object FROM f) AS d) AS paths, (SELECT round(least(avg(CASE WHEN subject_type = 'Nation' THEN 1.0 ELSE 0.5 END), 1.0), 6) FROM f) AS score",
    "nodes", "edges"
)
def _context(t, spark, sf):
    hits = graph.triplets(t("nodes"), t("edges"), labels=("in",)).withColumn("score", F.when(F.col("subject_type") == "Nation", 1.0).otherwise(0.5))
    return rounded(graph.context(hits), "score")


@query(
    "graph_metadata_triples",
    "SELECT subject, predicate, object, chunk_id FROM (SELECT source AS subject, 'defined_in' AS predicate, folder AS object, chunk_id FROM chunks UNION ALL SELECT chunk_id, 'contains', source, chunk_id FROM chunks UNION ALL SELECT source, 'references', language, chunk_id FROM chunks WHERE source_type = 'code') AS x WHERE subject IS NOT NULL AND object IS NOT NULL",
    "chunks"
)
def _metadata(t, spark, sf):
    return graph.metadata_triples(t("chunks"))


@query(
    "graph_invalidate_file",
    "SELECT id, CASE WHEN source_file = 'log3' AND valid_until IS NULL THEN '1999-01-01' ELSE valid_until END AS valid_until FROM edges", "edges"
)
def _invalidate(t, spark, sf):
    return graph.invalidate_file(t("edges"), "log3", "1999-01-01").select("id", "valid_until")


@query(
    "graph_upsert_edges",
    ", n AS (SELECT id FROM edges WHERE label = 'in') SELECT e.id, CASE WHEN n.id IS NULL THEN e.valid_from ELSE substr(concat('2000', n.id), 1, 4) END AS valid_from, CASE WHEN n.id IS NULL THEN e.valid_until END AS valid_until FROM edges e LEFT JOIN n ON n.id = e.id",
    "edges"
)
def _upsert(t, spark, sf):
    e = t("edges")
    new = e.where("label = 'in'").withColumn("valid_from", F.lit(None).cast("string")).withColumn("valid_until", F.lit(None).cast("string"))
    return graph.upsert_edges(e, new, "2000").select("id", "valid_from", "valid_until")


@query("path_rehome", "SELECT doc_id, concat('new/root', substr(concat('docs/', source), 5)) AS path FROM documents")
def _rehome(t, spark, sf):
    return t("documents").select("doc_id", prefix_swap(F.concat(F.lit("docs/"), "source"), "docs", "new/root").alias("path"))


def _extractions(t):
    d = F.struct(
        F.col("text").alias("text"), F.when(F.col("idx") % 3 == 0, "because").otherwise("").alias("rationale"),
        F.when(F.col("idx") % 4 == 3, F.lag("text").over(_ordered())).alias("supersedes")
    )
    return t("turns").withColumn("d", d)


def _ordered():
    from pyspark.sql import Window

    return Window.partitionBy("session_id").orderBy("idx")


_DEC = ", d AS (SELECT session_id, idx, text, CASE WHEN idx % 3 = 0 THEN 'because' ELSE '' END AS rationale, CASE WHEN idx % 4 = 3 THEN lag(text) OVER (PARTITION BY session_id ORDER BY idx) END AS supersedes FROM turns)"


@query(
    "session_promoted",
    _DEC + " SELECT session_id, text FROM d WHERE trim(rationale) <> '' AND NOT EXISTS (SELECT 1 FROM d x WHERE x.session_id = d.session_id AND x.supersedes = d.text)",
    "turns"
)
def _promoted(t, spark, sf):
    return sessions.promoted(_extractions(t).select("session_id", "d.text", "d.rationale", "d.supersedes")).select("session_id", "text")


@query(
    "session_fan_out",
    _DEC + ", s AS (SELECT session_id, string_agg(role, ' ' ORDER BY idx) AS summary FROM turns GROUP BY 1) "
    "SELECT session_id, 'decisions' AS tier, concat('decision:', substr(sha256(concat(CAST(session_id AS STRING), chr(10), text)), 1, 32)) AS item FROM d "
    "UNION ALL SELECT session_id, 'summary', concat('summary:', substr(sha256(concat(CAST(session_id AS STRING), chr(10), summary)), 1, 32)) FROM s "
    "UNION ALL SELECT DISTINCT session_id, 'triplets', concat(role, ' touches b') FROM turns UNION ALL SELECT session_id, 'superseded', concat(supersedes, ' -> ', text) FROM d WHERE supersedes IS NOT NULL",
    "turns",
)
def _fan_out(t, spark, sf):
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "role"))), lambda x: x["role"]), " ").alias("summary")
    triple = F.collect_list(
        F.struct(F.col("role").alias("subject"), F.lit("touches").alias("relation"), F.lit("b").alias("object"))
    ).alias("triplets")
    out = sessions.fan_out(_extractions(t).groupBy("session_id").agg(F.collect_list("d").alias("decisions"), said, triple))
    rows = out["decisions"].select("session_id", F.lit("decisions").alias("tier"), F.col("chunk_id").alias("item"))
    rows = rows.union(out["summary"].select("session_id", F.lit("summary"), "chunk_id"))
    rows = rows.union(out["triplets"].select("session_id", F.lit("triplets"), F.concat_ws(" ", "subject", "relation", "object")))
    return rows.union(out["superseded"].select("session_id", F.lit("superseded"), F.concat("old", F.lit(" -> "), "new")))


_SESS = "s AS (SELECT conv_id AS session_id, concat('t', CAST(conv_id % 3 AS STRING)) AS tool, count(*) AS size, CAST(conv_id * 10 AS DOUBLE) AS modified FROM conversations GROUP BY conv_id)"


@query(
    "session_pending",
    f"WITH {_SESS} SELECT s.session_id, s.tool, s.size FROM s LEFT JOIN (SELECT session_id, size - session_id % 2 AS seen FROM s WHERE session_id % 3 = 0) AS m ON m.session_id = s.session_id WHERE (600 - s.modified >= 100 OR s.modified < (SELECT max(modified) FROM s x WHERE x.tool = s.tool)) AND (seen IS NULL OR s.size > seen)"
)
def _pending(t, spark, sf):
    s = t("conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("size")).withColumn(
        "tool", F.concat(F.lit("t"), (F.col("session_id") % 3).cast("string"))
    ).withColumn("modified", (F.col("session_id") * 10).cast("double"))
    marks = s.where("session_id % 3 = 0").select("session_id", (F.col("size") - F.col("session_id") % 2).alias("size"))
    return sessions.pending(s, marks, 600.0, 100.0)


@query(
    "records_revalidate",
    "SELECT id, CAST(CASE WHEN metric = 'error' AND confidence < 0.5 THEN CASE WHEN value > 50 THEN 1.0 ELSE 0.6 END ELSE confidence END AS DOUBLE) AS confidence FROM records",
    "records"
)
def _revalidate(t, spark, sf):
    return records.revalidated(t("records"), F.when(F.col("value") > 50, 1.0).otherwise(0.6), "error", 0.5).select("id", "confidence")


@query("identity_stale_mark", "SELECT id, stale OR (ref LIKE 'session:7#%' AND ref NOT IN ('session:7#1', 'session:7#2')) AS stale FROM link", "link")
def _stale(t, spark, sf):
    alive = t("link").where("ref in ('session:7#1', 'session:7#2')").select("ref")
    return identity.stale_marked(t("link"), "session:7", alive).select("id", "stale")


@query(
    "graph_degree_histogram",
    "SELECT degree, count(*) AS n FROM (SELECT node, count(*) AS degree FROM (SELECT id, source_id AS node FROM edges WHERE valid_until IS NULL UNION SELECT id, target_id FROM edges WHERE valid_until IS NULL) AS x GROUP BY 1) AS d GROUP BY 1",
    "edges"
)
def _histogram(t, spark, sf):
    return graph.degrees(t("edges")).groupBy("degree").agg(F.count("*").alias("n"))
