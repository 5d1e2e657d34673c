"""Usage, query log, identity, memory, queues and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloft.operators import identity, memory, telemetry
from sparkloft.plans.catalog import query, rounded

_SUMS = "CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in"
_ERR = "CAST(sum(CASE WHEN errors > 0 THEN calls ELSE 0 END) AS BIGINT) AS error_calls"


@query(
    "usage_totals",
    f"SELECT channel, provider, model, source, {_SUMS}, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(errors) AS BIGINT) AS errors FROM usage GROUP BY 1, 2, 3, 4",
    "usage"
)
def _totals(t, spark, sf):
    return telemetry.usage_totals(t("usage"))


@query("usage_series", f"SELECT (bucket // 60) * 60 AS start, channel, {_SUMS}, {_ERR} FROM usage GROUP BY 1, 2", "usage")
def _series(t, spark, sf):
    return telemetry.usage_series(t("usage"))


@query("usage_series_by_source", f"SELECT (bucket // 1440) * 1440 AS start, channel, source, {_SUMS}, {_ERR} FROM usage GROUP BY 1, 2, 3", "usage")
def _by_source(t, spark, sf):
    return telemetry.usage_series(t("usage"), 1440, by=("channel", "source"))


@query(
    "usage_queue_latest", "SELECT source, bucket, event_id FROM usage u WHERE bucket = (SELECT max(bucket) FROM usage v WHERE v.source = u.source)",
    "usage"
)
def _latest(t, spark, sf):
    return telemetry.latest(t("usage").select("source", "bucket", "event_id"), "source", "bucket").select("source", "bucket", "event_id")


@query(
    "usage_retention",
    "SELECT bucket // 1440 AS day, count(*) AS n FROM usage WHERE bucket // 1440 IN (SELECT DISTINCT bucket // 1440 FROM usage ORDER BY 1 DESC LIMIT 7) GROUP BY 1",
    "usage"
)
def _retention(t, spark, sf):
    return telemetry.prune(t("usage"), 7).groupBy(F.floor(F.col("bucket") / 1440).alias("day")).agg(F.count("*").alias("n"))


@query(
    "querylog_recent",
    "SELECT id, ts, mode, query FROM query_log WHERE mode = 'view' AND contains(lower(query), 'q1') ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 5",
    "query_log"
)
def _recent(t, spark, sf):
    return telemetry.recent(t("query_log"), mode="view", contains="Q1", limit=20, offset=5).select("id", "ts", "mode", "query")


@query("querylog_mode_dist", "SELECT mode, count(*) AS n FROM query_log GROUP BY 1", "query_log")
def _modes(t, spark, sf):
    return telemetry.mode_distribution(t("query_log"))


_P = "v[CAST(round_even({p} * (n - 1), 0) AS INT) + 1]".format


@query(
    "querylog_latency",
    f", a AS (SELECT count(*) AS n, avg(latency_ms) AS m, list_sort(list(latency_ms)) AS v FROM query_log) SELECT n, round(m, 6) AS avg, round({_P(p=0.5)}, 6) AS p50, round({_P(p=0.95)}, 6) AS p95 FROM a",
    "query_log"
)
def _latency(t, spark, sf):
    return rounded(telemetry.latency(t("query_log")), "avg", "p50", "p95")


@query(
    "querylog_trend",
    f", a AS (SELECT hour, count(*) AS n, avg(latency_ms) AS m, list_sort(list(latency_ms)) AS v FROM query_log GROUP BY 1) SELECT hour, n, round(m, 6) AS avg, round({_P(p=0.5)}, 6) AS p50, round({_P(p=0.95)}, 6) AS p95 FROM a",
    "query_log"
)
def _trend(t, spark, sf):
    return rounded(telemetry.latency(t("query_log"), "hour"), "avg", "p50", "p95")


_TOP = "SELECT query, count(*) AS n, round(avg(latency_ms), 6) AS avg_latency_ms, count(*) FILTER (WHERE result_count = 0) AS zero_results, max(ts) AS last_ts, arg_max(id, CAST(ts AS BIGINT) * 1000000000 + id) AS last_id FROM query_log {w} GROUP BY 1 ORDER BY 2 DESC, 5 DESC, 1 LIMIT 10".format


@query("querylog_top", _TOP(w=""), "query_log")
def _top(t, spark, sf):
    return rounded(telemetry.top_queries(t("query_log")), "avg_latency_ms")


@query("querylog_zero", _TOP(w="WHERE result_count = 0"), "query_log")
def _zero(t, spark, sf):
    return rounded(telemetry.top_queries(t("query_log"), zero_only=True), "avg_latency_ms")


_AT = "2024-03-01T00:00:00"


@query(
    "identity_resolve",
    f"SELECT DISTINCT person_id FROM alias WHERE lower(surface) = 'building' AND (scope IS NULL OR scope = 'scope1') AND valid_from <= '{_AT}' AND (valid_to IS NULL OR valid_to > '{_AT}')",
    "alias"
)
def _resolve(t, spark, sf):
    return identity.resolve(t("alias"), "BUILDING", "scope1", _AT)


@query(
    "identity_resolve_all",
    f", men AS (SELECT c_custkey AS mention_id, concat(c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE '' END) AS surface, concat('scope', CAST(c_nationkey % 4 AS STRING)) AS scope FROM customer WHERE c_custkey <= 20) SELECT mention_id, CASE WHEN count(DISTINCT a.person_id) = 1 THEN min(a.person_id) END AS person_id, count(DISTINCT a.person_id) AS candidates FROM men m LEFT JOIN alias a ON lower(a.surface) = lower(m.surface) AND (a.scope IS NULL OR a.scope = m.scope) AND a.valid_from <= '{_AT}' AND (a.valid_to IS NULL OR a.valid_to > '{_AT}') GROUP BY 1",
    "alias"
)
def _resolve_all(t, spark, sf):
    c = t("customer").where("c_custkey <= 20")
    m = c.select(
        F.col("c_custkey").alias("mention_id"), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 9 == 0, "x").otherwise("")).alias("surface"),
        F.concat(F.lit("scope"), (F.col("c_nationkey") % 4).cast("string")).alias("scope"), F.lit(_AT).alias("at")
    )
    return identity.resolve_all(m, t("alias"))


@query(
    "identity_group_results",
    ", res AS (SELECT DISTINCT ref FROM link WHERE id % 10 = 0 UNION SELECT 'session:none#0'), l AS (SELECT DISTINCT ref, person_id FROM link WHERE person_id IS NOT NULL AND NOT stale) SELECT coalesce(person_id, 'unresolved') AS person, count(*) AS hits, round(max(length(res.ref) / 10.0), 6) AS best FROM res LEFT JOIN l ON l.ref = res.ref GROUP BY 1",
    "link"
)
def _group(t, spark, sf):
    refs = t("link").where("id % 10 = 0").select("ref").union(spark.sql("SELECT 'session:none#0' AS ref")).distinct()
    return rounded(identity.group_by_person(refs.withColumn("score", F.length("ref") / 10.0), t("link")), "best")


@query(
    "identity_person_refs",
    "SELECT DISTINCT split_part(ref, '#', 1) AS source_id, CAST(split_part(ref, '#', 2) AS INT) AS chunk_index FROM link WHERE person_id = 'customer:7' AND NOT stale",
    "link"
)
def _refs(t, spark, sf):
    return identity.refs_of_person(t("link"), "customer:7")


_CAP = 300_000


@query(
    "memory_evict",
    f", x AS (SELECT id, coalesce(last_referenced_at, created_at) AS since, confidence, length(text) AS size FROM memories WHERE active AND origin LIKE 'session:%'), r AS (SELECT id, sum(size) OVER (ORDER BY since, confidence, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x) SELECT id FROM r WHERE (SELECT sum(length(text)) FROM memories) - coalesce(before, 0) > {_CAP}",
    "memories"
)
def _evict(t, spark, sf):
    return memory.evict(t("memories"), _CAP)


@query(
    "memory_duplicates", r"SELECT id FROM memories WHERE active AND contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'the and')",
    "memories"
)
def _duplicates(t, spark, sf):
    return memory.duplicates(t("memories"), "The  AND").select("id")


@query(
    "context_pack",
    ", x AS (SELECT id, row_number() OVER w AS place, sum(length(concat('- (', section, ') ', text)) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM memories WHERE active AND sensitivity = 'normal' WINDOW w AS (ORDER BY confidence DESC, created_at DESC, id DESC)) SELECT id, CAST(place AS INT) AS place FROM x WHERE used <= 20000 OR place = 1",
    "memories"
)
def _pack(t, spark, sf):
    return memory.context(t("memories"), 20_000)


@query(
    "cache_evict", "SELECT doc_id FROM documents ORDER BY (doc_id * 7919) % 10007, doc_id LIMIT (SELECT greatest(1, count(*) // 10) FROM documents)"
)
def _cache(t, spark, sf):
    d = t("documents").select(F.col("doc_id").alias("key"), ((F.col("doc_id") * 7919) % 10007).alias("last_accessed"))
    return telemetry.cache_evict(d, d.count()).select(F.col("key").alias("doc_id"))


@query("eval_recall_mrr", """
    WITH e AS (SELECT user_id AS case_id, CASE WHEN user_id % 2 = 0 THEN 'bm25' ELSE 'hybrid' END AS mode, event_type AS item FROM events WHERE event_id % 7 = 0 GROUP BY ALL),
    r AS (SELECT user_id AS case_id, CASE WHEN user_id % 2 = 0 THEN 'bm25' ELSE 'hybrid' END AS mode, event_type AS item, min(event_id % 5) + 1 AS rank FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
    c AS (SELECT e.mode, e.case_id, count(r.rank) * 1.0 / count(*) AS recall, coalesce(1.0 / min(r.rank), 0.0) AS rr FROM e LEFT JOIN r ON r.case_id = e.case_id AND r.mode = e.mode AND r.item = e.item AND r.rank <= 3 GROUP BY 1, 2)
    SELECT mode, count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM c GROUP BY 1""")
def _eval(t, spark, sf):
    mode = F.when(F.col("user_id") % 2 == 0, "bm25").otherwise("hybrid").alias("mode")
    e = t("events").where("event_id % 7 = 0").select(F.col("user_id").alias("case_id"), mode, F.col("event_type").alias("item")).distinct()
    r = t("events").where("event_id % 3 = 0").groupBy(
        F.col("user_id").alias("case_id"), mode, F.col("event_type").alias("item")
    ).agg((F.min(F.col("event_id") % 5) + 1).alias("rank"))
    return rounded(telemetry.retrieval_quality(r, e, 3), "recall", "mrr")


@query(
    "queue_pending",
    ", q AS (SELECT CAST(user_id AS STRING) AS chunk_id, max_by(event_type, event_id) AS content_hash, max(event_id) AS created_at FROM events GROUP BY 1) SELECT chunk_id, content_hash, created_at FROM q WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 4 = 0 AND CAST(s.user_id AS STRING) = q.chunk_id AND s.event_type = q.content_hash)".removeprefix(",").replace(
        " q AS", "WITH q AS", 1
    )
)
def _pending(t, spark, sf):
    e = t("events").select(
        F.col("user_id").cast("string").alias("chunk_id"), F.col("event_type").alias("content_hash"), F.col("event_id").alias("created_at")
    )
    return telemetry.pending(e, e.where("created_at % 4 = 0"))


@query(
    "queue_round_robin",
    "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events) AS x ORDER BY turn, event_type LIMIT 23"
)
def _robin(t, spark, sf):
    return telemetry.round_robin(t("events").select("event_type", "event_id"), "event_type", "event_id", 23).select("event_type", "event_id")


@query(
    "budget_trailing_hour",
    "SELECT event_id, in_hour, in_hour <= 3 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM events) AS x"
)
def _budget(t, spark, sf):
    e = t("events").select("event_id", "user_id", F.unix_timestamp("ts").alias("s"))
    return telemetry.trailing_hour(e, "user_id", "s", 3).select("event_id", "in_hour", "allowed")


@query(
    "stream_minute_counts",
    "SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"
)
def _stream(t, spark, sf):
    from sparkloft.streaming.feeds import minute_counts

    return rounded(minute_counts(spark, f"{sf}/events.parquet"), "total")


@query(
    "folders_debounced",
    """
    WITH c AS (SELECT concat('f', CAST(user_id % 20 AS STRING)) AS folder, concat('p', CAST(event_id % 50 AS STRING)) AS path, epoch_us(ts) AS us,
                      CAST(CASE WHEN user_id % 4 = 0 THEN 3600 ELSE 1800 END AS BIGINT) * 1000000 AS wait FROM events),
    g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY folder ORDER BY us, path) < wait THEN 0 ELSE 1 END AS opens FROM c),
    b AS (SELECT *, sum(opens) OVER (PARTITION BY folder ORDER BY us, path ROWS UNBOUNDED PRECEDING) AS burst FROM g),
    f AS (SELECT folder, min(us) AS first, max(us) AS last, count(DISTINCT path) AS files, max(wait) AS wait FROM b GROUP BY folder, burst)
    SELECT folder, first, last, files, CAST(wait > 0 AS BOOLEAN) AS queued FROM f WHERE last + wait <= (SELECT max(us) // 1000 * 1000 FROM c)
    """,
)
def _debounced(t, spark, sf):
    """Events as changes of twenty folders, five of which wait longer; a stream, each folder on its own timer."""
    from sparkloft.streaming.watch import watched

    def changes(events):
        wait = F.when(F.col("user_id") % 4 == 0, 3600.0)
        folder, path = F.concat(F.lit("f"), F.col("user_id") % 20), F.concat(F.lit("p"), F.col("event_id") % 50)
        return events.select(folder.alias("folder"), path.alias("path"), F.col("ts").cast("timestamp").alias("ts"), wait.alias("debounce"))

    out = watched(spark, f"{sf}/events.parquet", changes, debounce=1800.0)
    return out.select("folder", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "files", "queued")


@query(
    "stream_call_budget",
    """
    WITH c AS (SELECT event_id AS id, concat('u', CAST(user_id AS STRING)) AS key, epoch_us(ts) AS us FROM events),
    n AS (SELECT key, id, us, count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW) AS in_hour FROM c)
    SELECT key, id, in_hour, in_hour <= 2 AS allowed FROM n WHERE us <= (SELECT max(us) // 1000 * 1000 FROM c)
    """,
)
def _call_budget(t, spark, sf):
    """Events as calls of users: two in twelve hours fit."""
    from sparkloft.streaming.budget import judged

    def calls(events):
        return events.select(F.concat(F.lit("u"), F.col("user_id")).alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))

    return judged(spark, f"{sf}/events.parquet", calls, budget=2, seconds=43200.0).select("key", "id", "in_hour", "allowed")


@query(
    "stream_unseen_chunks",
    """
    WITH e AS (SELECT concat('c', CAST(user_id AS STRING)) AS chunk_id, event_type AS content_hash, epoch_us(ts) AS us FROM events),
    n AS (SELECT *, lag(content_hash) OVER w AS was, lag(us) OVER w AS before FROM e WINDOW w AS (PARTITION BY chunk_id ORDER BY us, content_hash))
    SELECT chunk_id, content_hash, us FROM n WHERE (was IS NULL OR was <> content_hash OR us - before > 86400000000) AND us <= (SELECT max(us) // 1000 * 1000 FROM e)
    """,
)
def _unseen(t, spark, sf):
    """Events as new contents of chunks: those that differ from what their chunk was queued with in the last day."""
    from sparkloft.streaming import pending

    def rows(events):
        made = events.select(F.concat(F.lit("c"), F.col("user_id")).alias("chunk_id"), F.col("event_type").alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"))
        return pending.unseen(made, keep=86400.0)

    return pending.of_folder(spark, f"{sf}/events.parquet", rows).select("chunk_id", "content_hash", F.unix_micros("ts").alias("us"))
