"""The chunk store, the written keyword index, embeddings, identities and memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloft.operators import embedding, identity, memory, store, telemetry
from sparkloft.operators.keyword_index import KeywordIndex
from sparkloft.plans.catalog import query, rounded
from sparkloft.plans.queries_retrieval import _COS, TERMS, _bm25, _query_vector
from sparkloft.storage import folder


@query("store_lookup", "SELECT chunk_id, doc_id, source FROM chunks WHERE doc_id = 7", "chunks")
def _lookup(t, spark, sf):
    wanted = t("chunks").where("doc_id = 7").select("chunk_id").first()[0]
    return store.by_id(t("chunks"), wanted).select("chunk_id", "doc_id", "source")


@query("store_existing", "SELECT chunk_id FROM chunks WHERE doc_id % 3 = 0", "chunks")
def _existing(t, spark, sf):
    wanted = t("documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("doc_id"))
    known = t("chunks").join(wanted, "doc_id").select("chunk_id")
    return store.existing(t("chunks"), known.union(spark.sql("SELECT 'chunk_of_nothing' AS chunk_id")))


@query("store_metadata", "SELECT chunk_id, source, source_type, language, domain FROM chunks WHERE folder = 'src1'", "chunks")
def _metadata(t, spark, sf):
    wanted = store.ids_where(t("chunks"), F.col("folder") == "src1")
    return store.metadata(t("chunks"), wanted).select("chunk_id", "source", "source_type", "language", "domain")


@query("store_pairs", "SELECT chunk_id, source FROM chunks WHERE language = 'de' AND source_type = 'doc'", "chunks")
def _pairs(t, spark, sf):
    return store.id_source_pairs(t("chunks"), (F.col("language") == "de") & (F.col("source_type") == "doc"))


@query(
    "store_insert_only",
    "SELECT chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS state FROM chunks WHERE doc_id % 2 = 0 OR doc_id % 3 = 0", "chunks"
)
def _insert(t, spark, sf):
    rows = t("chunks").select("chunk_id", "doc_id")
    old = rows.where("doc_id % 2 = 0").withColumn("state", F.lit("old"))
    new = rows.where("doc_id % 3 = 0").withColumn("state", F.lit("new"))
    return store.insert_only(old, new.union(new)).select("chunk_id", "state")


@query(
    "store_update",
    "SELECT chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE language END AS language, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN 'private' ELSE sensitivity END AS sensitivity FROM chunks",
    "chunks",
)
def _update(t, spark, sf):
    changed = t("chunks").where("doc_id % 4 = 0")
    changes = changed.select("chunk_id", F.lit("xx").alias("language"), F.when(F.col("doc_id") % 8 != 0, "private").alias("sensitivity"))
    unknown = spark.sql("SELECT 'nothing' AS chunk_id, 'xx' AS language, 'private' AS sensitivity")
    return store.update(t("chunks"), changes.union(unknown)).select("chunk_id", "language", "sensitivity")


@query("store_delete", "SELECT chunk_id, (SELECT count(*) FROM chunks WHERE folder = 'src2') AS deleted FROM chunks WHERE folder <> 'src2'", "chunks")
def _delete(t, spark, sf):
    rows, n = store.delete(t("chunks"), F.col("folder") == "src2")
    return rows.select("chunk_id", F.lit(n).cast("long").alias("deleted"))


@query(
    "store_swap", "SELECT chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS state FROM chunks WHERE doc_id % 5 = 0 OR doc_id % 3 <> 0",
    "chunks"
)
def _swap(t, spark, sf):
    rows = t("chunks").select("chunk_id", "doc_id")
    new = rows.where("doc_id % 5 = 0").withColumn("state", F.lit("new"))
    return store.swap(rows.withColumn("state", F.lit("old")), new, rows.where("doc_id % 3 = 0").select("chunk_id")).select("chunk_id", "state")


@query(
    "store_results",
    "SELECT chunk_id, source, source_type, language, domain, round(n_chars / 2.0, 6) AS score FROM chunks WHERE sensitivity = 'normal'",
    "chunks",
)
def _results(t, spark, sf):
    hits = t("chunks").where("sensitivity = 'normal'").withColumn("score", F.col("n_chars") / 2.0)
    out = store.results(hits)
    return rounded(out.select("chunk_id", "source", "source_type", "language", F.col("metadata")["domain"].alias("domain"), "score"), "score")


@query(
    "reference_boost",
    f", res AS (SELECT chunk_id, score FROM (SELECT chunk_id, {_COS} AS score FROM vectors WHERE vec_id % 2 = 0 ORDER BY 2 DESC, 1 LIMIT 8) AS a), "
    f"cat AS (SELECT chunk_id, score FROM (SELECT chunk_id, {_COS} AS score FROM vectors WHERE vec_id % 3 = 0 ORDER BY 2 DESC, 1 LIMIT 4) AS b WHERE score >= 0.2) "
    "SELECT chunk_id, round(score, 6) AS score, kind FROM (SELECT chunk_id, score, 'chunk' AS kind FROM res UNION ALL "
    "SELECT chunk_id, score * 1.2, 'reference' FROM cat WHERE chunk_id NOT IN (SELECT chunk_id FROM res)) AS x ORDER BY x.score DESC, chunk_id LIMIT 8",
    "vectors",
)
def _reference(t, spark, sf):
    from sparkloft.operators.retrieval import vector_search

    q = _query_vector(t)
    res = vector_search(t("vectors"), q, 8, where=F.col("vec_id") % 2 == 0)
    catalog = vector_search(t("vectors"), q, 4, where=F.col("vec_id") % 3 == 0).withColumnRenamed("chunk_id", "id")
    return rounded(store.reference_boost(res, catalog, 8, floor=0.2, factor=1.2, recalled=4).select("chunk_id", "score", "kind"), "score")


def _filled(t, spark) -> KeywordIndex:
    """An index that took some chunks twice and lost others on the way to the whole table."""
    index, rows = KeywordIndex(spark, folder(spark, "keywords")), t("chunks").select("chunk_id", "doc_id", "text")
    index.add(rows.where("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" the the"))))
    index.remove(rows.where("doc_id % 6 = 0").select("chunk_id"))
    index.add(rows)
    return index


@query("bm25_written_index", f", {_bm25(10)} SELECT chunk_id, round(score, 6) AS score FROM bm", "chunks")
def _written(t, spark, sf):
    return rounded(_filled(t, spark).search(TERMS, 10), "score")


@query(
    "bm25_index_removed",
    f", {_bm25(10).replace('FROM chunks', 'FROM chunks WHERE doc_id % 6 <> 0', 1)} SELECT chunk_id, round(score, 6) AS score FROM bm", "chunks"
)
def _removed(t, spark, sf):
    index = _filled(t, spark)
    index.remove(t("chunks").where("doc_id % 6 = 0").select("chunk_id"))
    return rounded(index.compact(folder(spark, "keywords")).search(TERMS, 10), "score")


@query(
    "embed_by_cache", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS a, CAST(doc_id % 3 = 0 AS BOOLEAN) AS own FROM documents WHERE text IS NOT NULL"
)
def _embed(t, spark, sf):
    d = t("documents").select("doc_id", "text")
    cache = d.where("doc_id % 3 = 0").select(
        embedding.content_hash().alias("content_hash"), F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding")
    )
    wrong = d.where("doc_id % 3 = 1").select(embedding.content_hash().alias("content_hash"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    out, _ = embedding.embed(d, cache.union(wrong), lambda texts: [[float(len(x)), 0.0] for x in texts], 2)
    return out.select("doc_id", F.col("embedding")[0].cast("double").alias("a"), (F.col("doc_id") % 3 == 0).alias("own"))


@query(
    "embed_recoverable",
    "SELECT doc_id FROM chunks c WHERE doc_id % 4 = 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)", "chunks"
)
def _recoverable(t, spark, sf):
    d = t("documents").select("doc_id", "text")
    cache = d.where("doc_id % 3 = 0").select(embedding.content_hash().alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"))
    rows = t("chunks").select("chunk_id", "doc_id", "text")
    return embedding.recoverable(rows.where("doc_id % 4 = 0").select("chunk_id"), rows, cache, 1).select("doc_id")


@query(
    "identity_people",
    "SELECT concat('customer:', CAST(c_custkey AS STRING)) AS id, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 10 <> 0 THEN 'renamed' ELSE c_name END AS name FROM customer"
)
def _people(t, spark, sf):
    people = t("customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    key = F.substring("id", 10, 20).cast("int")
    new = people.where(key % 5 == 0).withColumn("name", F.when(key % 10 != 0, "renamed"))
    return identity.upsert_people(people, new)


@query(
    "identity_aliases", "SELECT surface, scope, person_id, valid_from, valid_to FROM alias UNION ALL SELECT 'NEW', NULL, 'customer:1', NULL, NULL",
    "alias"
)
def _aliases(t, spark, sf):
    new = spark.sql(
        "SELECT 'NEW' AS surface, CAST(NULL AS STRING) AS scope, 'customer:1' AS person_id, CAST(NULL AS STRING) AS valid_from, CAST(NULL AS STRING) AS valid_to"
    )
    once = identity.add_aliases(t("alias"), new.union(new))
    return identity.add_aliases(once, t("alias").union(new))


@query(
    "identity_links",
    "SELECT id, ref, person_id, CASE WHEN id % 7 = 0 THEN 'manual' ELSE method END AS method, CASE WHEN id % 7 = 0 THEN false ELSE stale END AS stale FROM link WHERE id <> 3",
    "link",
)
def _links(t, spark, sf):
    new = t("link").where("id % 7 = 0").withColumn("method", F.lit("manual"))
    return identity.retract(identity.add_links(t("link"), new), 3)


@query(
    "identity_backfill",
    ", l AS (SELECT id, person_id, CASE id % 4 WHEN 0 THEN 'MACHINERY' ELSE 'BUILDING' END AS surface, concat('scope', CAST(id % 9 AS STRING)) AS scope, '2024-05-01T00:00:00' AS at FROM link), "
    "a AS (SELECT * FROM alias WHERE person_id IN ('customer:1', 'customer:2', 'customer:3', 'customer:4', 'customer:5', 'customer:6', 'customer:7', 'customer:8', 'customer:9')), "
    "f AS (SELECT l.id, count(DISTINCT a.person_id) AS n, min(a.person_id) AS p FROM l JOIN a ON lower(a.surface) = lower(l.surface) AND (a.scope IS NULL OR a.scope = l.scope) "
    "AND (a.valid_from IS NULL OR a.valid_from <= l.at) AND (a.valid_to IS NULL OR a.valid_to > l.at) WHERE l.person_id IS NULL GROUP BY 1) "
    "SELECT l.id, coalesce(l.person_id, CASE WHEN f.n = 1 THEN f.p END) AS person_id FROM l LEFT JOIN f ON f.id = l.id",
    "link",
    "alias",
)
def _backfill(t, spark, sf):
    said = F.when(F.col("id") % 4 == 0, "MACHINERY").otherwise("BUILDING")
    links = t("link").withColumns(
        {"surface": said, "scope": F.concat(F.lit("scope"), (F.col("id") % 9).cast("string")), "at": F.lit("2024-05-01T00:00:00")}
    )
    aliases = t("alias").where(F.col("person_id").isin(*[f"customer:{k}" for k in range(1, 10)]))
    return identity.backfill(links, aliases).select("id", "person_id")


@query(
    "identity_forget_source",
    ", k AS (SELECT * FROM link WHERE NOT ref LIKE 'session:4#%'), lost AS (SELECT person_id FROM link WHERE person_id IS NOT NULL AND person_id NOT IN (SELECT person_id FROM k WHERE person_id IS NOT NULL)) "
    "SELECT 'link' AS kind, count(*) AS n FROM k UNION ALL SELECT 'alias', count(*) FROM alias WHERE person_id NOT IN (SELECT person_id FROM lost)",
    "link",
    "alias",
)
def _forget(t, spark, sf):
    links, aliases = identity.forget_source(t("link"), t("alias"), "session:4")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(links, "link").union(count(aliases, "alias"))


@query(
    "identity_chunks",
    "SELECT DISTINCT x.session_id, x.idx FROM turns x JOIN link l ON l.ref = concat('session:', CAST(x.session_id AS STRING), '#', CAST(x.idx AS STRING)) WHERE l.person_id = 'customer:5' AND NOT l.stale",
    "turns",
    "link",
)
def _chunks(t, spark, sf):
    chunks = t("turns").select(
        "session_id", "idx", F.concat(F.lit("session:"), F.col("session_id").cast("string")).alias("source_id"),
        F.col("idx").cast("int").alias("chunk_index")
    )
    return identity.chunks_of_person(t("link"), chunks, "customer:5").select("session_id", "idx")


_MV = "SELECT m.id, m.section, m.active, e.embedding FROM memories m JOIN embeddings e ON e.vec_id = m.doc_id"


@query(
    "memory_superseded",
    f", v AS ({_MV}), s AS (SELECT id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score FROM v WHERE active AND section = 'section1') "
    "SELECT id, round(score, 6) AS score FROM s WHERE score >= 0.2 ORDER BY s.score DESC, id LIMIT 1",
    "memories",
)
def _superseded(t, spark, sf):
    rows = t("memories").join(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return rounded(memory.superseded(rows, _query_vector(t), "section1", 0.2).select("id", "score"), "score")


@query(
    "usage_accumulate",
    "SELECT bucket, channel, provider, model, source, CAST(2 * sum(calls) AS BIGINT) AS calls, CAST(2 * sum(tokens_in) AS BIGINT) AS tokens_in FROM usage GROUP BY ALL",
    "usage"
)
def _accumulate(t, spark, sf):
    rows = t("usage").drop("event_id")
    once = telemetry.accumulate(rows.limit(0), rows)
    return telemetry.accumulate(once, rows).select("bucket", *telemetry.KEYS, "calls", "tokens_in")


@query(
    "bench_stats",
    "WITH v AS (SELECT list_sort(list(value)) AS v, count(*) AS n, avg(value) AS mean FROM events) SELECT v[CAST(n * 50 // 100 AS BIGINT) + 1] AS p50, v[CAST(n * 95 // 100 AS BIGINT) + 1] AS p95, v[CAST(n * 99 // 100 AS BIGINT) + 1] AS p99, round(mean, 6) AS mean, round(1000.0 / mean, 6) AS qps FROM v"
)
def _bench(t, spark, sf):
    return rounded(telemetry.bench_stats(t("events").select(F.col("value").alias("latency_ms"))), "mean", "qps")


@query(
    "queue_drain",
    ", r AS (SELECT event_id, channel, row_number() OVER (PARTITION BY channel ORDER BY event_id) AS turn, CASE WHEN errors > 0 THEN 0.0 ELSE 1.5 END AS cost FROM usage), "
    "d AS (SELECT *, sum(cost) OVER (ORDER BY turn, channel) AS spent FROM (SELECT * FROM r ORDER BY turn, channel LIMIT 40) AS x) SELECT event_id, round(spent, 6) AS spent FROM d WHERE spent <= 20.0 OR cost = 0",
    "usage",
)
def _drain(t, spark, sf):
    items = t("usage").select("event_id", "channel", F.when(F.col("errors") > 0, 0.0).otherwise(1.5).alias("cost"))
    return rounded(telemetry.drain(items, "channel", "event_id", 40, 20.0).select("event_id", "spent"), "spent")


@query(
    "log_retention", "SELECT id FROM query_log WHERE strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%Y-%m-%d') >= '2024-01-20'", "query_log"
)
def _retention(t, spark, sf):
    days = t("query_log").select("id", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("day"))
    return telemetry.retained(days, "day", 10, "2024-01-30").select("id")


@query(
    "query_log_rows",
    ", d AS (SELECT c.doc_id % 40 AS id, c.chunk_id, substr(c.text, 1, 30) AS text, row_number() OVER (PARTITION BY c.doc_id % 40 ORDER BY c.doc_id) AS k FROM chunks c) SELECT id, count(*) AS result_count, string_agg(CASE WHEN k <= 3 THEN text END, '|' ORDER BY k) AS kept FROM d GROUP BY 1",
    "chunks"
)
def _log(t, spark, sf):
    hits = t("chunks").groupBy((F.col("doc_id") % 40).alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "chunk_id", F.lit(1.0).alias("score"), "text"))).alias("results")
    )
    out = telemetry.log_rows(hits, 3, 30)
    return out.select(
        "id", F.col("result_count").cast("long").alias("result_count"), F.array_join(F.transform("results", lambda r: r["text"]), "|").alias("kept")
    )
