"""Chunks, manifests, sessions and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloft.functions.text import chunk_id, minified, token_estimate
from sparkloft.operators import ingest, store
from sparkloft.plans.catalog import query, rounded

_TOKENS = "CAST(ceil(length(text) / 4.0) AS BIGINT)"


@query(
    "chunk_ids",
    "SELECT doc_id, concat('chunk_', substr(md5(concat(source, '_', CAST(doc_id AS STRING))), 1, 16)) AS chunk_id, concat('session:', substr(sha256(concat(source, chr(10), text)), 1, 32)) AS content_id FROM documents"
)
def _ids(t, spark, sf):
    from sparkloft.functions.text import content_id

    return t("documents").select(
        "doc_id", chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"),
        content_id("session:", F.col("source"), F.col("text")).alias("content_id")
    )


@query(
    "chunk_stats",
    f"SELECT count(*) AS chunks, round(avg({_TOKENS}), 6) AS avg_tokens, min({_TOKENS}) AS min_tokens, max({_TOKENS}) AS max_tokens, CAST(sum({_TOKENS}) AS BIGINT) AS total_tokens, count(DISTINCT source) AS sources, count(DISTINCT language) AS languages FROM chunks",
    "chunks"
)
def _chunk_stats(t, spark, sf):
    return rounded(ingest.chunk_stats(t("chunks")), "avg_tokens")


@query(
    "token_estimate",
    f"SELECT CAST(sum({_TOKENS}) AS BIGINT) AS tokens, count(*) AS chunks, greatest(50000, CAST(2.0 * count(*) * 512 AS BIGINT)) AS budget, sum({_TOKENS}) > greatest(50000, CAST(2.0 * count(*) * 512 AS BIGINT)) AS over FROM chunks",
    "chunks"
)
def _estimate(t, spark, sf):
    return ingest.token_budget(t("chunks")).withColumn("budget", F.col("budget").cast("long"))


@query(
    "doc_minified",
    r"SELECT doc_id, (coalesce(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))), 0) > 50000 OR (length(text) >= 50000 AND (length(text) - length(replace(text, chr(10), ''))) / length(text) < 0.001) OR doc_id % 50 = 0) AS minified FROM documents"
)
def _minified(t, spark, sf):
    name = F.when(F.col("doc_id") % 50 == 0, "lib.min.js").otherwise("page.md")
    return t("documents").select("doc_id", minified(name, F.col("text")).alias("minified"))


@query("manifest_diff", """, d AS (SELECT * FROM disk WHERE doc_id % 13 <> 0) SELECT coalesce(p.path, d.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN d.path IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM disk k WHERE k.path = p.path) THEN 'out_of_scope' ELSE 'deleted' END
    WHEN p.pending_reindex THEN 'changed' WHEN p.mtime = d.mtime OR p.checksum = d.checksum THEN 'unchanged' ELSE 'changed' END AS state FROM manifest_prior p FULL OUTER JOIN d ON p.path = d.path""", "disk", "manifest_prior")
def _diff(t, spark, sf):
    return ingest.manifest_diff(t("manifest_prior"), t("disk").where("doc_id % 13 <> 0"), t("disk"))


@query(
    "manifest_lost_chunks",
    "SELECT path, count(*) AS missing FROM manifest_prior p WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = p.chunk_id AND c.doc_id % 5 <> 0) GROUP BY 1",
    "manifest_prior", "chunks"
)
def _lost(t, spark, sf):
    return ingest.lost_chunks(t("manifest_prior"), t("chunks").where("doc_id % 5 <> 0"))


@query("manifest_orphans", "SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM manifest_prior)", "manifest_prior", "chunks")
def _orphans(t, spark, sf):
    return store.orphan_chunks(t("chunks"), t("manifest_prior"))


@query(
    "ingest_delta",
    "SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN a.chunk_id IS NULL THEN 'new' WHEN b.chunk_id IS NULL THEN 'stale' ELSE 'kept' END AS state FROM (SELECT chunk_id FROM chunks WHERE doc_id % 3 <> 0) AS a FULL OUTER JOIN (SELECT chunk_id FROM chunks WHERE doc_id % 4 <> 0) AS b ON a.chunk_id = b.chunk_id",
    "chunks"
)
def _delta(t, spark, sf):
    return ingest.delta(t("chunks").where("doc_id % 3 <> 0"), t("chunks").where("doc_id % 4 <> 0"))


@query(
    "ingest_sources",
    "SELECT folder AS source_id, count(*) AS chunk_count, max(created_at) AS ingested_at FROM chunks WHERE sensitivity = 'normal' GROUP BY 1",
    "chunks"
)
def _sources(t, spark, sf):
    return store.ingested_sources(t("chunks").where("sensitivity = 'normal'"), "folder", "created_at")


@query(
    "ingest_source_page",
    "SELECT doc_id, chunk_id FROM chunks WHERE folder = 'src3' AND sensitivity = 'normal' ORDER BY doc_id, chunk_id LIMIT 10 OFFSET 5", "chunks"
)
def _page(t, spark, sf):
    return store.source_page(t("chunks").where("sensitivity = 'normal'"), "src3", "folder", "doc_id", 5, 10).select("doc_id", "chunk_id")


@query("ingest_upsert", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM documents")
def _upsert(t, spark, sf):
    old = t("documents").select("doc_id", F.lit("old").alias("state"))
    new = t("documents").where("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("v")).select(
        "doc_id", F.when(F.col("v") == 2, "new").otherwise("mid").alias("state"), "v"
    )
    return ingest.upsert(old, new, ["doc_id"], "v").select("doc_id", "state")


@query(
    "ingest_replace_source",
    "SELECT doc_id, CASE WHEN source = 'src2' THEN 'new' ELSE 'old' END AS state FROM documents WHERE source <> 'src2' OR doc_id % 2 = 0"
)
def _replace(t, spark, sf):
    d = t("documents").select("doc_id", F.col("source").alias("source_id"))
    new = d.where("source_id = 'src2' AND doc_id % 2 = 0").withColumn("state", F.lit("new"))
    return ingest.replace_source(d.withColumn("state", F.lit("old")), new, "src2").select("doc_id", "state")


@query("session_windows", """, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM turns),
    w AS (SELECT k.*, s.v AS wnd FROM k, (SELECT unnest(generate_series(0, 200)) AS v) AS s WHERE s.v * 2 <= k.i AND k.i < s.v * 2 + 4 AND (s.v = 0 OR s.v * 2 + 4 <= k.n))
    SELECT session_id, CAST(wnd AS INT) AS "window", min(idx) AS first_idx, CAST(count(*) AS INT) AS span, string_agg(concat(role, ': ', text), chr(10) ORDER BY i) AS text FROM w GROUP BY 1, 2""", "turns")
def _windows(t, spark, sf):
    return ingest.session_windows(t("turns"))


@query(
    "session_count_records",
    "SELECT session_id, metric, CAST(value AS DOUBLE) AS value, 'count' AS unit FROM (SELECT session_id, 'files_touched' AS metric, count(*) AS value FROM turns GROUP BY 1 UNION ALL SELECT session_id, 'tools_used', count(DISTINCT role) FROM turns GROUP BY 1 UNION ALL SELECT session_id, 'decisions', count(*) FROM turns WHERE role = 'assistant' GROUP BY 1 UNION ALL SELECT session_id, 'open_threads', count(*) FROM turns WHERE role = 'system' GROUP BY 1) AS x",
    "turns"
)
def _counts(t, spark, sf):
    lists = t("turns").groupBy("session_id").agg(
        F.collect_list("idx").alias("files_touched"), F.collect_set("role").alias("tools_used"),
        F.collect_list(F.when(F.col("role") == "assistant", F.col("idx"))).alias("decisions"),
        F.collect_list(F.when(F.col("role") == "system", F.col("idx"))).alias("open_threads")
    )
    return ingest.count_records(lists)


@query(
    "session_merge",
    ", a AS (SELECT session_id, idx AS pos, CASE WHEN idx % 2 = 0 THEN upper(role) ELSE role END AS text, CASE WHEN idx < 2 THEN 0 ELSE 1 END AS gen FROM turns) SELECT session_id, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY session_id, lower(trim(text)) ORDER BY gen, pos) AS n FROM a) AS x WHERE n = 1",
    "turns"
)
def _merge(t, spark, sf):
    a = t("turns").select(
        "session_id", F.col("idx").alias("pos"), F.when(F.col("idx") % 2 == 0, F.upper("role")).otherwise(F.col("role")).alias("text")
    )
    return ingest.merge_first(a.where("pos < 2"), a.where("pos >= 2"), "session_id", "text").select("session_id", "pos", "text")


@query(
    "session_resume_offset",
    ", x AS (SELECT session_id, idx, (session_id + idx) % 5 <> 4 AS terminal FROM turns), f AS (SELECT session_id, min(CASE WHEN NOT terminal THEN idx END) AS flight FROM x GROUP BY 1) SELECT f.session_id, coalesce((SELECT max(idx) FROM x WHERE x.session_id = f.session_id AND terminal AND (flight IS NULL OR idx < flight)), -1) AS \"offset\" FROM f",
    "turns"
)
def _offset(t, spark, sf):
    return ingest.resume_offset(t("turns").select("session_id", "idx", ((F.col("session_id") + F.col("idx")) % 5 != 4).alias("terminal")))


@query("triplet_parse", """
    WITH r AS (SELECT p_partkey AS id, 0 AS pos, p_name AS subject, 'made_by' AS predicate, p_brand AS object FROM part UNION ALL SELECT p_partkey, 1, p_brand, 'of type', p_type FROM part)
    SELECT id, CAST(pos AS INT) AS pos, subject, predicate, object FROM r""")
def _parse(t, spark, sf):
    text = F.concat_ws(
        "\n", F.concat_ws(" | ", "p_name", F.lit("File"), F.lit("made_by"), "p_brand", F.lit("Org")),
        F.concat_ws("|", "p_brand", F.lit("of type"), "p_type"), F.lit("no triplet here"), F.lit("a | b | c | d")
    )
    return ingest.parse_triplets(t("part").select(F.col("p_partkey").alias("id"), text.alias("response")))


@query(
    "embed_cache_misses",
    "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)"
)
def _misses(t, spark, sf):
    d = t("documents").select("doc_id", "text")
    cache = d.where("doc_id % 3 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return ingest.cache_misses(d, cache).select("doc_id", "content_hash")


@query("doc_token_histogram", f"SELECT language, CAST(floor({_TOKENS} / 100) AS BIGINT) AS bin, count(*) AS n FROM chunks GROUP BY 1, 2", "chunks")
def _histogram(t, spark, sf):
    return t("chunks").groupBy("language", F.floor(token_estimate(F.col("text")) / 100).alias("bin")).agg(F.count("*").alias("n"))
