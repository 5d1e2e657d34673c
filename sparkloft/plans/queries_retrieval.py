"""Vector and keyword search, fusion, re-scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloft.operators import retrieval as r
from sparkloft.operators.vector_index import VectorIndex
from sparkloft.plans.catalog import query, rounded
from sparkloft.storage import folder
from sparkloft.views import fulltext_index, keyword_index, vector_index

AS_OF = "2025-06-01 00:00:00"
TERMS = ("the", "and", "of")
_QV = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_V = "CAST(embedding AS DOUBLE[])"
_COS = f"greatest(0.0, least(1.0, list_cosine_similarity({_V}, {_QV})))"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _query_vector(t) -> list[float]:
    """The embedding of row 0 stands for the embedded question."""
    row = t("embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


def _vec(k: int, threshold: float = 0.0, score: str = _COS, where: str = "") -> str:
    return f"SELECT chunk_id, score FROM (SELECT chunk_id, {score} AS score FROM vectors {where} ORDER BY 2 DESC, 1 LIMIT {k}) AS v WHERE score >= {threshold}"


def _bm25(k: int) -> str:
    words = f"w AS (SELECT *, {_TOK} AS toks FROM chunks), st AS (SELECT count(*) AS n, avg(len(toks)) AS mean"
    words += "".join(f", count(*) FILTER (WHERE list_contains(toks, '{t}')) AS df{i}" for i, t in enumerate(TERMS)) + " FROM w)"
    parts = " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * len(list_filter(toks, lambda x: x = '{t}')) / (len(list_filter(toks, lambda x: x = '{t}')) + 1.5 * (0.25 + 0.75 * len(toks) / mean))" for i,
        t in enumerate(TERMS)
    )
    return f"{words}, sc AS (SELECT w.*, {parts} AS raw FROM w, st), bm AS (SELECT *, raw / max(raw) OVER () AS score FROM (SELECT * FROM sc WHERE raw > 0 ORDER BY raw DESC, chunk_id LIMIT {k}) AS b)"


@query("vector_topk", f"SELECT chunk_id, round(score, 6) AS score FROM ({_vec(20, 0.05)}) AS x", "vectors")
def _topk(t, spark, sf):
    return rounded(r.vector_search(t("vectors"), _query_vector(t), 20, 0.05).select("chunk_id", "score"), "score")


@query(
    "vector_filtered",
    f"SELECT chunk_id, round(score, 6) AS score FROM ({_vec(20, 0.05, where="WHERE source_type = 'doc' AND language IN ('en', 'de')")}) AS x",
    "vectors"
)
def _filtered(t, spark, sf):
    where = (F.col("source_type") == "doc") & F.col("language").isin("en", "de")
    return rounded(r.vector_search(t("vectors"), _query_vector(t), 20, 0.05, where=where).select("chunk_id", "score"), "score")


@query("vector_l2", f"SELECT chunk_id, round(score, 6) AS score FROM ({_vec(20, score=f'1.0 / (1.0 + list_distance({_V}, {_QV}))')}) AS x", "vectors")
def _l2(t, spark, sf):
    return rounded(r.vector_search(t("vectors"), _query_vector(t), 20, metric="l2").select("chunk_id", "score"), "score")


@query(
    "vector_ip", f"SELECT chunk_id, round(score, 6) AS score FROM ({_vec(20, score=f'greatest(0.0, list_dot_product({_V}, {_QV}))')}) AS x", "vectors"
)
def _ip(t, spark, sf):
    return rounded(r.vector_search(t("vectors"), _query_vector(t), 20, metric="inner_product").select("chunk_id", "score"), "score")


@query("vector_indexed_topk", f"SELECT chunk_id, round(score, 6) AS score FROM ({_vec(20, 0.05)}) AS x", "vectors")
def _indexed(t, spark, sf):
    return rounded(vector_index(spark, sf).search(_query_vector(t), 20, 0.05).select("chunk_id", "score"), "score")


@query("vector_indexed_near", f"SELECT chunk_id, round(score, 6) AS score FROM ({_vec(50, 0.6)}) AS x", "vectors")
def _indexed_near(t, spark, sf):
    """A threshold above the k-th score: it rules out lists by itself."""
    return rounded(vector_index(spark, sf).search(_query_vector(t), 50, 0.6).select("chunk_id", "score"), "score")


@query(
    "vector_indexed_filtered",
    f"SELECT chunk_id, round(score, 6) AS score FROM ({_vec(20, 0.05, where="WHERE source_type = 'doc' AND language IN ('en', 'de')")}) AS x",
    "vectors"
)
def _indexed_filtered(t, spark, sf):
    where = (F.col("source_type") == "doc") & F.col("language").isin("en", "de")
    return rounded(vector_index(spark, sf).search(_query_vector(t), 20, 0.05, where=where).select("chunk_id", "score"), "score")


@query(
    "vector_indexed_l2",
    f"SELECT chunk_id, round(score, 6) AS score FROM ({_vec(20, score=f'1.0 / (1.0 + list_distance({_V}, {_QV}))')}) AS x", "vectors"
)
def _indexed_l2(t, spark, sf):
    return rounded(vector_index(spark, sf).search(_query_vector(t), 20, metric="l2").select("chunk_id", "score"), "score")


@query(
    "vector_indexed_ip",
    f"SELECT chunk_id, round(score, 6) AS score FROM ({_vec(20, score=f'greatest(0.0, list_dot_product({_V}, {_QV}))')}) AS x", "vectors"
)
def _indexed_ip(t, spark, sf):
    return rounded(vector_index(spark, sf).search(_query_vector(t), 20, metric="inner_product").select("chunk_id", "score"), "score")


@query(
    "vector_index_changed",
    f"SELECT chunk_id, round(score, 6) AS score FROM ({_vec(20, where='WHERE vec_id % 5 <> 2')}) AS x", "vectors"
)
def _changed(t, spark, sf):
    """An index that got its rows in two segments, some of them wrong at first, and lost others."""
    rows = t("vectors")
    index = VectorIndex(spark, folder(spark, "vectors")).build(rows.where("vec_id % 2 = 0").withColumn("embedding", F.reverse("embedding")))
    index.add(rows)
    index.remove(rows.where("vec_id % 5 = 2").select("chunk_id"))
    return rounded(index.search(_query_vector(t), 20).select("chunk_id", "score"), "score")


@query("bm25_topk", f", {_bm25(30)} SELECT chunk_id, round(score, 6) AS score FROM bm ORDER BY score DESC, chunk_id LIMIT 10", "chunks")
def _bm25_topk(t, spark, sf):
    return rounded(keyword_index(spark, sf).search(TERMS, 10), "score")


@query(
    "bm25_filtered",
    f", {_bm25(90)} SELECT chunk_id, round(score, 6) AS score FROM bm WHERE source_type = 'doc' AND regexp_matches(source, '^docs/src1.*\\.md$') ORDER BY bm.score DESC, chunk_id LIMIT 30",
    "chunks"
)
def _bm25_filtered(t, spark, sf):
    where = (F.col("source_type") == "doc") & F.col("source").rlike(r.glob_to_regex("docs/src1*.md"))
    return rounded(keyword_index(spark, sf).search(TERMS, 30, t("chunks"), where), "score")


@query("bm25_scan_topk", f", {_bm25(30)} SELECT chunk_id, round(score, 6) AS score FROM bm ORDER BY score DESC, chunk_id LIMIT 10", "chunks")
def _scan_topk(t, spark, sf):
    """The same without an index: one pass over the texts."""
    return rounded(r.keyword_search(t("chunks"), TERMS, 10), "score")


@query(
    "bm25_index",
    f", w AS (SELECT chunk_id, {_TOK} AS toks FROM chunks), p AS (SELECT chunk_id, unnest(toks) AS term, len(toks) AS dl FROM w) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(dl) AS INT) AS longest FROM (SELECT term, chunk_id, count(*) AS tf, min(dl) AS dl FROM p GROUP BY 1, 2) AS x GROUP BY term",
    "chunks"
)
def _index(t, spark, sf):
    return r.postings(t("chunks")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("dl").alias("longest"))


def _both(t, spark, sf):
    return r.vector_search(t("vectors"), _query_vector(t), 30), keyword_index(spark, sf).search(TERMS, 30)


_LISTS = f", {_bm25(90)}, v AS ({_vec(30)}), b AS (SELECT chunk_id, score FROM bm ORDER BY score DESC, chunk_id LIMIT 30)"


@query(
    "hybrid_fusion",
    _LISTS + ", f AS (SELECT coalesce(v.chunk_id, b.chunk_id) AS chunk_id, coalesce(v.score / (SELECT max(score) FROM v), 0.0) AS vector_score, coalesce(b.score / (SELECT max(score) FROM b), 0.0) AS bm25_score FROM v FULL OUTER JOIN b ON v.chunk_id = b.chunk_id) SELECT chunk_id, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score, round(0.5 * vector_score + 0.5 * bm25_score, 6) AS score FROM f ORDER BY 0.5 * vector_score + 0.5 * bm25_score DESC, chunk_id LIMIT 15",
    "chunks", "vectors"
)
def _hybrid(t, spark, sf):
    return rounded(r.top(r.hybrid(*_both(t, spark, sf)), 15), "vector_score", "bm25_score", "score")


_RANKED = ", rv AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS k FROM v), rb AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS k FROM b)"


@query(
    "multi_rrf",
    _LISTS + _RANKED + " SELECT chunk_id, round(sum(1.0 / (61 + k)), 6) AS score FROM (SELECT * FROM rv UNION ALL SELECT * FROM rb) AS u GROUP BY 1",
    "chunks", "vectors"
)
def _rrf(t, spark, sf):
    return rounded(r.rrf(*_both(t, spark, sf)), "score")


@query(
    "hybrid_rrf_weighted",
    _LISTS + _RANKED + ", u AS (SELECT chunk_id, sum(p) AS s FROM (SELECT chunk_id, 0.7 / (60 + k) AS p FROM rv UNION ALL SELECT chunk_id, 0.3 / (60 + k) FROM rb) AS x GROUP BY 1) SELECT chunk_id, round(s / (SELECT max(s) FROM u), 6) AS score FROM u",
    "chunks", "vectors"
)
def _weighted(t, spark, sf):
    return rounded(r.weighted_rrf([0.7, 0.3], *_both(t, spark, sf)), "score")


@query(
    "retrieve_filtered",
    "SELECT chunk_id, source_type, language FROM chunks WHERE source_type IN ('doc', 'code') AND language IN ('en', 'fr') AND regexp_matches(source, '^docs/src1.*$') AND domain IN ('d0', 'd1') AND authority = 'user' AND sensitivity = 'normal'",
    "chunks"
)
def _retrieve(t, spark, sf):
    where = r.request_filter(("doc", "code"), ("en", "fr"), ("docs/src1*",), ("d0", "d1"), {"authority": "user"})
    return t("chunks").where(where).select("chunk_id", "source_type", "language")


_HITS = f", h AS (SELECT v.*, c.text FROM (SELECT *, {_COS} AS score FROM vectors ORDER BY {_COS} DESC, chunk_id LIMIT 40) AS v JOIN chunks c ON c.chunk_id = v.chunk_id)"


def _hits(t):
    found = r.vector_search(t("vectors"), _query_vector(t), 40)
    return found.join(t("chunks").select("chunk_id", "text"), "chunk_id")


@query(
    "rank_time_decay",
    _HITS + f" SELECT chunk_id, round(score * power(0.5, greatest(0.0, (epoch(TIMESTAMP '{AS_OF}') - epoch(CAST(created_at AS TIMESTAMP))) / 86400.0) / 90.0), 6) AS score FROM h",
    "chunks", "vectors"
)
def _decay(t, spark, sf):
    return rounded(r.time_decay(_hits(t), AS_OF, 90.0).select("chunk_id", "score"), "score")


@query(
    "rank_stale_penalty",
    _HITS + ", gone AS (SELECT DISTINCT trim(split_part(text, chr(10), 1)) AS subject FROM chunks WHERE doc_id % 2 = 0) SELECT chunk_id, round(CASE WHEN g.subject IS NOT NULL AND source_type = 'session_decision' THEN score * 0.5 ELSE score END, 6) AS score FROM h LEFT JOIN gone g ON g.subject = trim(split_part(h.text, chr(10), 1))",
    "chunks", "vectors"
)
def _stale(t, spark, sf):
    gone = t("chunks").where("doc_id % 2 = 0").select(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("subject"))
    return rounded(r.stale_penalty(_hits(t), gone).select("chunk_id", "score"), "score")


@query(
    "rank_source_weights",
    _HITS + " SELECT chunk_id, round(score * CASE WHEN source_type = 'doc' THEN 0.5 ELSE 1.0 END * CASE WHEN authority = 'reference' THEN 0.7 ELSE 1.0 END, 6) AS score FROM h",
    "chunks", "vectors"
)
def _weights(t, spark, sf):
    return rounded(r.source_weights(_hits(t)).select("chunk_id", "score"), "score")


@query(
    "rank_rerank",
    _HITS + f", o AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS original_rank, len(list_filter({_TOK}, lambda x: x = 'the')) / (1.0 + len({_TOK})) AS s FROM h) SELECT chunk_id, CAST(original_rank AS INT) AS original_rank, round(s, 6) AS rerank_score FROM o ORDER BY s DESC, original_rank LIMIT 10",
    "chunks", "vectors"
)
def _rerank(t, spark, sf):
    from sparkloft.functions.text import tokens

    words = tokens(F.col("text"))
    scorer = F.size(F.filter(words, lambda w: w == "the")) / (1.0 + F.size(words))
    return rounded(r.rerank(_hits(t), scorer, 10).select("chunk_id", "original_rank", "rerank_score"), "rerank_score")


@query(
    "memory_boost",
    f", res AS ({
        _vec(10, where='WHERE vec_id % 2 = 0')
    }), mem AS ({_vec(5, where='WHERE vec_id % 3 = 0')}) SELECT chunk_id, round(score, 6) AS score, kind FROM (SELECT chunk_id, score, 'chunk' AS kind FROM res UNION ALL SELECT chunk_id, score * 1.5, 'memory' FROM mem WHERE score >= 0.2 AND chunk_id NOT IN (SELECT chunk_id FROM res)) AS x ORDER BY x.score DESC, chunk_id LIMIT 10",
    "vectors"
)
def _boost(t, spark, sf):
    q = _query_vector(t)
    res = r.vector_search(t("vectors"), q, 10, where=F.col("vec_id") % 2 == 0)
    mem = r.vector_search(t("vectors"), q, 5, where=F.col("vec_id") % 3 == 0)
    return rounded(r.boost(res, mem, 10, floor=0.2), "score")


@query(
    "reference_search",
    f"SELECT chunk_id, round(score, 6) AS score FROM ({
        _vec(10, where="WHERE authority = 'reference' AND domain = 'd0' AND sensitivity = 'normal'")
    }) AS x",
    "vectors"
)
def _reference(t, spark, sf):
    where = (F.col("authority") == "reference") & (F.col("domain") == "d0") & (F.col("sensitivity") == "normal")
    return rounded(r.vector_search(t("vectors"), _query_vector(t), 10, where=where).select("chunk_id", "score"), "score")


_FIELDS = {"folder": 1.0, "text": 0.2}


def _fulltext_sql(fits: str, words: tuple[str, ...], k: int) -> str:
    """Chunks that fit, by the weighted counts of the words; a and b are the words of both fields."""
    count = "len(list_filter({}, lambda x: x = '{}'))"
    parts = " + ".join(f"{w} * {count.format(f, v)} / ({count.format(f, v)} + 1.0)" for f, w in zip("ab", _FIELDS.values(), strict=True) for v in words) or "0.0"
    return (
        f", w AS (SELECT chunk_id, {_TOK.replace('text', 'folder')} AS a, {_TOK} AS b FROM chunks), s AS (SELECT chunk_id, {parts} AS raw FROM w WHERE {fits} ORDER BY 2 DESC, 1 LIMIT {k}), "
        "m AS (SELECT max(raw) AS most FROM s) SELECT chunk_id, round(CASE WHEN most > 0 THEN raw / most ELSE raw END, 6) AS score FROM s, m"
    )


def _phrase_sql(*words: str) -> str:
    each = lambda f: " AND ".join(f"{f}[i + {j}] = '{w}'" for j, w in enumerate(words))
    return "(" + " OR ".join(f"len(list_filter(range(1, len({f}) + 1), lambda i: {each(f)})) > 0" for f in "ab") + ")"


def _holds_sql(word: str) -> str:
    return f"(list_contains(a, '{word}') OR list_contains(b, '{word}'))"


@query("fulltext_phrase", _fulltext_sql(_phrase_sql("of", "the"), ("of", "the"), 40), "chunks")
def _phrase(t, spark, sf):
    return rounded(fulltext_index(spark, sf, _FIELDS).search('"of the"', 40), "score")


@query(
    "fulltext_boolean",
    _fulltext_sql(f"({_holds_sql('the')} AND {_holds_sql('and')} AND NOT {_phrase_sql('of', 'the')}) OR ({_holds_sql('der')} AND NOT {_holds_sql('und')})", ("the", "and", "der"), 40),
    "chunks"
)
def _boolean(t, spark, sf):
    return rounded(fulltext_index(spark, sf, _FIELDS).search('the and -"of the" OR der -und', 40), "score")


@query("fulltext_exclusion", _fulltext_sql(f"NOT {_holds_sql('the')} AND NOT {_holds_sql('de')}", (), 30), "chunks")
def _exclusion(t, spark, sf):
    return rounded(fulltext_index(spark, sf, _FIELDS).search("-the -de", 30), "score")
