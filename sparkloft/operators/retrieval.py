"""Vector and keyword retrieval, fusion and re-scoring. Hits are (chunk_id, score, ...) with larger scores first, ties by chunk_id."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.functions.text import age_decay, glob_to_regex, tokens
from sparkloft.functions.vector import literal, score
from sparkloft.operators import inverted
from sparkloft.storage import written

K1, B = 1.5, 0.75
RRF_K = 60


def top(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "chunk_id").limit(k)


def vector_search(
    vectors: DataFrame, query: list[float], k: int, threshold: float = 0.0, metric: str = "cosine", where: Column | None = None
) -> DataFrame:
    """The k nearest, then those of ``threshold`` or more: in that order, as a filter before the cut would find others."""
    rows = vectors if where is None else vectors.where(where)
    hits = rows.withColumn("score", score(F.col("embedding"), literal(query), metric)).drop("embedding")
    return top(hits, k).where(F.col("score") >= threshold)


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl): the keyword index, to be written bucketed by term. Texts are dealt out by id, not their words."""
    rows = chunks.select("chunk_id", "text").repartition("chunk_id").sortWithinPartitions("chunk_id")
    words = rows.select("chunk_id", tokens(F.col("text")).alias("w"))
    return inverted.counts(words.select("chunk_id", F.size("w").alias("dl"), "w"))


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda w: w == term


def _counted(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(chunk_id, dl, tf0, tf1, ...) of all chunks: length and count of each term. The text is made words once: they have several readers."""
    words = chunks.select("chunk_id", tokens(F.col("text")).alias("w"))
    tf = [(F.size("w") - F.size(F.array_remove("w", t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    return words.select("chunk_id", F.size("w").alias("dl"), *tf)


def bm25_scores(chunks: DataFrame, terms: Iterable[str]) -> DataFrame:
    """(chunk_id, score): BM25 of the chunks that hold any of the terms.

    Texts are read once: their counts, a few numbers a chunk, are written, and both the statistics and the scores come from those.
    """
    terms = list(dict.fromkeys(terms))
    names = [f"tf{i}" for i in range(len(terms))]
    none = chunks.sparkSession.createDataFrame([], "chunk_id string, score double")
    if not terms:
        return none
    counted = written(_counted(chunks, terms), "term-counts")
    n, mean, *df = counted.agg(F.count("*"), F.avg("dl"), *[F.count_if(F.col(x) > 0) for x in names]).first()
    parts = []
    if n and mean:
        norm = K1 * (1 - B + B * F.col("dl") / F.lit(float(mean)))
        parts = [F.lit(float(idf(n, d))) * F.col(x) / (F.col(x) + norm) for x, d in zip(names, df, strict=True) if d]
    return counted.select("chunk_id", sum(parts[1:], parts[0]).alias("score")).where(F.col("score") > 0) if parts else none


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_from_postings(index: DataFrame, n: int, mean: float, terms: Iterable[str]) -> DataFrame:
    """The same scores from a written index: only the terms' postings are read."""
    hits = index.where(F.col("term").isin(*terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term")  # one row a query term
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return scored.groupBy("chunk_id").agg(
        F.sum(idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean))))).alias("score")
    )


def normalised(hits: DataFrame) -> DataFrame:
    """Scores over the list's largest. The list is short (a top k), so one window holds it, and it is worked out once only."""
    most = F.max("score").over(W.Window.partitionBy(F.lit(0)))
    return hits.withColumn("__most", most).withColumn(
        "score", F.when(F.col("__most") > 0, F.col("score") / F.col("__most")).otherwise(F.col("score"))
    ).drop("__most")


def keyword_search(chunks: DataFrame, terms: Iterable[str], k: int, where: Column | None = None, exact: bool = False) -> DataFrame:
    """(chunk_id, score): BM25 top k over the largest score. The filter comes after the cut to 3 k and the division, or before both if ``exact``."""
    if exact:
        return normalised(top(bm25_scores(chunks if where is None else chunks.where(where), terms), k))
    hits = normalised(top(bm25_scores(chunks, terms), 3 * k))
    if where is not None:
        hits = chunks.where(where).join(F.broadcast(hits), "chunk_id").select("chunk_id", "score")  # at most 3 k rows
    return top(hits, k)


def request_filter(source_types=(), languages=(), globs=(), domains=(), metadata=None, include_sensitive=False, hidden=()) -> Column:
    """Conjunction of a request's filters: a missing language fails, a missing source type is doc, a missing sensitivity is normal."""
    c = F.lit(True)
    kind = F.coalesce("source_type", F.lit("doc"))
    if source_types:
        c &= kind.isin(*source_types)
    if hidden:
        c &= ~kind.isin(*hidden)
    if languages:
        c &= F.coalesce(F.col("language").isin(*languages), F.lit(False))
    if globs:
        c &= F.coalesce(F.col("source").rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs)), F.lit(False))
    if domains:
        c &= F.coalesce(F.col("domain").isin(*domains), F.lit(False))
    for k, v in (metadata or {}).items():
        c &= F.coalesce(F.col(k).cast("string") == str(v), F.lit(False))
    if not include_sensitive:
        c &= F.coalesce("sensitivity", F.lit("normal")) == "normal"
    return c


def contains_metadata(column: str, wanted: dict[str, str]) -> Column:
    """Whether a map column holds all the wanted pairs; a null map holds none."""
    c = F.lit(True)
    for k, v in wanted.items():
        c &= F.coalesce(F.try_element_at(F.col(column), F.lit(k)) == str(v), F.lit(False))
    return c


def weighted_terms(chunks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(chunk_id, term, weight): the written form of a search over weighted fields: each term's sum of weight * tf / (tf + 1) over fields."""
    fields = [F.struct(F.lit(float(w)).alias("weight"), tokens(F.col(f)).alias("words")) for f, w in weights.items()]
    rows = chunks.select("chunk_id", F.posexplode(F.array(*fields)).alias("field", "x"))
    counts = rows.select("chunk_id", "field", "x.weight", F.explode("x.words").alias("term")).groupBy("chunk_id", "term", "field").agg(
        F.count("*").alias("tf"), F.first("weight").alias("weight")
    )
    return counts.groupBy("chunk_id", "term").agg(F.sum(F.col("weight") * F.col("tf") / (F.col("tf") + 1.0)).alias("weight"))


def weighted_search(index: DataFrame, terms: Iterable[str], k: int) -> DataFrame:
    """(chunk_id, score): chunks that have all the terms, by the sum of their weights over the largest."""
    terms = list(dict.fromkeys(terms))
    hits = index.where(F.col("term").isin(*terms)).groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("weight").alias("score"))
    return normalised(top(hits.where(F.col("n") == len(terms)).drop("n"), k))


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(chunk_id, vector_score, bm25_score, score): alpha * v / max v + (1 - alpha) * b / max b, a missing side is 0."""
    v = normalised(vector_hits.select("chunk_id", "score")).withColumnRenamed("score", "vector_score")
    b = normalised(keyword_hits.select("chunk_id", "score")).withColumnRenamed("score", "bm25_score")
    both = v.join(b, "chunk_id", "full_outer").select(
        "chunk_id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score")
    )
    return both.withColumn("score", alpha * F.col("vector_score") + (1 - alpha) * F.col("bm25_score"))


def ranks(hits: DataFrame) -> DataFrame:
    """(chunk_id, rank from 0) of a top list: short, so one ordered window holds it."""
    return hits.select("chunk_id", (F.row_number().over(W.Window.orderBy(F.desc("score"), "chunk_id")) - 1).alias("rank"))


def rrf(*lists: DataFrame) -> DataFrame:
    """(chunk_id, score): sum over the lists of 1 / (60 + rank + 1)."""
    out = None
    for x in lists:
        r = ranks(x).select("chunk_id", (1.0 / (RRF_K + F.col("rank") + 1)).alias("part"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("chunk_id").agg(F.sum("part").alias("score"))


def weighted_rrf(weights: list[float], *lists: DataFrame) -> DataFrame:
    """(chunk_id, score): sum of weight / (60 + rank), over the largest."""
    out = None
    for w, x in zip(weights, lists, strict=True):
        r = ranks(x).select("chunk_id", (F.lit(float(w)) / (RRF_K + F.col("rank"))).alias("part"))
        out = r if out is None else out.unionByName(r)
    return normalised(out.groupBy("chunk_id").agg(F.sum("part").alias("score")))


def time_decay(hits: DataFrame, as_of: str, half_life_days: float) -> DataFrame:
    return hits.withColumn("score", F.col("score") * age_decay(F.col("created_at"), as_of, half_life_days))


def stale_penalty(hits: DataFrame, superseded: DataFrame, factor: float = 0.5) -> DataFrame:
    """Scores of decisions whose first line names a superseded subject, times ``factor``. superseded: (subject)."""
    gone = superseded.select(F.col("subject").alias("__stale")).distinct()
    line = F.trim(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)))
    joined = hits.join(gone, (line == F.col("__stale")) & (F.col("source_type") == "session_decision"), "left")
    return joined.withColumn("score", F.when(F.col("__stale").isNotNull(), F.col("score") * factor).otherwise(F.col("score"))).drop("__stale")


def source_weights(hits: DataFrame, doc: float = 0.5, reference: float = 0.7) -> DataFrame:
    """Weights by source type and authority; a weight of 0 drops the hit."""
    weight = F.when(
        F.coalesce("source_type", F.lit("doc")) == "doc", doc
    ).otherwise(1.0) * F.when(F.col("authority") == "reference", reference).otherwise(1.0)
    return hits.withColumn("score", F.col("score") * weight).where(weight > 0)


def guarded(scorer: Callable[[str], Column], query: str) -> Column:
    """A scorer's Column, or 0 for all hits where it cannot be made: the first stage's order then stays."""
    try:
        return F.coalesce(scorer(query), F.lit(0.0))
    except Exception:  # a broken scorer must not cost the answer
        return F.lit(0.0)


def rerank(hits: DataFrame, scorer: Column, k: int) -> DataFrame:
    """Second stage over the first one's short list: original_rank from 1, then the scorer decides."""
    first = hits.withColumn("original_rank", F.row_number().over(W.Window.orderBy(F.desc("score"), "chunk_id")))
    return first.withColumn("rerank_score", scorer).orderBy(F.desc("rerank_score"), "original_rank").limit(k)


def boost(results: DataFrame, memories: DataFrame, k: int, floor: float = 0.35, factor: float = 1.5) -> DataFrame:
    """Merges memory hits (chunk_id, score) of at least ``floor``, times ``factor``, into results that lack them; k remain."""
    extra = memories.where(F.col("score") >= floor).join(results.select("chunk_id"), "chunk_id", "left_anti")
    merged = results.select("chunk_id", "score", F.lit("chunk").alias("kind")).unionByName(
        extra.select("chunk_id", (F.col("score") * factor).alias("score"), F.lit("memory").alias("kind"))
    )
    return top(merged, k)


def field_search(chunks: DataFrame, terms: Iterable[str], weights: dict[str, float], k: int) -> DataFrame:
    """Keyword search over weighted fields (title, summary, body): all terms must occur, each counts weight * tf / (tf + 1); over the largest."""
    terms = list(dict.fromkeys(terms))
    fields = {f: tokens(F.col(f)) for f in weights}
    count = lambda f, t: F.size(F.filter(fields[f], _equals(t)))
    found = F.lit(True)
    score = F.lit(0.0)
    for t in terms:
        tf = {f: count(f, t) for f in fields}
        found &= sum(list(tf.values())[1:], list(tf.values())[0]) > 0
        for f, n in tf.items():
            score = score + F.lit(float(weights[f])) * n / (n + 1.0)
    return normalised(top(chunks.where(found).withColumn("score", score), k))


def first_number(text: Column) -> Column:
    """The first number of a scorer's answer, in 0..10; 0 if there is none."""
    n = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)
    return F.least(F.greatest(F.coalesce(F.when(n != "", n.cast("double")), F.lit(0.0)), F.lit(0.0)), F.lit(10.0))


def distinct_hits(hits: DataFrame, order: str = "pos") -> DataFrame:
    """The first hit of each chunk, or of each path where there is no chunk; hits with neither all stay."""
    key = F.coalesce("chunk_id", "path")
    w = W.Window.partitionBy(key).orderBy(order)
    return hits.withColumn("__key", key).withColumn(
        "__n", F.when(F.col("__key").isNull(), 1).otherwise(F.row_number().over(w))
    ).where("__n = 1").drop("__n", "__key")
