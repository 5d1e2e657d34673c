"""Usage counters, query-log analytics, queues, budgets and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.operators.ordered import at_ranks

KEYS = ("channel", "provider", "model", "source")
COUNTERS = ("calls", "tokens_in", "tokens_out", "errors")


def nearest_rank(p: float, n: int) -> int:
    """Rank from 0 of a percentile: p * (n - 1), halves to even."""
    return round(p * (n - 1))


def usage_totals(usage: DataFrame, since: int = 0) -> DataFrame:
    return usage.where(F.col("bucket") >= since).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def usage_series(usage: DataFrame, size: int = 60, since: int = 0, by=("channel",)) -> DataFrame:
    """Counters by bucket of ``size`` minutes and ``by``; error_calls counts the calls of rows with errors."""
    start = (F.floor(F.col("bucket") / size) * size).cast("long").alias("start")
    return usage.where(F.col("bucket") >= since).groupBy(start, *by).agg(
        F.sum("calls").alias("calls"), F.sum("tokens_in").alias("tokens_in"),
        F.sum(F.when(F.col("errors") > 0, F.col("calls")).otherwise(0)).alias("error_calls")
    )


def accumulate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counters of a bucket add up."""
    return old.unionByName(new).groupBy("bucket", *KEYS).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def latest(samples: DataFrame, key: str, time: str) -> DataFrame:
    """Rows at each key's latest time, ties included."""
    most = samples.groupBy(key).agg(F.max(time).alias(time))
    return samples.join(most, [key, time], "left_semi")


def retained_days(usage: DataFrame, days: int) -> DataFrame:
    """(day): the most recent ``days`` days with data. The distinct days are few, so one window ranks them."""
    seen = usage.select(F.floor(F.col("bucket") / 1440).cast("long").alias("day")).distinct()
    return seen.orderBy(F.desc("day")).limit(days)


def prune(usage: DataFrame, days: int) -> DataFrame:
    oldest = retained_days(usage, days).agg(F.min("day").alias("oldest"))
    return usage.crossJoin(F.broadcast(oldest)).where(F.floor(F.col("bucket") / 1440) >= F.col("oldest")).drop("oldest")


def recent(
    log: DataFrame, since: float | None = None, mode: str | None = None, contains: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    if since is not None:
        log = log.where(F.col("ts") >= since)
    if mode:
        log = log.where(F.col("mode") == mode)
    if contains:
        log = log.where(F.contains(F.lower("query"), F.lit(contains.lower())))
    return log.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def mode_distribution(log: DataFrame) -> DataFrame:
    return log.groupBy("mode").agg(F.count("*").alias("n"))


def latency(log: DataFrame, by: str | None = None) -> DataFrame:
    """n, p50, p95 and mean, exact, in all or by a column. Ranks come from counts of the different values, not from one array of all."""
    marks = {"p50": 0.5, "p95": 0.95}
    if by is None:
        n, mean = log.agg(F.count("*"), F.avg("latency_ms")).first()
        found = at_ranks(log, "latency_ms", {k: nearest_rank(p, n) for k, p in marks.items()}) if n else dict.fromkeys(marks)
        return log.sparkSession.createDataFrame([(n, mean, found["p50"], found["p95"])], "n long, avg double, p50 double, p95 double")
    values = log.groupBy(by, "latency_ms").agg(F.count("*").alias("m"), F.sum("latency_ms").alias("s"))
    group = W.Window.partitionBy(by)
    upto = F.sum("m").over(group.orderBy("latency_ms").rowsBetween(W.Window.unboundedPreceding, 0))
    ranked = values.withColumns({"upto": upto, "n": F.sum("m").over(group)})
    picks = [F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("n") - 1), 0), F.col("latency_ms"))).alias(a) for a, p in marks.items()]
    return ranked.groupBy(by).agg(F.first("n").alias("n"), (F.sum("s") / F.sum("m")).alias("avg"), *picks)


def top_queries(log: DataFrame, n: int = 10, zero_only: bool = False) -> DataFrame:
    rows = log.where("result_count = 0") if zero_only else log
    out = rows.groupBy("query").agg(
        F.count("*").alias("n"), F.avg("latency_ms").alias("avg_latency_ms"), F.count_if(F.col("result_count") == 0).alias("zero_results"),
        F.max("ts").alias("last_ts"), F.max_by("id", F.struct("ts", "id")).alias("last_id")
    )
    return out.orderBy(F.desc("n"), F.desc("last_ts"), "query").limit(n)


def pending(queue: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose content was not seen: the newest content of a chunk counts. queue: (chunk_id, content_hash, created_at); seen: (chunk_id, content_hash)."""
    newest = queue.groupBy("chunk_id").agg(F.max_by("content_hash", "created_at").alias("content_hash"), F.max("created_at").alias("created_at"))
    return newest.join(seen.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


def round_robin(items: DataFrame, source: str, order: str, most: int) -> DataFrame:
    """``most`` items, one of each source in turn. Only the first ``most`` of a source can be drawn, so a hot source is cut before the shuffle."""
    rows = items.withColumn("turn", F.row_number().over(W.Window.partitionBy(source).orderBy(order))).where(F.col("turn") <= most)
    return rows.orderBy("turn", source).limit(most)


def drain(items: DataFrame, source: str, order: str, most: int, budget: float, cost: str = "cost") -> DataFrame:
    """The same draw under a spend cap: items that cost something are drawn while they fit the budget, free ones always.

    An item that does not fit ends the billable part, so that the order of a source is kept. Adds spent, the running sum.
    """
    drawn = round_robin(items, source, order, most).withColumn("__cost", F.coalesce(cost, F.lit(0.0)))
    upto = F.sum("__cost").over(W.Window.orderBy("turn", source).rowsBetween(W.Window.unboundedPreceding, 0))  # of ``most`` items
    return drawn.withColumn("spent", upto).where((F.col("spent") <= budget) | (F.col("__cost") == 0)).drop("__cost")


def retained(rows: DataFrame, column: str, days: int, today: str) -> DataFrame:
    """Rows whose day (text, YYYY-MM-DD at its start) is not older than so many days; rows without one go. 0 days keeps all."""
    if days <= 0:
        return rows
    return rows.where(F.substring(column, 1, 10) >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"))


def trailing_hour(calls: DataFrame, key: str, ts: str, budget: int, seconds: int = 3600) -> DataFrame:
    """Adds in_hour, the calls of the key in the hour up to and with this one, and allowed, whether they fit the budget."""
    w = W.Window.partitionBy(key).orderBy(ts).rangeBetween(-seconds, 0)
    return calls.withColumn("in_hour", F.count("*").over(w)).withColumn("allowed", F.col("in_hour") <= budget)


def retrieval_quality(retrieved: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(mode, cases, recall, mrr). retrieved: (case_id, mode, rank, item); expected: (case_id, mode, item)."""
    hits = expected.join(retrieved.where(F.col("rank") <= k), ["case_id", "mode", "item"], "left")
    case = hits.groupBy("mode", "case_id").agg(
        (F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr")
    )
    return case.groupBy("mode").agg(F.count("*").alias("cases"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))


def bench_stats(rows: DataFrame) -> DataFrame:
    """p50, p95, p99 by int(p / 100 * n), mean and rate of latencies in ms."""
    n, mean = rows.agg(F.count("*"), F.avg("latency_ms")).first()
    ranks = {f"p{p}": min(p * n // 100, n - 1) for p in (50, 95, 99)}
    found = at_ranks(rows, "latency_ms", ranks) if n else dict.fromkeys(ranks)
    kept = (found["p50"], found["p95"], found["p99"], mean, 1000.0 / mean if mean else None)
    return rows.sparkSession.createDataFrame([kept], "p50 double, p95 double, p99 double, mean double, qps double")


def should_pause(pending_count: int, most: int, resumed: bool) -> bool:
    """Backpressure with hysteresis: pause at ``most``; once paused, stay so above four fifths."""
    return pending_count >= most if resumed else pending_count > 0.8 * most


def cache_evict(cache: DataFrame, count: int) -> DataFrame:
    """The tenth of the entries (one at least) that were used longest ago."""
    return cache.orderBy("last_accessed", "key").limit(max(1, count // 10))


def log_rows(queries: DataFrame, most_results: int, snippet: int = 500) -> DataFrame:
    """Query-log rows of (id, ts, mode, query, results array<struct<chunk_id, score, text>>): results cut to so many, texts to a snippet."""
    kept = F.transform(
        F.slice("results", 1, most_results),
        lambda r: F.struct(r["chunk_id"].alias("chunk_id"), r["score"].alias("score"), F.substring(r["text"], 1, snippet).alias("text"))
    )
    return queries.withColumn("result_count", F.size("results")).withColumn("results", kept)


def visible_jobs(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Jobs, newest first, without finished ones that changed nothing; hidden before the page is cut."""
    noop = F.coalesce((F.col("status") == "done") & (F.col("changed") == 0), F.lit(False))
    return jobs.where(~noop).orderBy(F.desc("created"), F.desc("id")).offset(offset).limit(limit)


def queue_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def cache_economics(cache: DataFrame, prices: DataFrame, avg_tokens: float) -> DataFrame:
    """Cost of misses and savings of hits by model: cache (model, hits, misses), prices (model, per million tokens); unknown models cost 0."""
    out = cache.groupBy("model").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses")).join(prices, "model", "left")
    rate = F.coalesce("price", F.lit(0.0)) * avg_tokens / 1e6
    return out.select(
        "model", "hits", "misses", (F.col("hits") * rate).alias("saved"), (F.col("misses") * rate).alias("spent"),
        (F.col("hits") / (F.col("hits") + F.col("misses"))).alias("hit_rate")
    )
