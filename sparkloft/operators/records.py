"""Typed measurements: aggregates, absence, confidence, salience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloft.functions.text import age_decay, iso_week, short_id, year_month
from sparkloft.operators.ingest import upsert

OPS = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}
GROUPS = {"week": "iso_week", "month": "ym", "source": "source", "subject": "subject", "unit": "unit"}
PARTITIONS = ("metric", "source", "domain")
KEYS = ("subject", "source_id")
HIGH, PROVISIONAL, UNVERIFIED = 1.0, 0.6, 0.3
COUNT_METRICS = ("files_touched", "tools_used", "decisions", "open_threads")
CURRENCY = r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)"


def visible(include_sensitive: bool = False) -> Column:
    return F.lit(True) if include_sensitive else F.coalesce("sensitivity", F.lit("normal")) == "normal"


def matching(
    metric: str | None = None, *, domain=None, subject=None, since=None, until=None, until_inclusive=True, min_confidence=0.7, exclude_sources=(),
    include_sensitive=False
) -> Column:
    """The record predicate; times compare as text, and a null source is never excluded."""
    c = (F.col("confidence") >= min_confidence) & visible(include_sensitive)
    if metric is not None:
        c &= F.col("metric") == metric
    if domain is not None:
        c &= F.col("domain") == domain
    if subject is not None:
        c &= F.col("subject") == subject
    if since is not None:
        c &= F.col("ts") >= since
    if until is not None:
        c &= (F.col("ts") <= until) if until_inclusive else (F.col("ts") < until)
    if exclude_sources:
        c &= F.col("source").isNull() | ~F.col("source").isin(*exclude_sources)
    return c


def aggregate(
    records: DataFrame, metric: str, op: str, group_by: str | None = None, order: str = "desc", limit: int | None = None, **where
) -> DataFrame:
    """(label, value, score): one aggregate of a metric, or one for each group, largest first (or smallest), ties by label.

    Without groups there is always one row, 0.0 over no records. A week or month group needs a time. score: |value| / max |value|.
    """
    if op != "count" and op not in OPS or group_by not in (None, *GROUPS) or order not in ("asc", "desc"):
        raise ValueError(f"unsupported {op!r}, {group_by!r} or {order!r}")
    value = (F.count("*") if op == "count" else OPS[op]("value")).cast("double")
    rows = records.where(matching(metric, **where))
    if group_by is None:
        out = rows.agg(F.coalesce(value, F.lit(0.0)).alias("value")).select(F.lit(None).cast("string").alias("label"), "value")
        return out.withColumn("score", F.when(F.col("value") != 0, 1.0).otherwise(0.0))
    g = GROUPS[group_by]
    if group_by in ("week", "month"):
        rows = rows.where(F.col(g).isNotNull())
    out = rows.groupBy(F.col(g).alias("label")).agg(F.coalesce(value, F.lit(0.0)).alias("value"))
    by = [F.col("value").desc() if order == "desc" else F.col("value").asc(), F.col("label").asc()]
    if limit is not None:
        out = out.orderBy(*by).limit(limit)
    top = out.agg(F.max(F.abs("value")).alias("top"))
    out = out.crossJoin(F.broadcast(top))  # one row
    return out.select("label", "value", F.when(F.col("top") > 0, F.abs("value") / F.col("top")).otherwise(0.0).alias("score")).orderBy(*by)


def absent(
    records: DataFrame, partition: str, present_in: str, absent_from: str, key: str = "subject", metric: str | None = None, limit: int | None = None,
    **where
) -> DataFrame:
    """(label): keys found under one value of a column and not under another; both sides see only visible, confident records.

    Follows NOT IN: a null key on the absent side leaves nothing.
    """
    if partition not in PARTITIONS or key not in KEYS:
        raise ValueError(f"unsupported {partition!r} or {key!r}")
    seen = records.where(matching(metric, until_inclusive=False, **where))
    left = seen.where(F.col(partition) == present_in).select(F.col(key).alias("label")).where("label is not null").distinct()
    right = seen.where(F.col(partition) == absent_from).select(F.col(key).alias("other")).distinct()
    if key == "subject":  # never null in records
        out = left.join(right, left["label"] == right["other"], "left_anti")
    else:
        out = left.sparkSession.sql("SELECT label FROM {l} WHERE label NOT IN (SELECT other FROM {r})", l=left, r=right)
    out = out.orderBy("label")
    return out if limit is None else out.limit(limit)


def with_buckets(records: DataFrame) -> DataFrame:
    """Derives iso_week and ym from the time, null where it is no time."""
    return records.withColumn("iso_week", iso_week(F.col("ts"))).withColumn("ym", year_month(F.col("ts")))


def vocabulary(records: DataFrame, kinds: tuple[str, ...] = ("metric", "source", "domain", "subject")) -> DataFrame:
    """(kind, name): distinct metrics, sources, domains and subjects in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in kinds]))
    return records.select(pairs.alias("x")).select("x.kind", "x.name").where("name is not null").distinct().orderBy("kind", "name")


def stats(records: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.count_if(F.col("confidence") < min_confidence).alias("unverified"))


def confidence(metric: Column, unit: Column, value: Column, *extra: Column) -> Column:
    """Best of the validators: known money and count metrics, finite numbers, and ``extra`` scores; unverified if none holds."""
    known = F.when(
        (metric == "amount") & (unit.isNull() | (unit == "USD")), HIGH
    ).when(metric.isin(*COUNT_METRICS) & (unit == "count"), HIGH).otherwise(0.0)
    finite = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(PROVISIONAL)
    best = F.greatest(known, finite, *[F.coalesce(e, F.lit(0.0)) for e in extra])
    return F.when(best > 0, best).otherwise(UNVERIFIED)


def taught(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule_tier, the best tier of the matching rules (null if none).

    rules: (metric, unit null = any, value_min, value_max null = open, tier). Rules are few for a metric and are gathered by
    metric first, so the records meet them in an equi-join and no record is multiplied.
    """
    packed = rules.groupBy(F.col("metric").alias("__m")).agg(F.collect_list(F.struct("unit", "value_min", "value_max", "tier")).alias("__rules"))
    fits = F.filter(
        "__rules",
        lambda r: (r.unit.isNull() | (r.unit == F.col("unit"))) & (
            r.value_min.isNull() | (F.col("value") >= r.value_min)
        ) & (r.value_max.isNull() | (F.col("value") <= r.value_max))
    )
    tier = F.array_max(F.transform(fits, lambda r: r.tier))
    return records.join(packed, records["metric"] == packed["__m"], "left").withColumn("rule_tier", tier).drop("__m", "__rules")


def salience(ts: Column, as_of: str, half_life_days: float = 90.0, *extra: Column) -> Column:
    decay = age_decay(ts, as_of, half_life_days)
    return F.greatest(decay, *extra) if extra else decay


def currency(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, metric, unit, value): every dollar amount of a text."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(CURRENCY), F.lit(1))).alias("pos", "amount")
    return texts.select(key, found).select(
        key, "pos", F.lit("amount").alias("metric"), F.lit("USD").alias("unit"),
        F.replace("amount", F.lit(","), F.lit("")).cast("double").alias("value")
    )


def revalidated(records: DataFrame, scores: Column, metric: str | None = None, below: float = 2.0) -> DataFrame:
    """Records with their confidence scored again, where it is under ``below`` and of the metric; others stay."""
    scope = F.col("confidence") < below
    if metric is not None:
        scope &= F.col("metric") == metric
    return records.withColumn("confidence", F.when(scope, scores).otherwise(F.col("confidence")))


def with_rule(rules: DataFrame, rule: dict, now: str) -> DataFrame:
    """Rule table with one more rule; an active sibling (same owner, metric and unit) is retired and the version goes up."""
    spark = rules.sparkSession
    new = spark.createDataFrame(
        [(rule["owner"], rule["metric"], rule.get("unit"), rule.get("value_min"), rule.get("value_max"), rule["tier"], 1, now, None)], rules.schema
    )
    same = (F.col("owner") == rule["owner"]) & (F.col("metric") == rule["metric"]) & F.col("unit").eqNullSafe(F.lit(rule.get("unit")))
    old = rules.withColumn("retired_at", F.when(same & F.col("retired_at").isNull(), F.lit(now)).otherwise(F.col("retired_at")))
    version = rules.where(same).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"))
    return old.unionByName(new.crossJoin(version).withColumn("version", (F.col("v") + 1).cast("int")).drop("v"))


def record_id(*parts: Column) -> Column:
    return short_id("rec_", *parts)


def upsert_records(records: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Records by id: the last of the new ones (by ``order``) replaces the old one; week and month follow from the time."""
    return upsert(records, with_buckets(new), ["id"], order).select(*records.columns)


def counts(
    records: DataFrame, nodes: DataFrame, edges: DataFrame, people: DataFrame, references: DataFrame, min_confidence: float = 0.7
) -> DataFrame:
    """(kind, n): sizes of the stores; edges count as open ones and as all."""
    parts = [
        stats(records, min_confidence).select(
            F.explode(F.create_map(F.lit("records"), "records", F.lit("unverified"), "unverified")).alias("kind", "n")
        ),
        edges.agg(F.count("*").alias("a"), F.count_if(F.col("valid_until").isNull()).alias("o")).select(
            F.explode(F.create_map(F.lit("edges_all"), "a", F.lit("edges"), "o")).alias("kind", "n")
        ),
    ]
    parts += [
        t.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind,
        t in (("nodes", nodes), ("people", people), ("references", references))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
