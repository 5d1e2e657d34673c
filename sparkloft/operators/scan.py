"""Occurrences of a word or phrase in archived turns, by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloft.functions.text import phrase_count, tokens

BUCKETS = {"week": "iso_week", "day": "day", "source": "tool", "month": "ym"}


def scan(
    turns: DataFrame, phrase: list[str], group_by: str | None = None, since: str | None = None, until: str | None = None, order: str = "desc",
    limit: int | None = None, include_sensitive: bool = False
) -> DataFrame:
    """(label, value): counts, ordered by (value, label) in one direction; only buckets with a count. Days outside [since, until) are not read."""
    rows = turns.where("kind in ('text', 'thinking', 'tool_use', 'tool_result')")
    if since:
        rows = rows.where(F.col("day") >= since[:10])
    if until:
        rows = rows.where(F.col("day") < until[:10])
    if not include_sensitive:
        rows = rows.where(F.coalesce("sensitivity", F.lit("normal")) == "normal")
    if group_by == "month":
        rows = rows.withColumn("ym", F.substring("day", 1, 7))
    label = F.lit("total") if group_by is None else F.col(BUCKETS[group_by])
    counted = rows.select(label.alias("label"), phrase_count(tokens(F.col("text")), phrase).alias("n")).where("n > 0")
    out = counted.groupBy("label").agg(F.sum("n").alias("value"))
    by = [F.desc("value"), F.desc("label")] if order == "desc" else [F.asc("value"), F.asc("label")]
    out = out.orderBy(*by)
    return out if limit is None else out.limit(limit)
