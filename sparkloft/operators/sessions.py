"""Extractions of sessions fanned out to tiers, decisions, pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloft.functions.text import content_id


def fan_out(extractions: DataFrame) -> dict[str, DataFrame]:
    """Rows by tier of extractions (session_id, summary, decisions array<struct<text, rationale, supersedes>>, triplets array<struct<subject, relation, object>>)."""
    decisions = extractions.select("session_id", F.explode("decisions").alias("d")).select("session_id", "d.text", "d.rationale", "d.supersedes")
    return {
        "summary": extractions.where("summary <> ''").select(
            "session_id", content_id("summary:", F.col("session_id").cast("string"), F.col("summary")).alias("chunk_id"),
            F.col("summary").alias("text"), F.lit("session_summary").alias("source_type")
        ),
        "decisions": decisions.select(
            "session_id", content_id("decision:", F.col("session_id").cast("string"), F.col("text")).alias("chunk_id"), "text",
            F.lit("session_decision").alias("source_type")
        ),
        "triplets": extractions.select("session_id", F.explode("triplets").alias("t")).select(
            "session_id", "t.subject", "t.relation", "t.object"
        ).distinct(),
        "superseded": decisions.where("supersedes is not null").select("session_id", F.col("supersedes").alias("old"), F.col("text").alias("new")),
    }


def promoted(decisions: DataFrame) -> DataFrame:
    """Decisions (session_id, text, rationale, supersedes) worth remembering: with a rationale, and not superseded in their own session."""
    gone = decisions.where("supersedes is not null").select("session_id", F.col("supersedes").alias("text")).distinct()
    return decisions.where("trim(rationale) <> ''").join(gone, ["session_id", "text"], "left_anti")


def pending(sessions: DataFrame, marks: DataFrame, now: float, idle: float) -> DataFrame:
    """Quiet sessions (session_id, tool, size, modified) that are unmarked or have grown: idle for so long, or not their tool's newest."""
    newest = sessions.groupBy("tool").agg(F.max("modified").alias("newest"))
    quiet = sessions.join(newest, "tool").where((F.lit(now) - F.col("modified") >= idle) | (F.col("modified") < F.col("newest")))
    return quiet.join(
        marks.select("session_id", F.col("size").alias("seen")), "session_id", "left"
    ).where("seen is null or size > seen").select("session_id", "tool", "size")


def digest(decisions: DataFrame) -> DataFrame:
    """(session_id, block): one markdown block a session, so that writing it again replaces it."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_set("text")), lambda t: F.concat(F.lit("- "), t)), "\n")
    return decisions.groupBy("session_id").agg(
        F.concat(F.lit("## Session "), F.first("session_id").cast("string"), F.lit("\n"), lines).alias("block")
    )
