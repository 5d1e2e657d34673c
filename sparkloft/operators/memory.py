"""Curated memory: near-duplicates, eviction, context packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.functions.text import collapse
from sparkloft.functions.vector import cosine, literal
from sparkloft.operators.ordered import running_total


def normal(column: str):
    return F.lower(collapse(F.col(column)))


def duplicates(memories: DataFrame, text: str) -> DataFrame:
    """Active memories whose normalised text equals or holds the given one's."""
    new = " ".join(text.lower().split())
    return memories.where(F.col("active") & F.contains(normal("text"), F.lit(new)))


SUPERSEDES = 0.92  # cosine from which on a new memory takes the place of an old one


def superseded(memories: DataFrame, embedding: list[float], section: str | None = None, least: float = SUPERSEDES) -> DataFrame:
    """The active memory that a new one takes the place of: the nearest by cosine, if it is ``least`` or more; one row or none."""
    rows = memories.where("active and embedding is not null")
    if section is not None:
        rows = rows.where(F.col("section") == section)
    near = rows.withColumn("score", cosine(F.col("embedding"), literal(embedding)))
    return near.orderBy(F.desc("score"), "id").limit(1).where(F.col("score") >= least)


def add(memories: DataFrame, new: DataFrame, embedding: list[float], cap: int | None = None, supersedes: str | None = None) -> DataFrame:
    """The table after one more memory (a row of its columns).

    A text that an active memory equals or holds adds nothing. A memory that the new one supersedes goes: the nearest one from
    SUPERSEDES on, and the one whose id or text is ``supersedes``. With ``cap``, old auto-promoted memories make room first.
    """
    row = new.select("text", "section").first()
    if not duplicates(memories, row["text"]).isEmpty():
        return memories
    gone = superseded(memories, embedding, row["section"]).select("id")
    if supersedes is not None:
        told = " ".join(supersedes.lower().split())
        gone = gone.union(memories.where((F.col("id") == supersedes) | (normal("text") == told)).select("id"))
    kept = memories.join(gone.distinct(), "id", "left_anti")
    if cap is not None:
        kept = kept.join(evict(kept, cap - len(row["text"])), "id", "left_anti")
    return kept.select(*memories.columns).unionByName(new, allowMissingColumns=True)


def evict(memories: DataFrame, cap: int) -> DataFrame:
    """(id): auto-promoted memories to drop, longest unreferenced and least confident first, until the rest fits ``cap`` characters."""
    over = memories.agg((F.coalesce(F.sum(F.length("text")), F.lit(0)) - cap).alias("over")).first()["over"]
    rows = memories.where(F.col("active") & F.col("origin").startswith("session:"))
    rows = rows.select("id", F.coalesce("last_referenced_at", "created_at").alias("at"), "confidence", F.length("text").alias("size"))
    return running_total(rows, ("at", "confidence", "id"), "size").where(F.col("before") < over).select("id")


def context(memories: DataFrame, budget: int, most: int = 1000) -> DataFrame:
    """(id, place): memories for a session's start, most confident and newest first, while they fit the budget (one always does).

    At most ``most`` lines can be of use in a prompt, so the running sum goes over a short list.
    """
    rows = memories.where(F.col("active") & (F.coalesce("sensitivity", F.lit("normal")) == "normal"))
    rows = rows.orderBy(F.desc("confidence"), F.desc("created_at"), F.desc("id")).limit(most)
    line = F.length(F.concat(F.lit("- ("), F.col("section"), F.lit(") "), F.col("text"))) + 1
    w = W.Window.orderBy(F.desc("confidence"), F.desc("created_at"), F.desc("id"))
    rows = rows.select("id", F.row_number().over(w).alias("place"), F.sum(line).over(w.rowsBetween(W.Window.unboundedPreceding, 0)).alias("used"))
    return rows.where((F.col("used") <= budget) | (F.col("place") == 1)).select("id", "place")


def parse_markdown(lines: DataFrame) -> DataFrame:
    """(line_no, section, text) of the items of a memory file: (line_no, value). One file, so one ordered window."""
    section = F.last(
        F.when(F.col("value").startswith("## "), F.substring("value", 4, 1 << 20)), ignorenulls=True
    ).over(W.Window.orderBy("line_no").rowsBetween(W.Window.unboundedPreceding, 0))
    return lines.withColumn("section", section).where(F.col("value").startswith("- ")).select(
        "line_no", "section", F.trim(F.regexp_replace(F.substring("value", 3, 1 << 20), r"\s*<!--.*?-->\s*$", "")).alias("text")
    )
