"""What the corpus operators share: written tables, memory and connected components."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloft.storage import checkpointed, written

__all__ = ["BATCH_ROWS", "checkpointed", "connected_components", "small_batches", "trim", "written"]


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on in this session: texts are long, and each one is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def trim() -> None:
    """Gives freed memory back to the system, so that an idle Python worker does not keep what its largest group took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has a link.

    ``edges``: (src long, dst long), in any direction, repeats allowed; loops and nulls are ignored.
    Returns (id, component). Alternating large-star and small-star steps: each one is a
    map-side combined minimum by node and a join that adaptive execution can split at a hot node.
    Every round ends in a reliable checkpoint; an empty input gives an empty result.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = checkpointed(e.distinct())

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = signature(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        now = signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
