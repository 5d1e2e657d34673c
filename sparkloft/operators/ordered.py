"""Order over whole tables without a window in one task: running totals, values at ranks, the newest row of a key, rows dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.storage import checkpointed

RANGES = 64
PLAIN = 100_000  # rows up to which one task sorts them all
A_TASK = 4000  # rows of a task that makes a text of each row and takes it apart
KEYED_OF_A_TASK = 250_000  # rows of a task that holds them by key, texts and all


def running_total(rows: DataFrame, order: tuple[str, ...], size: str, ranges: int | None = None) -> DataFrame:
    """Adds before: the sum of ``size`` over all rows that come earlier in the order (which should be total).

    Rows are dealt out by ranges of the order; each range is summed up, and the sums of the earlier ranges, ``ranges`` at most, are
    added to its own running total. So no task sorts more than its range. There are as many ranges as the session has shuffle
    partitions, 64 at least.
    """
    ranges = ranges or parts(rows.sparkSession)
    if rows.limit(PLAIN + 1).count() <= PLAIN:  # a bounded number of rows: one window holds them, with the same result
        every = W.Window.orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
        return rows.withColumn("before", F.coalesce(F.sum(size).over(every), F.lit(0)))
    placed = checkpointed(rows.repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id()))  # fixes the ranges
    totals = placed.groupBy("__part").agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"))
    sums = sorted((r["__part"], r["n"]) for r in totals.collect())
    earlier, total = [], sums[0][1] * 0 if sums else 0  # zero of the sum's own type
    for part, n in sums:
        earlier.append((part, total))
        total += n
    kind = totals.schema["n"].dataType.simpleString()
    starts = rows.sparkSession.createDataFrame(earlier, f"__part int, __earlier {kind}")
    run = F.sum(size).over(W.Window.partitionBy("__part").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1))
    out = placed.withColumn("__run", F.coalesce(run, F.lit(0))).join(F.broadcast(starts), "__part")
    return out.withColumn("before", F.col("__earlier") + F.col("__run")).drop("__part", "__run", "__earlier")


def parts(spark: SparkSession) -> int:
    """As many as the session has shuffle partitions, 64 at least."""
    return max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame, *key: str, of_a_task: int | None = None) -> DataFrame:
    """The rows dealt out by a key, A_TASK (or so many) to a task: for small rows that much work follows from, as a file of many such rows is one task."""
    return rows.repartition(-(-rows.count() // (of_a_task or A_TASK)) or 1, *key)


def place(rows: DataFrame, order: str | None) -> Column:
    """What ``newest`` compares: the order column, equal ones by what the row holds; without an order, the place in the input.

    The place is well defined only for rows straight from a list or file; rows out of a shuffle need an order column.
    """
    if order is None:
        return F.monotonically_increasing_id()
    return F.struct(F.col(order), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))


def newest(rows: DataFrame, key: tuple[str, ...], order: str | None = None) -> DataFrame:
    """Of each key the row that is last in the order (null comes first). An aggregate, so a hot key is cut in each task before the shuffle."""
    placed = rows.select(*key, F.struct(*rows.columns).alias("__row"), place(rows, order).alias("__at"))
    return placed.groupBy(*key).agg(F.max_by("__row", "__at").alias("__row")).select("__row.*")


def at_ranks(values: DataFrame, column: str, ranks: dict[str, int]) -> dict[str, float | None]:
    """The values at given ranks (from 0) of a sorted column; its different values are counted first. None where a rank is beyond the rows."""
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("m"))
    placed = running_total(counts, (column,), "m")
    picks = [F.min(F.when(F.col("before") + F.col("m") > r, F.col(column))).alias(name) for name, r in ranks.items()]
    return placed.agg(*picks).first().asDict()
