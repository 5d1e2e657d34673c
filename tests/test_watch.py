"""Folder watching: each folder by its own clock, whatever the triggers, and across a restart."""

import pytest
from pyspark.sql import functions as F

from sparkloft.streaming import watch

START = 1_700_000_000_000_000
SCHEMA = "folder string, path string, ts double, debounce double"


def feed(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


def stream(spark, folder):
    rows = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.withColumn("ts", F.timestamp_micros((START + F.col("ts") * 1e6).cast("long")))


def run(spark, tmp_path, **rules):
    watch.watch(stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), once=True, **rules).awaitTermination()
    got = spark.read.schema(watch._QUEUED).parquet(str(tmp_path / "out") + "/epoch=*")
    return sorted((r["folder"], r["a"], r["b"], r["files"], r["queued"]) for r in got.select("folder", (F.unix_micros("first") - START).alias("a"), (F.unix_micros("last") - START).alias("b"), "files", "queued").collect())


def test_folders_fire_separately_and_state_survives(spark, tmp_path):
    s = 1_000_000
    feed(spark, tmp_path / "in", 1, [("a", "x", 0.0, None), ("b", "x", 5.0, None), ("a", "y", 20.0, None), ("b", "y", 6.0, 100.0), (None, "z", 7.0, None)])
    feed(spark, tmp_path / "in", 2, [("a", "x", 45.0, None), ("c", "q", 46.0, 1.0)])
    assert run(spark, tmp_path) == []  # a was last changed at 45; b waits for 106; c at 46 is the newest there is
    feed(spark, tmp_path / "in", 3, [("c", "q", 80.0, 1.0)])
    assert run(spark, tmp_path) == [("a", 0, 45 * s, 2, True), ("c", 46 * s, 46 * s, 1, True)]
    feed(spark, tmp_path / "in", 4, [("c", "q", 84.0, 1.0), ("b", "z", 90.0, 100.0)])
    feed(spark, tmp_path / "in", 5, [("d", "q", 300.0, None)])
    got = run(spark, tmp_path)
    assert ("b", 5 * s, 90 * s, 3, True) in got
    # c was queued at 81; what was over at 85 is within ten seconds of it
    assert ("c", 80 * s, 80 * s, 1, True) in got and ("c", 84 * s, 84 * s, 1, False) in got
    assert len(got) == 5


def test_changes_out_of_order_join_their_burst(spark, tmp_path):
    s = 1_000_000
    feed(spark, tmp_path / "in", 1, [("a", "x", 100.0, None)])
    feed(spark, tmp_path / "in", 2, [("a", "y", 140.0, None)])
    feed(spark, tmp_path / "in", 3, [("a", "z", 120.0, None)])
    feed(spark, tmp_path / "in", 4, [("b", "z", 400.0, None)])
    assert run(spark, tmp_path, lateness="60 seconds") == [("a", 100 * s, 140 * s, 3, True)]


def test_the_sessions_setting_comes_back(spark, tmp_path):
    before = spark.conf.get(watch._PROVIDER)
    feed(spark, tmp_path / "in", 1, [("a", "x", 1.0, None)])
    run(spark, tmp_path)
    assert spark.conf.get(watch._PROVIDER) == before


@pytest.mark.parametrize("rows", [[], [("a", "x", 1.0, None)]])
def test_nothing_is_over_yet(spark, tmp_path, rows):
    feed(spark, tmp_path / "in", 1, rows)
    assert run(spark, tmp_path) == []
