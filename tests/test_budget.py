"""Calls against a trailing budget: the same whatever the triggers, and across a restart."""

import random

from pyspark.sql import functions as F

from sparkloft.streaming import budget

START = 1_700_000_000_000_000
SCHEMA = "key string, id long, ts double"


def plain(rows, most, span, upto):
    out = []
    for key, call, at in rows:
        if key is not None and at <= upto:
            n = sum(k == key and at - span <= t <= at for k, _, t in rows)
            out.append((key, call, n, n <= most))
    return sorted(out)


def test_calls_in_any_order_of_triggers(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, float(rng.randrange(1, 400))) for i in range(120)] + [(None, 500, 9.0)]
    rows.sort(key=lambda r: r[2] + rng.random() * 40)  # up to forty seconds out of order
    seen = []
    for n, part in enumerate((rows[:50], rows[50:90], rows[90:], [("c", 900, 1000.0)])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        seen += part
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream = stream.withColumn("ts", F.timestamp_micros((START + F.col("ts") * 1e6).cast("long")))
        budget.judge(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True, budget=3, seconds=30.0, lateness="60 seconds").awaitTermination()
        got = spark.read.schema(budget._JUDGED).parquet(str(tmp_path / "out") + "/epoch=*")
        got = sorted((r["key"], r["id"], r["in_hour"], r["allowed"]) for r in got.collect())
        assert got == plain(seen, 3, 30, max(r[2] for r in seen) - 60)
