"""What is queued and when queues pause: the same whatever the triggers, and across restarts."""

import random

from pyspark.sql import functions as F

from sparkloft.streaming import pending

START = 1_700_000_000_000_000


def plain_unseen(rows, keep, upto):
    out, last = [], {}
    for chunk, content, at in sorted((r for r in rows if r[0] and r[1] and r[2] <= upto), key=lambda r: (r[2], r[1])):
        if chunk not in last or last[chunk][0] != content or at - last[chunk][1] > keep:
            out.append((chunk, content, at))
        last[chunk] = (content, at)
    return sorted(out)


def plain_pauses(rows, most, upto):
    out, state = [], {}
    for queue, change, at in sorted((r for r in rows if r[0] and r[2] <= upto), key=lambda r: (r[2], r[1])):
        n, paused = state.get(queue, (0, False))
        n = max(0, n + change)
        now = n > 0.8 * most if paused else n >= most
        if now != paused:
            out.append((queue, at, n, now))
        state[queue] = (n, now)
    return sorted(out)


def fed(spark, tmp_path, rows, schema, make, check):
    """Files one by one, the query restarted for each part; ``check`` gets all rows so far and what is written."""
    rows.sort(key=lambda r: r[2] + random.Random(r[2]).random() * 40)  # up to forty seconds out of order
    seen = []
    for n, part in enumerate((rows[:50], rows[50:90], rows[90:], [("c", rows[0][1], 1000.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        seen += part
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = make(stream.withColumn("ts", F.timestamp_micros((START + F.col("ts") * 1e6).cast("long"))))
        pending.written(made, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
        got = spark.read.schema(made.schema).parquet(str(tmp_path / "out") + "/epoch=*").withColumn("ts", (F.unix_micros("ts") - START) / 1e6)
        check(seen, sorted(tuple(r) for r in got.collect()), max(r[2] for r in seen) - 60)


def test_unseen(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("abd"), rng.choice("xy"), float(t)) for t in rng.sample(range(1, 600), 120)] + [(None, "x", 9.0)]

    def check(seen, got, upto):
        assert got == plain_unseen(seen, 12, upto)

    fed(spark, tmp_path, rows, "chunk_id string, content_hash string, ts double", lambda s: pending.unseen(s, 12.0, "60 seconds"), check)


def test_pauses(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([3, 2, 1, -2, -3]), float(t)) for t in rng.sample(range(1, 600), 120)]

    def check(seen, got, upto):
        assert got == plain_pauses(seen, 10, upto)

    fed(spark, tmp_path, rows, "queue string, change long, ts double", lambda s: pending.pauses(s, 10, "60 seconds"), check)
