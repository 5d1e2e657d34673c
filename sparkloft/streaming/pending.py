"""What waits for its summary, as a stream: each chunk keeps the content that was last queued, for a time, and backpressure with hysteresis."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloft.storage import folder
from sparkloft.streaming.feeds import event_stream
from sparkloft.streaming.watch import state_store

_NEW = "chunk_id string, content_hash string, ts timestamp"
_DEPTH = "queue string, ts timestamp, waiting long, paused boolean"


class _Ordered(StatefulProcessor):
    """Rows of a key are held until the watermark has come to their time, then seen in the order of (time, text): triggers make no difference."""

    columns: tuple[str, ...]
    held_as: str
    kept_as: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_as)
        self.kept = handle.getValueState("kept", self.kept_as)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        soonest = None
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64")
            self.held.appendList(list(zip(at.tolist(), part[self.columns[1]].tolist(), strict=True)))
            soonest = int(at.min()) if soonest is None else min(soonest, int(at.min()))
        if soonest is not None:
            self.handle.registerTimer(soonest // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.held.get()) if self.held.exists() else []
        ready = [r for r in held if r[0] <= now]
        left = held[len(ready) :]
        self.held.clear()
        if left:
            self.held.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        out = self.see(key[0], ready, now)
        if out:
            found = pd.DataFrame(out, columns=self.shown)
            found["ts"] = pd.to_datetime(found["ts"], unit="us")
            yield found

    def close(self) -> None:
        pass


class _Seen(_Ordered):
    columns, shown = ("ts", "content_hash"), ["chunk_id", "content_hash", "ts"]
    held_as, kept_as = "at long, content_hash string", "content_hash string, at long"

    def __init__(self, keep: float):
        self.keep = round(keep * 1e6)

    def see(self, key: str, ready: list, now: int) -> list:
        last = self.kept.get() if self.kept.exists() else None
        out = []
        for at, content in ready:
            if last is None or content != last[0] or at - last[1] > self.keep:
                out.append((key, content, at))
            last = (content, at)
        if last is not None and now - last[1] > self.keep:
            self.kept.clear()
        elif last is not None:
            self.kept.update(tuple(last))
            self.handle.registerTimer((last[1] + self.keep) // 1000 + 2)  # to forget it then
        return out


class _Waiting(_Ordered):
    columns, shown = ("ts", "change"), ["queue", "ts", "waiting", "paused"]
    held_as, kept_as = "at long, change long", "waiting long, paused boolean"

    def __init__(self, most: int):
        self.most = most

    def see(self, key: str, ready: list, now: int) -> list:
        waiting, paused = self.kept.get() if self.kept.exists() else (0, False)
        out = []
        for at, change in ready:
            waiting = max(0, waiting + change)
            was, paused = paused, waiting > 0.8 * self.most if paused else waiting >= self.most
            if was != paused:
                out.append((key, at, waiting, paused))
        self.kept.update((waiting, paused))
        return out


def unseen(rows: DataFrame, keep: float = 7 * 86400.0, lateness: str = "0 seconds") -> DataFrame:
    """(chunk_id, content_hash, ts): of a stream (chunk_id, content_hash, ts) the rows that are to be queued.

    A chunk's row is queued if its content differs from that of its row before, or if that was more than ``keep`` seconds ago: then the
    chunk's state is gone too. Rows come out once the watermark, ``lateness`` behind the newest row, has passed them. Rows without a chunk, content or
    time are dropped.
    """
    rows = rows.where("chunk_id IS NOT NULL AND content_hash IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", lateness)
    return rows.groupBy("chunk_id").transformWithStateInPandas(_Seen(keep), _NEW, "Append", "EventTime")


def pauses(changes: DataFrame, most: int, lateness: str = "0 seconds") -> DataFrame:
    """(queue, ts, waiting, paused): when each queue of a stream (queue, change, ts) pauses and when it goes on.

    ``change`` is how many items came, or, below zero, were taken. A queue pauses at ``most`` and stays so above four fifths of it. A queue's state is two
    values and the changes that the watermark has not passed. Rows without a queue, change or time are dropped.
    """
    rows = changes.where("queue IS NOT NULL AND change IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", lateness)
    return rows.groupBy("queue").transformWithStateInPandas(_Waiting(most), _DEPTH, "Append", "EventTime")


def written(rows: DataFrame, out: str, state: str, once: bool = False):
    """Writes the rows of ``unseen`` or ``pauses`` as they become final; a trigger that is repeated writes the same place. Returns the running query."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    with state_store(rows.sparkSession):
        w = rows.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", state)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def of_folder(spark: SparkSession, path: str, make) -> DataFrame:
    """What ``make`` gives of all there is in a folder of files, as a batch; ``make`` takes the stream of its rows."""
    out, state = folder(spark, "pending"), folder(spark, "pending-state")
    rows = make(event_stream(spark, path))
    written(rows, out, state, once=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/epoch=*")
