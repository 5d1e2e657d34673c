"""Calls against a budget for the trailing hour, as a stream: each key keeps the times of its last hour and no more; keys share states by a hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloft.storage import folder
from sparkloft.streaming.feeds import event_stream
from sparkloft.streaming.pieces import Pieces
from sparkloft.streaming.watch import state_store

_JUDGED = "key string, id long, ts timestamp, in_hour long, allowed boolean"


SHARDS = 512  # groups of keys that share a state
PIECE = 3_600_000_000  # microseconds of a shard's calls that are read at once, at least


def _calls_before(keys: np.ndarray, times: np.ndarray, span: int, first: int) -> np.ndarray:
    """For each row from ``first`` on: the rows of its key in the span up to and with its time."""
    code = pd.factorize(keys)[0].astype("int64")
    moments, rank = np.unique(times, return_inverse=True)
    step = len(moments) + 1
    line = np.sort(code * step + rank)  # a key's calls follow each other in time
    own, at = code[first:] * step, times[first:]
    upto, since = np.searchsorted(moments, at, "right"), np.searchsorted(moments, at - span, "left")
    return np.searchsorted(line, own + upto) - np.searchsorted(line, own + since)


class _Trailing(StatefulProcessor):
    """A call is judged when the watermark has come to its time: no earlier call can come any more, whatever the triggers were.

    The keys of a shard are judged together, by pieces of time in order: what a key costs is rows of arrays, not calls of the state store.
    """

    def __init__(self, budget: int, seconds: float):
        self.budget, self.span = budget, round(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = Pieces(handle, {"key": "string", "id": "long"}, max(PIECE, self.span))
        self.recent = handle.getValueState("recent", "key array<string>, at array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        soonest: list[int] = []

        def calls():
            for part in rows:
                at = part["ts"].astype("datetime64[us]").astype("int64")
                soonest[:] = [min([*soonest, int(at.min())])]
                yield pd.DataFrame({"at": at, "key": part["key"], "id": part["id"]})

        self.held.add(calls())
        if soonest:
            self.handle.registerTimer(soonest[0] // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        keys, times = self.recent.get() if self.recent.exists() else ([], [])
        keys, times = np.array(keys, dtype=object), np.array(times, dtype="int64")
        soonest = None
        for start, entries in self.held:
            rows = self.held.read(entries)
            at = np.array(rows["at"], dtype="int64")
            ready = at <= now
            if ready.any():
                since = times >= start - self.span
                first = int(since.sum())
                keys = np.concatenate([keys[since], np.array(rows["key"], dtype=object)[ready]])
                times = np.concatenate([times[since], at[ready]])
                found = pd.DataFrame({"key": keys[first:], "id": np.array(rows["id"], dtype="int64")[ready], "ts": pd.to_datetime(times[first:], unit="us")})
                found["in_hour"] = _calls_before(keys, times, self.span, first)
                found["allowed"] = found["in_hour"] <= self.budget
                left = np.flatnonzero(~ready)
                self.held.replace(entries, {c: [v[i] for i in left] for c, v in rows.items()})
                yield found
            if not ready.all():
                soonest = int(at[~ready].min())
                break
        kept = times >= now - self.span
        self.recent.update((keys[kept].tolist(), times[kept].tolist()))
        if soonest is not None:
            self.handle.registerTimer(soonest // 1000 + 1)

    def close(self) -> None:
        pass


def trailing_calls(calls: DataFrame, budget: int, seconds: float = 3600.0, lateness: str = "0 seconds") -> DataFrame:
    """(key, id, ts, in_hour, allowed): each call of a stream (key, id, ts) with the calls of its key in the hour up to and with it.

    ``allowed`` says whether they fit the budget. Calls come out once the watermark, ``lateness`` behind the newest call, has passed them; calls
    without a key or a time are dropped. A key's state, one of SHARDS by a hash, is an hour of times and the calls that are not judged yet.
    """
    rows = calls.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", lateness)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(SHARDS)))
    return rows.groupBy("shard").transformWithStateInPandas(_Trailing(budget, seconds), _JUDGED, "Append", "EventTime")


def judge(calls: DataFrame, out: str, state: str, once: bool = False, **rules):
    """Writes the judged calls as they become final; a trigger that is repeated writes the same place. Returns the running query."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    with state_store(calls.sparkSession):
        w = trailing_calls(calls, **rules).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", state)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def judged(spark: SparkSession, path: str, calls, **rules) -> DataFrame:
    """The judged calls of all there is in a folder of files, as a batch; ``calls`` makes (key, id, ts) of its rows."""
    out, state = folder(spark, "calls"), folder(spark, "calls-state")
    judge(calls(event_stream(spark, path)), out, state, once=True, **rules).awaitTermination()
    return spark.read.schema(_JUDGED).parquet(f"{out}/epoch=*")
