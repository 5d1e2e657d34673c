"""Folder watching with a clock of its own for every folder: changes are held until the folder is quiet, then queued as one."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloft.storage import folder as new_folder
from sparkloft.streaming.feeds import event_stream
from sparkloft.streaming.pieces import Pieces

DEBOUNCE, COOLDOWN = 30.0, 10.0
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_QUEUED = "folder string, first timestamp, last timestamp, files long, queued boolean"


PIECE = 3_600_000_000  # microseconds of a folder's changes that are read at once
_ROWS = 10_000  # bursts that are handed on together


@dataclass
class _Burst:
    begin: tuple
    last: int
    wait: int
    paths: set


def _place(change: tuple) -> tuple:
    at, path, wait = change
    return at, path or "", wait


def _frame(bursts: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(bursts, columns=["folder", "first", "last", "files", "queued"])
    for c in ("first", "last"):
        found[c] = pd.to_datetime(found[c], unit="us")
    return found


class _Bursts(StatefulProcessor):
    """State of a folder: the changes of bursts that are not over, and when it was queued last.

    A burst is over when the watermark is a debounce past its last change: no change that would prolong it can come any more. So results
    do not depend on how changes are dealt to triggers, and a restart goes on with the state of the checkpoint. Changes are held by pieces
    of time and read in order, so memory holds one piece, the open burst's paths and a lot of bursts, however many changes there are.
    """

    def __init__(self, debounce: float, cooldown: float):
        self.debounce, self.cooldown = debounce, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = Pieces(handle, {"path": "string", "debounce": "long"}, PIECE)
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        soonest: list[int] = []

        def changes():
            for part in rows:
                at = part["ts"].astype("datetime64[us]").astype("int64")
                own = part["debounce"].fillna(self.debounce) if "debounce" in part else pd.Series(self.debounce, index=part.index)
                own = (own * 1e6).round().astype("int64")
                soonest[:] = [min([*soonest, int((at + own).min())])]
                yield pd.DataFrame({"at": at, "path": part["path"], "debounce": own})

        self.held.add(changes())
        if soonest:
            self.handle.registerTimer(soonest[0] // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        out, burst, left = [], None, None
        for row in self._in_order():
            at, path, wait = row
            if burst and at - burst.last < burst.wait:
                burst.last, burst.wait = at, wait
                burst.paths.add(path)
                continue
            if burst and burst.last + burst.wait > now:
                break
            if burst:
                out.append(self._over(key[0], burst))
                if len(out) >= _ROWS:
                    yield _frame(out)
                    out = []
            burst = _Burst(row, at, wait, {path})
        if burst and burst.last + burst.wait > now:
            left = burst
        elif burst:
            out.append(self._over(key[0], burst))
        self._drop_before(left and _place(left.begin))
        if left:
            self.handle.registerTimer((left.last + left.wait) // 1000 + 1)
        if out:
            yield _frame(out)

    def _in_order(self) -> Iterator[tuple]:
        for _, entries in self.held:
            rows = self.held.read(entries)
            yield from sorted(zip(rows["at"], rows["path"], rows["debounce"], strict=True), key=_place)

    def _over(self, folder: str, burst: _Burst) -> tuple:
        over = burst.last + burst.wait
        before = self.last.get()[0] if self.last.exists() else None
        queued = before is None or over - before >= self.cooldown * 1e6
        if queued:
            self.last.update((over,))
        return folder, burst.begin[0], burst.last, len(burst.paths), queued

    def _drop_before(self, first: tuple | None) -> None:
        """Changes of bursts that are over go; ``first``: the place of the first one that stays, if any."""
        for start, entries in self.held:
            if first is None or start + self.held.width <= first[0]:
                self.held.replace(entries)
                continue
            rows = self.held.read(entries)
            kept = [r for r in zip(rows["at"], rows["path"], rows["debounce"], strict=True) if _place(r) >= first]
            if len(kept) < len(rows["at"]):
                self.held.replace(entries, dict(zip(("at", "path", "debounce"), map(list, zip(*kept, strict=True)), strict=True)))
            break  # later pieces stay whole

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed timers need, for queries that start meanwhile; the session's setting comes back."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


def quiet_folders(changes: DataFrame, debounce: float = DEBOUNCE, cooldown: float = COOLDOWN, lateness: str = "0 seconds") -> DataFrame:
    """(folder, first, last, files, queued): one row for each burst of a folder's changes, when the folder has been quiet for its debounce.

    changes: a stream (folder, path, ts[, debounce]) with times of the changes; ``debounce`` gives a folder seconds of its own, null the
    default. A burst that ends within ``cooldown`` seconds of the last queued one is not queued: such are replays of the same changes. Each
    folder has its own timer on the watermark, ``lateness`` behind the newest change of all folders. Changes without a folder or a time are dropped.
    """
    rows = changes.where(F.col("folder").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", lateness)
    return rows.groupBy("folder").transformWithStateInPandas(_Bursts(debounce, cooldown), _QUEUED, "Append", "EventTime")


def watch(changes: DataFrame, out: str, state: str, once: bool = False, **rules):
    """Writes the bursts of ``quiet_folders`` as they end; a trigger that is repeated writes the same place. Returns the running query."""
    spark = changes.sparkSession

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    with state_store(spark):
        w = quiet_folders(changes, **rules).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", state)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def watched(spark: SparkSession, path: str, changes, **rules) -> DataFrame:
    """The bursts of all there is in a folder of files, as a batch; ``changes`` makes (folder, path, ts[, debounce]) of its rows."""
    out, state = new_folder(spark, "bursts"), new_folder(spark, "bursts-state")
    watch(changes(event_stream(spark, path)), out, state, once=True, **rules).awaitTermination()
    return spark.read.schema(_QUEUED).parquet(f"{out}/epoch=*")
