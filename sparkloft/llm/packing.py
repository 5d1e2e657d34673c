"""Packing: deficit round-robin over source queues fills every window to target token proportions."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.taskcontext import TaskContext

from sparkloft.llm.bpe import VOCABULARY, tokenizer
from sparkloft.llm.common import small_batches, written

LENGTH = 1024
WINDOW = 64  # sequences in a window: every window of so many tokens holds the target proportions
SEPARATOR = 0
QUEUES = 2048  # most source queues whose plan one process holds; of more, each row works out its own queue
BLOCK = 4096  # windows whose places are summed up together
BROADCAST_ROWS = 200_000  # starts (24 bytes and a queue name each) that are broadcast at most


class Plan:
    """The round-robin in closed form: what each queue has served when a window begins.

    A window asks a queue for tokens * share. What integer tokens leave over is carried on as its deficit, so up to window k
    a queue has served the nearest integer to k shares: never more than half a token off, in whichever
    partition it is worked out. When a queue runs dry, the others take its share in proportion from the next window on.
    """

    def __init__(self, totals: Mapping[str, int], window: int, target: Mapping[str, float] | None = None):
        self.names = sorted(totals)
        self.totals = {q: totals[q] for q in self.names}
        self.window = window
        weight = {q: Fraction(target.get(q, 0)).limit_denominator(10**9) if target else Fraction(self.totals[q]) for q in self.names}
        served, live, k = dict.fromkeys(self.names, 0), {q for q in self.names if self.totals[q]}, 0
        self.phases = []  # first window, served before, share
        while live:
            total = sum(weight[q] for q in live)
            share = {q: (weight[q] / total if total else Fraction(1, len(live))) if q in live else Fraction(0) for q in self.names}
            self.phases.append((k, served, share))
            # windows until a live queue is dry: at least one, so that each phase ends
            last = min(-(-(self.totals[q] - served[q]) // (window * share[q])) for q in live if share[q])
            k += max(1, int(last))
            served = self._served(len(self.phases) - 1, k)
            live = {q for q in live if served[q] < self.totals[q]}
        self.windows = k
        self.first = [p[0] for p in self.phases]
        self.rows: dict[int, tuple[int, dict[str, tuple[int, int, int]]]] = {}

    def _served(self, phase: int, k: int) -> dict[str, int]:
        start, before, share = self.phases[phase]
        return {q: min(self.totals[q], before[q] + int((k - start) * self.window * share[q] + Fraction(1, 2))) for q in self.names}

    def served(self, k: int) -> dict[str, int]:
        if not self.phases:
            return dict.fromkeys(self.names, 0)
        return self._served(
            max(0, bisect.bisect_right(self.first, min(k, self.windows)) - 1), min(k, self.windows)
        ) if k < self.windows else dict(self.totals)

    def row(self, k: int) -> dict[str, tuple[int, int, int]]:
        """Of window k, by queue: first and last token of the queue's row of tokens, and where its part begins in the output."""
        if k not in self.rows:
            a, b = self.served(k), self.served(k + 1)
            at, out = sum(a.values()), {}
            for q in self.names:
                out[q] = (a[q], b[q], at)
                at += b[q] - a[q]
            if len(self.rows) * len(self.names) > 1_000_000:
                self.rows.clear()
            self.rows[k] = out
        return self.rows[k]

    def find(self, queue: str, token: int) -> int:
        """The window that serves a token of a queue."""
        low, high = 0, self.windows - 1
        while low < high:
            mid = (low + high) // 2
            if self.served(mid + 1)[queue] > token:
                high = mid
            else:
                low = mid + 1
        return low

    def pieces(self, queue: str, start: int, length: int, near: int | None = None):
        """Where the tokens [start, start + length) of a queue go: (offset in them, length, place in the output), and the last window."""
        k = self.find(queue, start) if near is None or not self.row(near)[queue][0] <= start < self.row(near)[queue][1] else near
        out, done = [], 0
        while done < length:
            a, b, at = self.row(k)[queue]
            n = min(b - start - done, length - done)
            if n > 0:
                out.append((done, n, at + start + done - a))
                done += n
            if done < length:
                k += 1
        return out, k


def _spread(rows: DataFrame, totals: DataFrame, length: int, window: int) -> DataFrame:
    """What Plan gives without a target, for any number of queues: no process holds them all.

    All queues last to the end then, so what a queue has served when a window begins follows from its own total and the sum of all.
    Where a piece lies in its window takes the other pieces of the window only, a window's worth of tokens.

    rows: (doc_id, queue, base, before, n, ids). Returns the pieces as (doc_id, queue, done, m, n, ids, at).
    """
    whole, tokens = totals.agg(F.sum("total")).first()[0], length * window

    def cut(batches):
        for b in batches:
            take, cols = [], defaultdict(list)
            for i, (base, before, n, ids, total) in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 7)), strict=True)):
                done, wide = 0, len(ids) // n
                while done < n:
                    a = base + before + done
                    k = -(-whole * (2 * a + 1) // (2 * tokens * total)) - 1  # the window that serves token a
                    m = min(n - done, min(total, (2 * (k + 1) * tokens * total + whole) // (2 * whole)) - a)
                    take.append(i)
                    for c, v in zip(("k", "a", "done", "m", "n", "ids"), (k, a, done, m, n, ids[done * wide : (done + m) * wide]), strict=True):
                        cols[c].append(v)
                    done += m
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at), b.column(1).take(at), *(pa.array(cols[c], pa.int64()) for c in ("k", "a", "done", "m", "n")),
                    pa.array(cols["ids"], pa.binary())
                ],
                names=["doc_id", "queue", "k", "a", "done", "m", "n", "ids"]
            )

    schema = T.StructType().add("doc_id", rows.schema["doc_id"].dataType).add("queue", "string")
    for c in ("k", "a", "done", "m", "n"):
        schema = schema.add(c, "long")
    pieces = written(
        rows.join(totals, "queue").select("doc_id", "queue", "base", "before", "n", "ids", "total").mapInArrow(cut, schema.add("ids", "binary")),
        "packing-pieces"
    )
    block = F.floor(F.col("k") / BLOCK)
    sizes = pieces.groupBy("k").agg(F.sum("m").alias("size")).withColumn("block", block)
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("block").agg(F.sum("size").alias("size"))  # one row for BLOCK windows, so few that one task sums them up
    blocks = blocks.select("block", earlier(W.Window.orderBy("block")).alias("block_at"))
    begins = sizes.withColumn("in_block", earlier(W.Window.partitionBy("block").orderBy("k"))).join(blocks, "block")
    begins = begins.select("k", (F.col("block_at") + F.col("in_block")).alias("begin"))
    inside = F.sum("m").over(W.Window.partitionBy("k").orderBy("queue", "a").rowsBetween(W.Window.unboundedPreceding, -1))
    placed = pieces.withColumn("inside", F.coalesce(inside, F.lit(0))).join(begins, "k")
    return placed.select("doc_id", "queue", "done", "m", "n", "ids", (F.col("begin") + F.col("inside")).alias("at"))


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType().add(
        "doc_id", docs.schema["doc_id"].dataType
    ).add("part", "long").add("queue", "string").add("before", "long").add("n", "long").add("ids", "binary")


def pack(docs: DataFrame, target: Mapping[str, float] | None = None, length: int = LENGTH, window: int = WINDOW, name: str = VOCABULARY) -> DataFrame:
    """Pieces of documents in gapless sequences of ``length`` tokens.

    docs: (doc_id, text, source, ...). Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source).
    A document is its ids and one separator; a null or empty text is the separator alone. Queues are the sources in
    the order of their names, the null source among them as "". ``target`` gives the wanted proportions by source; without it they are
    the corpus's own, so that all queues last to the end. Only the last sequence is not full, so it alone needs padding.
    Repeated rows are packed each for itself; an empty table gives an empty result.

    Each source has its queue, however many there are: of more than QUEUES the places are worked out by rows (see _spread),
    with the same result.

    Texts are encoded once; the ids are written to the shared folder, and what follows reads them there.
    """
    spark = docs.sparkSession
    small_batches(spark)
    queue = F.coalesce("source", F.lit(""))

    def encode(batches):
        t, part = tokenizer(name), TaskContext.get().partitionId()
        kind = "<u2" if len(t.bytes_of) <= 1 << 16 else "<u4"
        before: dict[str, int] = defaultdict(int)
        for b in batches:
            rows = [np.append(t.encode(x.as_py()), np.uint32(SEPARATOR)).astype(kind) for x in b.column(1)]
            names, starts = b.column(2).to_pylist(), []
            for q, r in zip(names, rows, strict=True):
                starts.append(before[q])
                before[q] += len(r)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([part] * len(rows), pa.int64()), b.column(2), pa.array(starts, pa.int64()),
                    pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())
                ],
                names=["doc_id", "part", "queue", "before", "n", "ids"]
            )

    rows = written(docs.select("doc_id", "text", queue.alias("queue")).mapInArrow(encode, _schema(docs)), "packing")
    # each task's tokens by queue, and how many earlier tasks have before it
    held = rows.groupBy("queue", "part").agg(F.sum("n").alias("held"))
    earlier = W.Window.partitionBy("queue").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = held.select("queue", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"), "held")
    starts = written(starts, "packing-starts")
    totals = starts.groupBy("queue").agg(F.sum("held").alias("total"))
    small = starts.drop("held")
    if starts.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    placed = rows.join(small, ["queue", "part"]).select("doc_id", "queue", "base", "before", "n", "ids")
    out = T.StructType().add("doc_id", docs.schema["doc_id"].dataType)
    for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        out = out.add(c, "long")
    out = out.add("source", "string")

    def split(b, queues, pieces):
        """A batch of the result: pieces (row of b, ids, offset in them, offset in the document, length, its tokens, place) in their sequences."""
        cols, take = defaultdict(list), []
        for i, ids, off, start, m, n, at in pieces:
            while m:  # sequences end inside a window
                k = min(m, length - at % length)
                take.append(i)
                for c, v in zip(
                    ("start", "length", "crc", "n", "seq", "off"), (start, k, zlib.crc32(ids[off : off + k]), n, at // length, at % length),
                    strict=True
                ):
                    cols[c].append(v)
                off, start, m, at = off + k, start + k, m - k, at + k
        return pa.RecordBatch.from_arrays(
            [
                b.column(0).take(pa.array(take, pa.int64())), *(pa.array(cols[c], pa.int64()) for c in ("start", "length", "crc", "n", "seq", "off")),
                queues.take(pa.array(take, pa.int64()))
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        )

    def numbers(ids, n):
        return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")

    many = len(totals.select("queue").take(QUEUES + 1)) > QUEUES
    if many and target is not None:
        raise ValueError(f"a target takes at most {QUEUES} sources")
    if many:

        def sequences(batches):
            for b in batches:
                pieces = zip(range(b.num_rows), *(b.column(c).to_pylist() for c in range(2, 7)), strict=True)
                yield split(b, b.column(1), ((i, numbers(ids, m), 0, done, m, n, at) for i, done, m, n, ids, at in pieces))

        return _spread(placed, totals, length, window).mapInArrow(sequences, out)

    plan = spark.sparkContext.broadcast(Plan({r["queue"]: r["total"] for r in totals.collect()}, length * window, target))  # QUEUES rows at most

    def place(batches):
        p, last = plan.value, {}

        def pieces(b):
            for i, (q, base, before, n, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                ids = numbers(ids, n)
                found, last[q] = p.pieces(q, base + before, n, last.get(q))
                yield from ((i, ids, off, off, m, n, at) for off, m, at in found)

        for b in batches:
            yield split(b, b.column(1), pieces(b))

    return placed.mapInArrow(place, out)
