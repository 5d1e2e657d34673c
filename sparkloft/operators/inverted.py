"""Texts turned into postings within their own task: words of an Arrow batch are grouped by number, so no word meets another task for it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

ROWS = "term string, run long, blk long, n int, docs binary, ids array<string>, dls array<int>"
_ROWS_A_BATCH = 20_000


def _numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of words: the different words, and of each word its number, its row and its place in it."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = words.flatten().dictionary_encode()
    starts = np.cumsum(sizes) - sizes
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(starts, sizes)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lists(firsts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(firsts, len(values)), pa.int32()), values)


def places(rows: DataFrame) -> DataFrame:
    """(term, chunk_id, field, places) of rows (chunk_id, field, w): the places of each word of a row."""

    def run(batches):
        for b in batches:
            words, number, row, at = _numbered(b.column(2))
            order = np.argsort(number * b.num_rows + row, kind="stable")
            number, row, at = number[order], row[order], at[order]
            f = _firsts(number, row)
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(number[f])), b.column(0).take(pa.array(row[f])), b.column(1).take(pa.array(row[f])), _lists(f, pa.array(at, pa.int32()))],
                names=["term", "chunk_id", "field", "places"]
            )

    return rows.select("chunk_id", "field", "w").mapInArrow(run, "term string, chunk_id string, field int, places array<int>")


def _whole(batches: Iterable[pa.RecordBatch], key: Callable[[pa.Table], np.ndarray]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each key; equal keys are neighbours."""
    left = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if left is None else pa.concat_tables([left, t])
        if t.num_rows:
            cut = int(_firsts(key(t))[-1])
            if cut:
                yield t.slice(0, cut)
            left = t.slice(cut)
    if left is not None and left.num_rows:
        yield left


def _same(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the values are."""
    found = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return (found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found).indices.to_numpy(zero_copy_only=False)


def _array(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def _counts(t: pa.Table, *keys: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of neighbouring rows with equal keys together: words, and by word and its document: number, document, count; first rows of documents."""
    begins = _firsts(*keys)
    words, number, row, _ = _numbered(_array(t["w"]))
    doc = np.searchsorted(begins, row, side="right") - 1
    order = np.argsort(number * len(begins) + doc, kind="stable")
    number, doc = number[order], doc[order]
    f = _firsts(number, doc)
    return words, number[f], doc[f], np.diff(np.append(f, len(number))), begins


def counts(rows: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl) of rows (chunk_id, dl, w) in which equal ids are neighbours of one task; rows of an id count together, dl is their least."""

    def run(batches):
        for t in _whole(batches, lambda t: _same(t["chunk_id"])):
            words, number, doc, tf, begins = _counts(t, _same(t["chunk_id"]))
            dl = np.minimum.reduceat(t["dl"].to_numpy(), begins)
            ids = _array(t["chunk_id"]).take(pa.array(begins[doc]))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(number)), ids, pa.array(tf, pa.int64()), pa.array(dl[doc], pa.int32())], names=["term", "chunk_id", "tf", "dl"])

    return rows.select("chunk_id", "dl", "w").mapInArrow(run, "term string, chunk_id string, tf long, dl int")


def blocks(rows: DataFrame) -> DataFrame:
    """(term, blk, docs) of rows (chunk_id, blk, dl, w) in the order of blk, each block in one task: the chunks of a block that hold a word."""

    def run(batches):
        for t in _whole(batches, lambda t: t["blk"].to_numpy()):
            blk, dl = t["blk"].to_numpy(), t["dl"].to_numpy()
            words, number, doc, tf, begins = _counts(t, blk, dl, _same(t["chunk_id"]))
            first = begins[doc]
            g = _firsts(number, blk[first])
            ids = _array(t["chunk_id"]).take(pa.array(first))
            docs = pa.StructArray.from_arrays([ids, pa.array(tf, pa.int32()), pa.array(dl[first], pa.int32())], names=["chunk_id", "tf", "dl"])
            yield pa.RecordBatch.from_arrays([words.take(pa.array(number[g])), pa.array(blk[first][g], pa.int64()), _lists(g, docs)], names=["term", "blk", "docs"])

    return rows.select("chunk_id", "blk", "dl", "w").mapInArrow(run, "term string, blk long, docs array<struct<chunk_id: string, tf: int, dl: int>>")


def _bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 0 or more in 7 bits a byte, low bits first, the last byte below 128; and the length of each."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 35, 7):
        sizes += values >= 1 << bits
    out, at = np.zeros(sizes.sum(), np.uint8), np.cumsum(sizes) - sizes
    for i in range(5):
        here = sizes > i
        out[at[here] + i] = ((values[here] >> 7 * i) & 127) | np.where(sizes[here] > i + 1, 128, 0)
    return out, sizes


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of such bytes, and how many of them end before each byte and the end."""
    last = data < 128
    ended = np.append(0, np.cumsum(last))
    starts = np.flatnonzero(np.append(True, last[:-1]))
    shift = np.arange(len(data)) - starts[ended[:-1]]
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * shift, starts), ended


def _docs(term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of postings by term and number of chunk: first of each term, how many, and their bytes: steps between numbers, then counts if any is not 1."""
    f = _firsts(term)
    n = np.diff(np.append(f, len(term)))
    steps = np.diff(doc, prepend=0)
    steps[f] = doc[f]
    many = np.maximum.reduceat(tf, f) > 1 if len(f) else np.zeros(0, bool)
    sizes = np.where(many, 2 * n, n)
    begins = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(f)), n)
    place = begins[of] + np.arange(len(term)) - f[of]
    values = np.empty(sizes.sum(), np.int64)
    values[place] = steps
    values[(place + n[of])[many[of]]] = tf[many[of]]
    data, length = _bytes(values)
    ends = np.append(0, np.cumsum(length))[np.append(begins, len(values))]
    return f, n, pa.Array.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _read(docs: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of such bytes with n postings each: row, number of chunk and count of every posting."""
    docs = docs.cast(pa.binary())
    at = np.frombuffer(docs.buffers()[1], np.int32)[docs.offset : docs.offset + len(docs) + 1]
    values, ended = _numbers(np.frombuffer(docs.buffers()[2], np.uint8)[at[0] : at[-1]])
    begins = ended[at - at[0]]
    row = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = begins[row] + np.arange(len(row)) - first[row]
    steps = values[place]
    many = (np.diff(begins) > n)[row]
    tf = np.ones(len(row), np.int64)
    tf[many] = values[(place + n[row])[many]]
    doc = np.cumsum(steps)
    return row, doc - (doc - steps)[first[row]], tf


class _Run:
    """Chunks of a task until they are written: their ids and lengths, and the words of each with their counts."""

    def __init__(self):
        self.ids, self.dls, self.words, self.counts = [], [], [], []
        self.chunks = self.tokens = self.different = 0

    def add(self, ids: pa.Array, dls: np.ndarray, words: pa.Array, number: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> None:
        """``number`` and ``doc``: of each posting its place in ``words`` and in ``ids``."""
        self.counts.append([(number + self.different).astype(np.int32), (doc + self.chunks).astype(np.int32), tf.astype(np.int32)])
        self.ids.append(ids.cast(pa.string()))
        self.dls.append(dls.astype(np.int32))
        self.words.append(words.cast(pa.string()))
        self.chunks += len(ids)
        self.different += len(words)
        self.tokens += int(dls.sum())

    def batches(self, first: int, block: int) -> Iterator[pa.RecordBatch]:
        """Blocks of chunks from number ``first`` on, those of like length together; then the words in their order."""
        dls = np.concatenate(self.dls)
        order = np.argsort(dls, kind="stable")
        begins = np.arange(0, self.chunks, block)
        ids = pa.concat_arrays(self.ids).take(pa.array(order))
        made = [pa.nulls(len(begins), pa.string()), pa.array(np.full(len(begins), first)), pa.array(first + np.arange(len(begins)))]
        made += [pa.array(np.diff(np.append(begins, self.chunks)), pa.int32()), pa.nulls(len(begins), pa.binary()), _lists(begins, ids), _lists(begins, pa.array(dls[order]))]
        yield from _slices(made)

        place = np.empty(self.chunks, np.int64)
        place[order] = np.arange(self.chunks)
        words = pa.concat_arrays(self.words).dictionary_encode()
        by = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        number, doc, tf = (np.concatenate(x) for x in zip(*self.counts, strict=True))
        self.counts.clear()
        key = rank[words.indices.to_numpy(zero_copy_only=False)[number]] * self.chunks + place[doc]
        order = np.argsort(key, kind="stable")
        term, doc = np.divmod(key[order], self.chunks)
        tf = tf[order]
        del number, key, order
        f, n, docs = _docs(term, doc, tf)
        made = [words.dictionary.take(pa.array(by[term[f]])), pa.array(np.full(len(f), first)), pa.nulls(len(f), pa.int64()), pa.array(n, pa.int32()), docs]
        yield from _slices(made + [pa.nulls(len(f), pa.list_(pa.string())), pa.nulls(len(f), pa.list_(pa.int32()))])


def _slices(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=["term", "run", "blk", "n", "docs", "ids", "dls"])
    for i in range(0, whole.num_rows, _ROWS_A_BATCH):
        yield whole.slice(i, _ROWS_A_BATCH)


def _runs(parts: Iterable[tuple], tokens: int, block: int) -> Iterator[pa.RecordBatch]:
    first, made = TaskContext.get().partitionId() << 33, _Run()
    for ids, dls, *words in parts:
        if made.chunks and made.tokens + int(dls.sum()) > tokens:
            yield from made.batches(first, block)
            first, made = first - (-made.chunks // block), _Run()
        made.add(ids, dls, *words)
    if made.chunks:
        yield from made.batches(first, block)


def runs(rows: DataFrame, tokens: int, block: int) -> DataFrame:
    """``ROWS`` of rows (chunk_id, w), without a shuffle or a sort of texts: each task writes its chunks in runs of about ``tokens`` words.

    A run has a row for each block of its chunks (no term; ids and lengths) and one for each of its words: the chunks that hold it, as numbers within
    the run. A run is named by the number of its first block.
    """

    def run(batches):
        def parts():
            for whole in batches:
                sizes = pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
                cuts = _firsts(np.cumsum(sizes, dtype=np.int64) // max(1, tokens // 8))
                for i, n in zip(cuts, np.diff(np.append(cuts, whole.num_rows)), strict=True):
                    b = whole.slice(i, n)
                    words, number, row, _ = _numbered(b.column(1))
                    order = np.argsort(number * b.num_rows + row, kind="stable")
                    number, row = number[order], row[order]
                    f = _firsts(number, row)
                    yield b.column(0), sizes[i : i + n], words, number[f], row[f], np.diff(np.append(f, len(number)))

        yield from _runs(parts(), tokens, block)

    return rows.select("chunk_id", "w").mapInArrow(run, ROWS)


def opened(rows: DataFrame, bits: int) -> DataFrame:
    """(term, segment, blk, n, tf, docs) of rows (term, segment, run, n, docs): the chunks of a block of ``1 << bits`` that hold a word, their number and largest count."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                row, doc, tf = _read(b.column(4), b.column(3).to_numpy())
                blk = b.column(2).to_numpy()[row] + (doc >> bits)
                f = _firsts(row, blk)
                docs = pa.StructArray.from_arrays([pa.array(doc & (1 << bits) - 1, pa.int32()), pa.array(tf, pa.int32())], names=["at", "tf"])
                first = pa.array(row[f])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(first), b.column(1).take(first), pa.array(blk[f]), pa.array(np.diff(np.append(f, len(row))), pa.int32()),
                     pa.array(np.maximum.reduceat(tf, f), pa.int32()), _lists(f, docs)],
                    names=["term", "segment", "blk", "n", "tf", "docs"]
                )

    return rows.select("term", "segment", "run", "n", "docs").mapInArrow(run, "term string, segment int, blk long, n int, tf int, docs array<struct<at: int, tf: int>>")


def packed(rows: DataFrame) -> DataFrame:
    """(unit, packed) of rows (unit, term, n, docs) of which equal units are neighbours: many rows as one compressed value, so that a shuffle of them is small."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            if b.num_rows:
                f = _firsts(_same(pa.chunked_array([b.column(0)])))
                values = []
                for i, n in zip(f, np.diff(np.append(f, b.num_rows)), strict=True):
                    piece, sink = b.select(["term", "n", "docs"]).slice(i, n), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, piece.schema, options=options) as out:
                        out.write_batch(piece)
                    values.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(f)), pa.array(values, pa.binary())], names=["unit", "packed"])

    return rows.select("unit", "term", "n", "docs").mapInArrow(run, "unit string, packed binary")


def joined(rows: DataFrame, tokens: int, block: int) -> DataFrame:
    """``ROWS`` of runs made of others: rows (unit, doc, dl, chunk_id, packed) in the order of unit, each unit in one task.

    A unit has the chunks that stay (``doc``: the number so far), then its words, ``packed``. Postings of other chunks go.
    """

    def run(batches):
        def parts():
            for t in _whole(batches, lambda t: _same(t["unit"])):
                f = _firsts(_same(t["unit"]))
                for i, n in zip(f, np.diff(np.append(f, t.num_rows)), strict=True):
                    unit = t.slice(i, n)
                    stay = unit.filter(pc.is_null(unit["packed"]))
                    if not stay.num_rows:
                        continue
                    dls, ids, at = stay["dl"].to_numpy(), _array(stay["chunk_id"]), stay["doc"].to_numpy()
                    words = [pa.ipc.open_stream(x).read_all() for x in unit["packed"].drop_null().to_pylist()]
                    if not words:  # texts without a word
                        none = np.zeros(0, np.int64)
                        yield ids, dls, pa.array([], pa.string()), none, none, none
                        continue
                    words = pa.concat_tables(words)
                    number, doc, tf = _read(_array(words["docs"]), words["n"].to_numpy())
                    place = np.full(max(at.max(), doc.max()) + 1, -1)
                    place[at] = np.arange(len(at))
                    kept = place[doc] >= 0
                    yield ids, dls, _array(words["term"]), number[kept], place[doc[kept]], tf[kept]

        yield from _runs(parts(), tokens, block)

    return rows.select("unit", "doc", "dl", "chunk_id", "packed").mapInArrow(run, ROWS)
