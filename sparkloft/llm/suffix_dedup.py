"""Removal of byte passages that an earlier document holds too, by suffix arrays over shards of candidate text.

A 50-byte window is named by its minimiser, the least hash of the 20-byte strings in it, so equal windows have equal
minimisers. Minimisers that only one document has are set aside first: windows under them cannot repeat. What
remains goes to buckets by minimiser, in runs of windows that share one, each different run once a document shard. There a suffix array and
common prefixes decide exactly which windows an earlier document has. Hashes only route; two strings are equal only if their bytes are.

A footer's edges stand beside other bytes in each document, so one minimiser may have as many different runs as there are documents. Such a
minimiser is hot: its windows are named one by one, by a hash of all their bytes, and those that occur once are set aside. The others go on in
runs of a second minimiser, of WIDE bytes: then few bytes of a window can be a document's own, and such windows that two documents have are few.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloft.llm.common import small_batches, trim, written

SPAN = 50
GRAM = 20
SHARD_BYTES = 4 << 20  # text aimed at in a shard of documents
SUFFIX_BYTES = 512 << 10  # text under one suffix array; sorting it takes some sixty times as much memory
SEGMENT = 1 << 16  # window starts hashed at once: their arrays stay in a core's cache
RUN = 256  # most windows in a run
HOT = 256  # different runs of a minimiser in a shard, and different sets of runs among shards, beyond which it is hot: about a shard's text
WIDE = 44  # bytes of the strings that a hot window's second minimiser is the least hash of
GROUP = 4096  # document shards from which on a bucket's text is put together by groups of so many shards first
NO_ID = np.iinfo(np.int64).max  # a null doc_id counts as larger than any other

_VALUES = "bucket long, shard int, data binary, hot binary"
_SPANS = "shard int, rows binary, offs binary, lens binary"
_FOUND = "bucket long, shard int, done boolean, lens binary, ids binary, rows binary, offs binary, data binary"


def _hashes(t: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    w = np.ndarray((len(t) - 7,), "<u8", t, strides=(1,))
    n = len(t) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += w[8 : n + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += w[GRAM - 8 : n + GRAM - 8]  # the last words overlap where GRAM is no multiple of eight
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(30)
    return h


def _minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    n, have = len(h) - width + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[: len(h) - have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[width - have : width - have + n])


class Text:
    """The texts of one document shard in the order of (doc_id, bytes), and their runs of windows."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").cast(pa.int64())
        self.ids = ids.fill_null(NO_ID).to_numpy()
        texts = [b"" if x is None else x for x in table.column("text").cast(pa.binary()).to_pylist()]
        self.order = sorted(range(len(texts)), key=lambda i: (self.ids[i], texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.ids = self.ids[self.order]
        self.bounds = np.cumsum([0, *map(len, self.texts)])
        self.data = b"".join(self.texts)

    def runs(self):
        """(first window, last window, minimiser of 48 bits, row, mark of 16 bits that equal runs share), in the order of the text."""
        t, ends = np.frombuffer(self.data, np.uint8), self.bounds[1:]
        out = []
        for a in range(0, len(t) - SPAN + 1, SEGMENT):
            part = t[a : a + SEGMENT + SPAN - 1]
            # minima crowd at low values: an odd factor spreads them over the buckets again, and keeps different ones different
            grams = _hashes(part)
            m = ((_minima(grams, SPAN - GRAM + 1) >> np.uint64(16)) * np.uint64(0x9E3779B97F4B)) & np.uint64((1 << 48) - 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams)])
            lo, hi = np.searchsorted(ends, [a, a + len(part)], "left")
            near = ends[lo : hi + 1] - a  # windows over the end of a document are none
            ok = np.ones(len(m), bool)
            over = (near[:, None] + np.arange(1 - SPAN, 0)[None]).ravel()
            ok[over[(over >= 0) & (over < len(m))]] = False
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | ~ok[:-1]
            new[near[(near >= 0) & (near < len(m))]] = True
            new &= ok
            first = np.flatnonzero(new)
            stop = new | ~ok
            last = np.append(stop[1:], True).nonzero()[0]
            last = last[ok[last]]
            if len(first) and (last - first).max() >= RUN:
                k = (last - first) // RUN + 1
                at = np.repeat(first, k) + RUN * (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
                last, first = np.minimum(np.repeat(last, k), at + RUN - 1), at
            mark = ((total[last + SPAN - GRAM + 1] - total[first]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
            out.append((first + a, last + a, m[first], mark))
        if not out:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        first, last, value, mark = (np.concatenate(x) for x in zip(*out, strict=True))
        return first, last, value, np.searchsorted(self.bounds, first, "right") - 1, mark

    def names(self, at: np.ndarray, size: int) -> np.ndarray:
        """A hash of 48 bits of the ``size`` bytes from each place."""
        t = np.frombuffer(self.data, np.uint8)
        h = np.zeros(len(at), np.uint64)
        if len(at):
            words = np.ndarray((len(t) - 7,), "<u8", t, strides=(1,))
            for o in (*range(0, size - 8, 8), size - 8):
                h = (h ^ words[at + o]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h >> np.uint64(16)

    def wide_runs(self, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows at sorted places as runs of one second minimiser: (first window, last window, minimiser, row)."""
        value = self.names(at, WIDE)
        for o in range(1, SPAN - WIDE + 1):
            value = np.minimum(value, self.names(at + o, WIDE))
        value = (value * np.uint64(0x9E3779B97F4B)) & np.uint64((1 << 48) - 1)  # minima crowd at low values
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        return at[new], at[np.append(new[1:], True)[: len(at)]], value[new], row[new]


def _each(first: np.ndarray, last: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of runs one by one: (place, row)."""
    n = last - first + 1
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(row, n)


def _of_two_rows(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The different values that two rows have."""
    order = np.lexsort((row, value))
    v, r = value[order], row[order]
    return np.unique(v[1:][(v[1:] == v[:-1]) & (r[1:] != r[:-1])])


def _within(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among the sorted ``names``."""
    if not len(names):
        return np.zeros(len(values), bool)
    return names[np.minimum(np.searchsorted(names, values), len(names) - 1)] == values


def _counted(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted values, and where each begins."""
    begin = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return sorted_values[begin], begin


def _sets_of_runs(value: np.ndarray, mark: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's different minimisers, each with 16 bits that tell its set of different runs, and those of more than ``most`` different runs."""
    both = np.unique((value << np.uint64(16)) | mark)
    names, begin = _counted(both >> np.uint64(16))
    if not len(names):
        return names, names
    mixed = (both * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
    sets = np.add.reduceat(mixed, begin) & np.uint64(0xFFFF)
    return (names << np.uint64(16)) | sets, names[np.diff(begin, append=len(both)) > most]


def _packed(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    six = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: order by the first eight bytes, then each round doubles the depth and sorts only unsettled groups.

    rank holds the last place of a suffix's group, as in their algorithm; a shorter suffix precedes a longer one with the same beginning.
    """
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    short = np.minimum(n - np.arange(max(0, n - 8), n), 8)  # the padding must not pass for bytes of the text
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    differ = k[1:] != k[:-1]
    if n:
        tail = np.zeros(n, np.int8)
        tail[max(0, n - 8) :] = 9 - short
        s = tail[sa]
        zero = np.flatnonzero(s)
        if len(zero):  # among equal keys the shorter suffixes come first
            group = np.concatenate([[0], np.cumsum(differ)])
            o = np.lexsort((-s.astype(np.int64), group))
            sa, s = sa[o], s[o]
            differ = differ | (s[1:] != s[:-1])
    ends = np.flatnonzero(np.append(differ, True)) if n else np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=-1)
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.repeat(ends, sizes)
    rank[n] = -1
    pos = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 8
    while len(pos):
        sub = sa[pos]
        both = rank[sub] * (n + 2) + rank[np.minimum(sub + h, n)] + 1
        o = np.argsort(both, kind="stable")
        sub, both = sub[o], both[o]
        sa[pos] = sub
        ends = np.flatnonzero(np.append(both[1:] != both[:-1], True))
        sizes = np.diff(ends, prepend=-1)
        rank[sub] = np.repeat(pos[ends], sizes)
        pos = pos[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, lens: np.ndarray, most: int = SPAN) -> np.ndarray:
    """Kasai: length of the prefix, up to ``most``, that each suffix shares with the one before it in the array.

    From one position to the next a common prefix loses one byte at most. The runs are independent rows of positions, so all
    of them advance side by side.
    """
    n = len(t)
    place, lcp = np.empty(n, np.int64), np.zeros(n, np.int64)
    place[sa] = np.arange(n)
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    have = np.zeros(len(starts), np.int64)
    words = np.ndarray((n + most + 1,), "<u8", np.concatenate([t, np.zeros(most + 8, np.uint8)]), strides=(1,))
    live = len(starts)
    for step in range(int(lens[0]) if len(lens) else 0):
        live = int(np.searchsorted(-lens[:live], -step, "left"))
        p = starts[:live] + step
        at = place[p]
        q = sa[at - 1]
        length = np.maximum(have[:live] - 1, 0)
        go = slice(None)
        while True:  # eight bytes at a time; the lowest differing bit tells how many of them agree
            x = words[p[go] + length[go]] ^ words[q[go] + length[go]]
            same = (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            length[go] += same
            more = (same == 8) & (length[go] < most)
            if not more.any():
                break
            go = np.flatnonzero(more) if isinstance(go, slice) else go[more]
        length = np.minimum(np.minimum(length, most), n - np.maximum(p, q))
        length[at == 0] = 0
        have[:live] = length
        lcp[at] = length
    return lcp


def _least_ids(texts: list[bytes], ids: np.ndarray):
    """Shards of texts as (first text, starts, lengths, text of each byte, least id of the window at each byte, whether one begins there)."""
    shards, lo, size = [], 0, 0
    for i, c in enumerate(texts):
        if size and size + len(c) > SUFFIX_BYTES:
            shards.append((lo, i))
            lo, size = i, 0
        size += len(c)
    if texts:
        shards.append((lo, len(texts)))
    made = []
    for a, b in shards:
        part = texts[a:b]
        t = np.frombuffer(b"".join(part), np.uint8)
        lens = np.array([len(c) for c in part], np.int64)
        starts = np.cumsum(lens) - lens
        sa = suffix_array(t)
        lcp = common_prefixes(t, sa, starts, lens)
        of = np.repeat(np.arange(len(part)), lens)
        window = (np.arange(len(t)) - starts[of]) <= lens[of] - SPAN  # other suffixes run over the end of their text
        group = np.cumsum(lcp < SPAN) - 1
        hit = window[sa]
        at, group = sa[hit], group[hit]
        number = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) if len(group) else group
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
        least = np.minimum.reduceat(ids[a:b][of[at]], begin) if len(begin) else np.zeros(0, np.int64)
        made.append([t, starts, lens, at, number, at[begin] if len(begin) else begin, least])
    for u in range(len(made)):  # windows of one shard are looked up in the sorted windows of the others
        for v in range(u):
            low, high = _sorted_windows(made[v]), _sorted_windows(made[u])
            k = np.minimum(np.searchsorted(low, high), max(len(low) - 1, 0))
            same = np.flatnonzero(low[k] == high) if len(low) and len(high) else np.zeros(0, np.int64)
            both = np.minimum(made[v][6][k[same]], made[u][6][same])
            made[v][6][k[same]] = made[u][6][same] = both
    for (a, _), (t, starts, lens, at, number, _, least) in zip(shards, made, strict=True):
        by_place, begins = np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        by_place[at] = least[number] if len(least) else 0
        begins[at] = True
        yield a, starts, lens, np.repeat(np.arange(len(starts)), lens), by_place, begins


def first_holders(texts: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each window of each text the least id among the texts that hold it. ids: one for each text."""
    return [
        least[s : s + n - SPAN + 1] for _, starts, lens, _, least, _ in _least_ids(texts, ids) for s,
        n in zip(starts.tolist(), lens.tolist(), strict=True)
    ]


def lost_spans(texts: list[bytes], ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """By text, the (start, end) that texts of a smaller id hold too; texts without such a span are left out."""
    out: dict[int, list[tuple[int, int]]] = {}
    for a, starts, _, of, least, begins in _least_ids(texts, ids):
        gone = np.flatnonzero(begins & (least < ids[a:][of]))
        if not len(gone):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(gone) > 1) | (np.diff(of[gone]) > 0)]))
        first, last = gone[new], gone[np.append(new[1:], len(gone)) - 1]
        k = of[first]
        for i, x, y in zip((k + a).tolist(), (first - starts[k]).tolist(), (last - starts[k] + SPAN).tolist(), strict=True):
            out.setdefault(i, []).append((x, y))
    return out


def _sorted_windows(shard) -> np.ndarray:
    t, first = shard[0], shard[5]
    if not len(first):
        return np.zeros(0, f"S{SPAN}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(t, SPAN)[first]).view(f"S{SPAN}").ravel()


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Merges (row, start, end) that touch."""
    out: list[tuple[int, int, int]] = []
    for r, s, e in sorted(spans):
        if out and out[-1][0] == r and s <= out[-1][2]:
            if e > out[-1][2]:
                out[-1] = (r, out[-1][1], e)
        else:
            out.append((r, s, e))
    return out


def _put(values, kind: str = "<i4") -> bytes:
    """Numbers as bytes; rows, offsets and lengths within a text fit 32 bits."""
    return np.array(values, kind).tobytes()


def _get(blobs: list[bytes | None], kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(b"".join(b or b"" for b in blobs), kind)


def _row(bucket: int, shard: int, done: bool, lens, ids, rows, offs, data: bytes) -> dict:
    return {
        "bucket": bucket, "shard": shard, "done": done, "lens": _put(lens), "ids": _put(ids, "<i8"), "rows": _put(rows), "offs": _put(offs),
        "data": data
    }


_FOUND_ARROW = pa.schema(
    [("bucket", pa.int64()), ("shard", pa.int32()), ("done", pa.bool_()), *((c, pa.binary()) for c in ("lens", "ids", "rows", "offs", "data"))]
)
_SPANS_ARROW = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("rows", "offs", "lens"))])
_VALUES_ARROW = pa.schema([("bucket", pa.int64()), ("shard", pa.int32()), ("data", pa.binary()), ("hot", pa.binary())])


def _by_bucket(value: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    """Sorted names by the highest ``bits`` of their 48."""
    bucket, begin = _counted((value >> np.uint64(48 - bits)).astype(np.int64))
    return dict(zip(bucket.tolist(), np.split(value, begin[1:]), strict=True)) if len(bucket) else {}


def _values_table(found: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    return pa.Table.from_pydict(dict(zip(_VALUES_ARROW.names, map(list, zip(*found, strict=True)), strict=True)) if found else
                                {c: [] for c in _VALUES_ARROW.names}, _VALUES_ARROW)


def _asked(shard: int, names: np.ndarray, hot: np.ndarray, bits: int) -> pa.Table:
    """What a shard asks of the buckets: its names with 16 bits each, and the hot ones among them."""
    by_name, hot_by = _by_bucket(names >> np.uint64(16), bits), _by_bucket(hot, bits)
    cut = np.cumsum([len(v) for v in by_name.values()])
    parts = np.split(names, cut[:-1]) if len(cut) else []
    return _values_table([(b, shard, v.tobytes(), _packed(hot_by.get(b, hot[:0]))) for b, v in zip(by_name, parts, strict=True)])


def _minimisers(bits: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("__shard")[0].as_py()
        text = Text(table)
        _, _, value, _, mark = text.runs()
        names, hot = _sets_of_runs(value, mark, most)
        del text, mark, value
        trim()
        return _asked(shard, names, hot, bits)

    return run


def _windows(bits: int):
    """What a shard asks about the windows of its hot minimisers."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        hot = np.sort(_unpacked([x for x in shared.column("hot").to_pylist() if x]))
        if not docs.num_rows or not len(hot):
            return _VALUES_ARROW.empty_table()
        shard, text = docs.column("__shard")[0].as_py(), Text(docs)
        first, last, value, row, _ = text.runs()
        hit = _within(value, hot)
        names = np.unique(text.names(_each(first[hit], last[hit], row[hit])[0], SPAN))
        del text, first, last, value, row
        trim()
        return _asked(shard, names << np.uint64(16), names[:0], bits)

    return run


def _names(table: pa.Table, most: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The names of each row of a bucket, those that two rows have, those that are hot, and all with their 16 bits; sorted, once each."""
    asked = [np.frombuffer(b, "<u8") for b in table.column("data").to_pylist()]
    names = [_counted(v >> np.uint64(16))[0] for v in asked]
    every = np.sort(np.concatenate(names)) if names else np.zeros(0, np.uint64)
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    sets = np.unique(np.concatenate(asked)) if asked else every
    name, begin = _counted(sets >> np.uint64(16))
    hot = np.union1d(name[np.diff(begin, append=len(sets)) > most], _unpacked(table.column("hot").to_pylist()))
    return names, twice, hot, sets


def _answers(bucket: int, shards: list[int], names: list[np.ndarray], shared: np.ndarray, hot: np.ndarray) -> pa.Table:
    """For each shard those of its names that others have or that are hot."""
    out = []
    for s, v in zip(shards, names, strict=True):
        heat = _within(v, hot)
        cold = _packed(v[_within(v, shared) & ~heat])
        if cold or heat.any():
            out.append((bucket, s, cold, _packed(v[heat])))
    return _values_table(out)


def _shared(most: int):
    """Of the names in a bucket, those that two shards have, and the hot ones, for each shard."""

    def run(table: pa.Table) -> pa.Table:
        names, twice, hot, _ = _names(table, most)
        return _answers(table.column("bucket")[0].as_py(), table.column("shard").to_pylist(), names, twice, hot)

    return run


def _together(most: int):
    """The different names of a bucket in a group of shards, as if the group were a shard; of a hot one, one set of runs stands for all."""

    def run(table: pa.Table) -> pa.Table:
        _, _, hot, sets = _names(table, most)
        name, begin = _counted(sets >> np.uint64(16))
        keep = ~_within(sets >> np.uint64(16), hot)
        keep[begin] = True
        return _values_table([(table.column("bucket")[0].as_py(), table.column("group")[0].as_py(), sets[keep].tobytes(), _packed(hot))])

    return run


def _shared_within(table: pa.Table, across: pa.Table) -> pa.Table:
    """Of the names in a bucket, those that another shard of the group or another group has, and the hot ones, for each shard of the group."""
    if not table.num_rows:
        return _VALUES_ARROW.empty_table()
    names, twice, _, _ = _names(table, HOT)
    there, hot = (np.sort(_unpacked([x or b"" for x in across.column(c).to_pylist()])) for c in ("data", "hot"))
    return _answers(table.column("bucket")[0].as_py(), table.column("shard").to_pylist(), names, np.union1d(twice, there), hot)


def _candidates(bits: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _FOUND_ARROW.empty_table()
        shard, text = docs.column("__shard")[0].as_py(), Text(docs)
        first, last, value, row, _ = text.runs()
        named, hot, alone = (np.unique(_unpacked([x or b"" for x in shared.column(c).to_pylist()])) for c in ("data", "hot", "windows"))
        heat = _within(value, hot)
        at, of = _each(first[heat], last[heat], row[heat])
        window = text.names(at, SPAN)
        again = _within(window, np.union1d(alone, _of_two_rows(window, of)))
        cold = _within(value, np.union1d(named, _of_two_rows(value, row))) & ~heat
        first, last, value, row = (
            np.concatenate([a[cold], b]) for a, b in zip((first, last, value, row), text.wide_runs(at[again], of[again]), strict=True)
        )
        hit = np.lexsort((last, first))
        seen: dict[bytes, int] = {}
        done: list[tuple[int, int, int]] = []
        sent: dict[int, list] = {}
        data, ids, base = text.data, text.ids.tolist(), text.bounds.tolist()
        row_now, from_now, to_now = -1, 0, 0
        for a, b, r, k in zip(first[hit].tolist(), last[hit].tolist(), row[hit].tolist(), (value[hit] >> np.uint64(48 - bits)).tolist(), strict=True):
            b += SPAN
            c = data[a:b]
            i = ids[r]
            if seen.setdefault(c, i) < i:  # an earlier document of this shard has all of it
                if r == row_now and a <= to_now:
                    to_now = b
                else:
                    if row_now >= 0:
                        done.append((row_now, from_now - base[row_now], to_now - base[row_now]))
                    row_now, from_now, to_now = r, a, b
            else:
                sent.setdefault(k, []).append((c, i, r, a - base[r]))
        if row_now >= 0:
            done.append((row_now, from_now - base[row_now], to_now - base[row_now]))
        out = [_row(shard, shard, True, [e - s for _, s, e in done], [], [r for r, _, _ in done], [s for _, s, _ in done], b"")] if done else []
        for k, x in sent.items():
            out.append(
                _row(
                    k, shard, False, [len(c) for c, *_ in x], [i for _, i, _, _ in x], [r for _, _, r, _ in x], [o for *_, o in x],
                    b"".join(c for c, *_ in x)
                )
            )
        found = pa.Table.from_pylist(out, _FOUND_ARROW)
        del out, sent, seen, text
        trim()
        return found

    return run


def _runs(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[tuple[int, int, int, int, int]]]:
    """The different runs of a bucket, in the order of shards, with the least id that has each; and where each stands: (shard, run, id, row, offset)."""
    index: dict[bytes, int] = {}
    texts: list[bytes] = []
    least: list[int] = []
    places = []
    for x in sorted(table.to_pylist(), key=lambda x: x["shard"]):
        at = 0
        for n, i, r, o in zip(*(_get([x[c]], "<i8" if c == "ids" else "<i4").tolist() for c in ("lens", "ids", "rows", "offs")), strict=True):
            c = x["data"][at : at + n]
            at += n
            k = index.setdefault(c, len(texts))
            if k == len(texts):
                texts.append(c)
                least.append(i)
            elif i < least[k]:
                least[k] = i
            places.append((x["shard"], k, i, r, o))
    return texts, np.array(least, np.int64), places


def _spans(
    texts: list[bytes], least: np.ndarray, places: list, lost_by_least: dict[int, list[tuple[int, int]]]
) -> dict[int, list[tuple[int, int, int]]]:
    """By shard the (row, start, end) that go: all other holders of a run lose the whole of it, the least one what others have."""
    spans: dict[int, list] = {}
    for s, k, i, r, o in places:
        if least[k] < i:
            spans.setdefault(s, []).append((r, o, o + len(texts[k])))
        elif k in lost_by_least:
            spans.setdefault(s, []).extend([(r, o + a, o + b) for a, b in lost_by_least[k]])
    return spans


def _spans_table(spans: dict[int, list[tuple[int, int, int]]], done: list[dict]) -> pa.Table:
    out = [{k: x[k] for k in ("shard", "rows", "offs", "lens")} for x in done]
    for s, x in spans.items():
        x = _joined(x)
        out.append({"shard": s, "rows": _put([r for r, _, _ in x]), "offs": _put([a for _, a, _ in x]), "lens": _put([b - a for _, a, b in x])})
    return pa.Table.from_pylist(out, _SPANS_ARROW)


def _decide(table: pa.Table) -> pa.Table:
    """Of the runs in a bucket, which bytes a document with a smaller id holds too."""
    done = table.column("done").to_numpy(zero_copy_only=False)
    texts, least, places = _runs(table.filter(pa.array(~done)))
    return _spans_table(_spans(texts, least, places, lost_spans(texts, least)), table.filter(pa.array(done)).to_pylist())


def _decide_between(table: pa.Table) -> pa.Table:
    """The same between groups of shards; the bucket comes along."""
    out = _decide(table)
    return out.add_column(0, "bucket", pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int64()))


def _gather(table: pa.Table) -> pa.Table:
    """The different runs of a bucket in a group of shards with their least ids, as if the group were a shard and each run a row."""
    texts, least, _ = _runs(table)
    bucket, group = table.column("bucket")[0].as_py(), table.column("group")[0].as_py()
    row = _row(bucket, group, False, list(map(len, texts)), least, range(len(texts)), [0] * len(texts), b"".join(texts))
    return pa.Table.from_pylist([row], _FOUND_ARROW)


def _hand_out(table: pa.Table, across: pa.Table) -> pa.Table:
    """What the shards of a group lose in a bucket, from what the group's runs lose to other runs of the bucket."""
    if not table.num_rows:
        return _SPANS_ARROW.empty_table()
    done = table.column("done").to_numpy(zero_copy_only=False)
    texts, least, places = _runs(table.filter(pa.array(~done)))
    lost: dict[int, list[tuple[int, int]]] = {}
    for k, a, n in zip(*(_get(across.column(c).to_pylist()).tolist() for c in ("rows", "offs", "lens")), strict=True):
        lost.setdefault(k, []).append((a, a + n))
    return _spans_table(_spans(texts, least, places, lost), table.filter(pa.array(done)).to_pylist())


def _lost(docs: pa.Table, spans: pa.Table):
    """The shard's text and each row's removed (start, end), merged."""
    text = Text(docs)
    rows, offs, lens = (_get(spans.column(c).to_pylist()) for c in ("rows", "offs", "lens"))
    lost: list[list[tuple[int, int]]] = [[] for _ in text.texts]
    for r, a, b in _joined(list(zip(rows.tolist(), offs.tolist(), (offs + lens).tolist(), strict=True))):
        lost[r].append((a, b))
    return text, lost


def _kept(data: bytes, lost: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in lost:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def _digest(docs: pa.Table, spans: pa.Table) -> pa.Table:
    cols = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    if not docs.num_rows:
        return pa.schema(list(cols.items())).empty_table()
    text, lost = _lost(docs, spans)
    out = {
        "doc_id": docs.column("doc_id").take(pa.array(text.order, pa.int64())), "n_bytes": [len(x) for x in text.texts],
        "n_removed": [sum(b - a for a, b in x) for x in lost], "n_spans": [len(x) for x in lost],
        "kept_sha256": [hashlib.sha256(_kept(t, x)).hexdigest() for t, x in zip(text.texts, lost, strict=True)]
    }
    return pa.Table.from_pydict(out, pa.schema(list(cols.items())))


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    docs_out = docs.drop_columns(["__shard"])
    if not docs.num_rows:
        return docs_out
    text, lost = _lost(docs, spans)
    docs_out = docs_out.take(pa.array(text.order, pa.int64()))
    at = docs_out.schema.get_field_index("text")
    before = docs_out.column(at).to_pylist()
    # a passage may begin or end inside a character: what is left of such a character goes too
    texts = [b if not x else _kept(t, x).decode("utf-8", "ignore") for b, t, x in zip(before, text.texts, lost, strict=True)]
    docs_out = docs_out.set_column(at, docs_out.schema.field(at), pa.chunked_array([pa.array(texts, docs_out.schema.field(at).type)]))
    n = docs_out.schema.get_field_index("n_chars")
    if n >= 0:
        sizes = [len(t) if x else v for t, x, v in zip(texts, lost, docs_out.column(n).to_pylist(), strict=True)]
        docs_out = docs_out.set_column(n, docs_out.schema.field(n), pa.chunked_array([pa.array(sizes, docs_out.schema.field(n).type)]))
    return docs_out


def _removed(docs: DataFrame):
    """``docs`` dealt into shards of documents, and the spans that each shard loses.

    Shards and buckets grow in number with the text, so what one task holds does not. The runs of one minimiser are at most HOT sets of HOT
    different runs; of a minimiser of more only windows that two documents have go on, by second minimisers. A string that very many shards have, as
    boilerplate does, meets in two steps where there are more than GROUP shards: each group of shards puts its own together first, the
    bucket decides between groups, and each group hands the answer to its shards.
    """
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(1, math.ceil(((size or 0) + 64 * rows) / SHARD_BYTES))
    bits = min(48, max(4, math.ceil(math.log2(shards)) + 2))  # buckets of about as much candidate text as one suffix array takes
    small_batches(docs.sparkSession)
    whole = docs.withColumn("__shard", F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(shards)).cast("int"))
    group = F.floor(F.col("shard") / GROUP).cast("int").alias("group")

    def answered(asked: DataFrame, name: str) -> DataFrame:
        if shards <= GROUP:
            return asked.groupBy("bucket").applyInArrow(_shared(HOT), _VALUES)
        asked = written(asked.select("*", group), name)
        across = asked.groupBy("bucket", "group").applyInArrow(_together(HOT), _VALUES).groupBy("bucket").applyInArrow(_shared(HOT), _VALUES)
        return asked.groupBy("bucket", "group").cogroup(across.groupBy("bucket", "shard")).applyInArrow(_shared_within, _VALUES)

    shared = answered(whole.groupBy("__shard").applyInArrow(_minimisers(bits, HOT), _VALUES), "minimisers")
    hot = shared.where(F.octet_length("hot") > 0).select("shard", "hot")
    windows = answered(whole.groupBy("__shard").cogroup(hot.groupBy("shard")).applyInArrow(_windows(bits), _VALUES), "windows")
    shared = shared.select("shard", "data", "hot", F.lit(None).cast("binary").alias("windows")).unionByName(
        windows.select("shard", F.lit(None).cast("binary").alias("data"), F.lit(None).cast("binary").alias("hot"), F.col("data").alias("windows"))
    )
    found = whole.groupBy("__shard").cogroup(shared.groupBy("shard")).applyInArrow(_candidates(bits), _FOUND)
    if shards > GROUP:
        found = written(found.select("*", group), "runs")
        across = found.where("not done").groupBy("bucket", "group").applyInArrow(_gather, _FOUND).groupBy("bucket").applyInArrow(
            _decide_between, f"bucket long, {_SPANS}"
        )
        spans = found.groupBy("bucket", "group").cogroup(across.groupBy("bucket", "shard")).applyInArrow(_hand_out, _SPANS)
    else:
        spans = found.groupBy("bucket").applyInArrow(_decide, _SPANS)
    return whole, spans


def passage_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text, ...).

    A byte goes if a SPAN-byte string over it, in the same text, also starts in a document with a smaller doc_id; all judged
    on the texts as given. A null text counts as empty. Null doc_ids are larger than all others and equal to each other; rows
    that repeat a doc_id are not smaller than each other, so they do not cut one another. An empty table gives an empty result.
    """
    whole, spans = _removed(docs.select("doc_id", "text"))
    return whole.groupBy("__shard").cogroup(spans.groupBy("shard")).applyInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with those passages taken out of text, and n_chars, where there is one, brought up to date.

    All rows and other columns stay. A passage counts in bytes; of a character that it cuts apart nothing stays.
    """
    whole, spans = _removed(docs)
    return whole.groupBy("__shard").cogroup(spans.groupBy("shard")).applyInArrow(_cut, T.StructType(docs.schema.fields))
