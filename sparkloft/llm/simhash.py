"""SimHash near-dedup: a vantage-point tree splits the fingerprints into shards that are searched exactly."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloft.llm.common import checkpointed, connected_components, small_batches, written

SHINGLE = 3
RADIUS = 3
SHARD = 65536  # fingerprints aimed at in a shard: a few seconds of search, and each level of shards sends three in ten twice
LEAF = 768  # fingerprints below which a shard's own tree compares all
SAMPLE = 8192  # fingerprints that set the thresholds of the upper nodes, twice as many for each level from the ninth on
MOST_SAMPLED = 1 << 18  # and at most
BROADCAST_ROWS = 200_000  # sizes of overfull shards (16 bytes each) that are broadcast at most
MAX_LEVELS = 40
BLOCK = 1 << 20  # words hashed at once

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text; 0 for a null text or one without words."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)] + [b""] * (SHINGLE - 1)
        shingles = iter(words[:1])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        n = len(words) - SHINGLE + 1
    counts = np.zeros((8, 8), np.int64)
    digest, left = xxhash.xxh64_intdigest, n
    while left:
        m = min(left, BLOCK)
        h = np.fromiter(
            (digest(s, 42) for s, _ in zip(shingles, range(m), strict=False)) if m < left else (digest(s, 42) for s in shingles), np.uint64, m
        )
        octets = h.astype("<u8").view(np.uint8).reshape(m, 8)
        for i in range(8):
            counts[i] += np.bincount(octets[:, i], minlength=256) @ _BITS
        left -= m
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def vantage(node: np.ndarray) -> np.ndarray:
    """Vantage point of each node of the upper tree: a fixed mix of its number, so no table of points is sent."""
    z = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def balance(d: np.ndarray) -> int:
    """Threshold t at which the near side with its visitors (d <= t + RADIUS) and the far side (d > t) are closest in size."""
    c = np.cumsum(np.bincount(d, minlength=65 + RADIUS))
    return int(np.argmin([abs(int(c[min(t + RADIUS, 64)]) - int(c[-1] - c[t])) for t in range(64)]))


def split(fp: np.ndarray, point, t, visits: np.ndarray, bit: np.uint64):
    """One node: index arrays of its near and far side, and the visit marks on the near side.

    By the triangle inequality a pair within RADIUS that the threshold parts has its far end within
    t + RADIUS of the point: that end also visits the near side, and ``bit`` marks it there.
    Two entries with a common mark meet again on the far side, so only pairs without one count:
    each pair is looked at in exactly one leaf.
    """
    d = np.bitwise_count(fp ^ point)
    home, far = np.flatnonzero(d <= t), np.flatnonzero(d > t)
    guests = far[(d[far] <= (t[far] if isinstance(t, np.ndarray) else t) + RADIUS)]
    return home, far, guests, np.concatenate([visits[home], visits[guests] | bit])


def thresholds(sample: np.ndarray) -> dict[int, int]:
    """Thresholds of the upper nodes, from a bounded sample of fingerprints; other nodes take that of random bits."""
    out, todo = {}, [(0, sample, 0)]
    while todo:
        node, fp, level = todo.pop()
        if len(fp) < 32 or level >= MAX_LEVELS:
            continue
        d = np.bitwise_count(fp ^ vantage(np.array([node]))[0])
        out[node] = t = balance(d)
        todo += [(2 * node + 1, fp[d <= t + RADIUS], level + 1), (2 * node + 2, fp[d > t], level + 1)]
    return out


def route(fp: np.ndarray, levels: int, known: dict[int, int]):
    """Shards that each fingerprint lives in or visits: (row, shard, visit marks)."""
    row, node, visits = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.uint64)
    for level in range(levels):
        ids, at = np.unique(node, return_inverse=True)
        t = np.array([known.get(int(i), 30) for i in ids])[at]
        home, far, guests, marks = split(fp[row], vantage(node), t, visits, np.uint64(1 << level))
        near = np.concatenate([home, guests])
        row, visits, node = np.concatenate([row[near], row[far]]), np.concatenate([marks, visits[far]]), np.concatenate(
            [2 * node[near] + 1, 2 * node[far] + 2]
        )
    return row, node, visits


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers the labels of linked entries to a common one."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label != (flat := label[label])).any():
            label[:] = flat
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]


def search(fp: np.ndarray, visits: np.ndarray) -> np.ndarray:
    """Labels of the components that the links within one shard make, by a vantage-point tree of its own."""
    label, rng = np.arange(len(fp)), np.random.default_rng(7)
    todo = [(label.copy(), visits, 0)]
    while todo:
        at, marks, level = todo.pop()
        f = fp[at]
        if len(at) > LEAF and level < 24:
            point = f[rng.integers(len(at))]
            t = balance(np.bitwise_count(f ^ point))
            home, far, guests, near_marks = split(f, point, t, marks, np.uint64(1 << (MAX_LEVELS + level)))
            near = np.concatenate([home, guests])
            if max(len(near), len(far)) < 0.9 * len(at):
                todo += [(at[near], near_marks, level + 1), (at[far], marks[far], level + 1)]
                continue
        for k in range(0, len(at), 256):
            i, j = np.nonzero(np.bitwise_count(f[k : k + 256, None] ^ f[None, k:]) <= RADIUS)
            ok = (j > i) & ((marks[k + i] & marks[k + j]) == 0)
            _merge(label, at[k + i[ok]], at[k + j[ok]])
    return label


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["rep", "visits"], ignore_index=True)  # the smallest id of a component is its label
    label = search(pdf["fp"].to_numpy().view(np.uint64), pdf["visits"].to_numpy().view(np.uint64))
    rep = pdf["rep"].to_numpy()
    found = label != np.arange(len(label))
    return pd.DataFrame({"src": rep[found], "dst": rep[label[found]]}).drop_duplicates()


def _blocks(shards: DataFrame) -> DataFrame:
    """Overfull shards (fingerprints too close together for the vantage points to part) as pairs of blocks: (..., low, high).

    A fingerprint of an overfull shard goes to every pair that its block is in, so each two fingerprints still meet and no task holds
    more than two blocks.
    """
    full = shards.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * SHARD)
    full = checkpointed(full.select("shard", F.ceil(F.col("n") / SHARD).cast("int").alias("blocks")))
    n = full.count()
    if not n:
        return shards.withColumns({"low": F.lit(0), "high": F.lit(0)})
    dealt = shards.join(F.broadcast(full) if n <= BROADCAST_ROWS else full, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    return dealt.select("shard", "fp", "rep", "visits", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id long, text string; more columns are ignored).

    Fingerprints are those of the whole text; equal ones are one node, so copies cost one comparison.
    Nodes within RADIUS bits are linked, component_id is the smallest doc_id reachable.
    A null or wordless text has fingerprint zero and links like any other. A null doc_id takes part as
    a copy of its fingerprint but names no component: its component_id is null if no numbered document shares it
    directly or through links. Rows that repeat a doc_id each get a row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    prints = written(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    # a fingerprint that only rows without an id have cannot be named, so it links with nothing
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    n = nodes.count()
    levels = max(0, min(MAX_LEVELS - 1, math.ceil(math.log(max(n, 1) / SHARD) / math.log(1 / 0.65)))) if n > SHARD else 0
    known: dict[int, int] = {}
    if levels:
        size = min(MOST_SAMPLED, SAMPLE << max(0, levels - 8))
        sample = [r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).collect()]
        known = thresholds(np.array(sample, np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(known)

    def routed(batches):
        for pdf in batches:
            row, shard, visits = route(pdf["fp"].to_numpy().view(np.uint64), levels, sent.value)
            yield pd.DataFrame({"shard": shard, "fp": pdf["fp"].to_numpy()[row], "rep": pdf["rep"].to_numpy()[row], "visits": visits.view(np.int64)})

    shards = nodes.mapInPandas(routed, "shard long, fp long, rep long, visits long")
    if levels:
        shards = _blocks(written(shards, "simhash-shards"))  # routed once, read twice
    else:
        shards = shards.withColumns({"low": F.lit(0), "high": F.lit(0)})
    parts = connected_components(shards.groupBy("shard", "low", "high").applyInPandas(_links, "src long, dst long"))
    named = nodes.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose group holds a smaller doc_id; all columns stay as they are.

    Rows without a doc_id stay. Of rows that repeat a doc_id all stay or none.
    """
    gone = simhash_groups(docs).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
