"""Merkle manifest of a corpus: leaves are ranked by digit histograms of their ids, and ranks are the keys of a trie of fan-out 8."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.llm.common import checkpointed, written
from sparkloft.operators.ordered import running_total

FANOUT = 8
LEVELS = 3  # levels of the trie that one task folds at once: a group is 512 neighbours in rank
DIGIT = 10  # bits of a digit of doc_id: a window of a histogram has at most 1024 rows
BROADCAST_BYTES = 8 << 20  # of the languages' names, counted, up to which they are broadcast
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "g long, idx long, digest binary, left int"
_PATHS = "g long, idx long, path array<struct<before: string, after: string>>, subroot binary, root binary"
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _leaf(values: dict[str, Column]) -> Column:
    """Digest of a row: each field as `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    parts = []
    for name in FIELDS:
        v = values[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, digest, tampered): a leaf for each row, and the one that its lower-cased text would have where 3 divides the id's CRC."""
    own = {name: F.col(name) for name in FIELDS}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    folded = own | {"text": F.translate("text", upper, upper.lower())}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select("doc_id", "lang", _leaf(own).alias("digest"), F.when(hit, _leaf(folded)).alias("tampered"))


def _depth(n: Column) -> Column:
    """Levels of fan-out 8 over n leaves."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda k: F.pow(F.lit(float(FANOUT)), k) < n))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, lang, digest, ...) with g (place of the language), idx (place in it, from 0) and left (levels above the leaves).

    A rank is the number of rows in histogram cells before the row's, digit by digit of doc_id, plus its place in its own cell.
    The lowest cells hold 1024 ids; each histogram is summed from the one below, and each of its windows has at most 1024 rows,
    so nothing is sorted as a whole. Languages ascend by bytes, null first. Null ids come first; equal ids are ordered by their
    leaves, and equal leaves are interchangeable. Rows that repeat one id meet in one sorted window.
    """
    langs = rows.groupBy("lang").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    langs = running_total(langs, ("lang",), "one").select(F.col("lang").alias("__lang"), F.col("before").cast("long").alias("g"), _depth(F.col("n")).alias("left"))
    size = langs.agg(F.sum(F.coalesce(F.octet_length("__lang"), F.lit(0)) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        langs = F.broadcast(langs)
    low = -(1 << 63)
    keyed = rows.join(langs, F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang").withColumn("__key", F.coalesce("doc_id", F.lit(low).cast("long")))
    ends = keyed.agg(F.min("__key"), F.max("__key")).first()
    cells, shift = [checkpointed(keyed.groupBy("g", F.shiftright("__key", DIGIT).alias("cell")).agg(F.count("*").alias("n")))], DIGIT
    while ends[0] is not None and (ends[1] >> shift) - (ends[0] >> shift) >= 1 << DIGIT:
        shift += DIGIT
        cells.append(cells[-1].groupBy("g", F.shiftright("cell", DIGIT).alias("cell")).agg(F.sum("n").alias("n")))
    inside = W.Window.partitionBy("g", "up").orderBy("cell").rowsBetween(W.Window.unboundedPreceding, -1)
    start = None
    for level in reversed(cells):
        up = F.lit(0) if start is None else F.shiftright("cell", DIGIT)
        here = level.withColumn("up", up).withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        if start is not None:
            above = start.select("g", F.col("cell").alias("up"), F.col("start").alias("base"))
            here = here.join(above, ["g", "up"]).withColumn("start", F.col("base") + F.col("start"))
        start = here.select("g", "cell", "start")
    inside = W.Window.partitionBy("g", "cell").orderBy(F.asc_nulls_first("doc_id"), "digest", "tampered")
    placed = keyed.withColumn("cell", F.shiftright("__key", DIGIT)).join(start, ["g", "cell"])
    return placed.withColumn("idx", F.col("start") + F.row_number().over(inside) - 1).drop("__key", "cell", "start")


def _hash(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _above(row: list[str], levels: int) -> Iterator[list[str]]:
    """The row of a group's nodes in hex, and the rows above it."""
    yield row
    for _ in range(levels):
        row = [_hash("".join(row[i : i + FANOUT]).encode()) for i in range(0, len(row), FANOUT)]
        yield row


def _group() -> Column:
    return F.shiftright("idx", 3 * LEVELS).alias("up")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Node tables from the leaves up, LEVELS at a time, until each tree is one node."""

    def fold(key, t):
        g, up, left = (k.as_py() for k in key)
        row = [d.hex() for d in t.sort_by("idx").column("digest").to_pylist()]
        levels = min(LEVELS, left)
        for top in _above(row, levels):
            pass
        (only,) = top
        return pa.table({"g": [g], "idx": [up], "digest": [bytes.fromhex(only)], "left": pa.array([left - levels], pa.int32())})

    tables = [nodes]
    while len(tables) == 1 or tables[-1].agg(F.max("left")).first()[0]:
        below = tables[-1].select("g", "idx", "digest", "left", _group())
        tables.append(checkpointed(below.groupBy("g", "up", "left").applyInArrow(fold, _NODES)))
    return tables


def _paths(nodes: pa.Table, above: pa.Table):
    """For each node of a group: (its hex, the siblings before and after it at each level up to the root)."""
    nodes = nodes.sort_by("idx")
    row = [d.hex() for d in nodes.column("digest").to_pylist()]
    rest = [(s["before"], s["after"]) for s in above.column("path")[0].as_py()]
    rows = list(_above(row, min(LEVELS, nodes.column("left")[0].as_py())))[:-1]
    sides = []
    for level in rows:
        runs = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
        sides.append([("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))])
    for i, digest in enumerate(row):
        yield digest, [side[i // FANOUT**k] for k, side in enumerate(sides)] + rest


def _descend(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of ``nodes`` from those of the nodes LEVELS above them."""

    def spread(nodes, above):
        path = [[{"before": b, "after": a} for b, a in steps] for _, steps in _paths(nodes, above)]
        nodes, n = nodes.sort_by("idx"), len(path)
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        tops = [pa.array([above.column(c)[0].as_py()] * n, pa.binary()) for c in ("subroot", "root")]
        return pa.table([nodes.column("g"), nodes.column("idx"), pa.array(path, kind), *tops], names=["g", "idx", "path", "subroot", "root"])

    nodes = nodes.select("g", "idx", "digest", "left", _group())
    return checkpointed(nodes.groupBy("g", "up").cogroup(paths.groupBy("g", "idx")).applyInArrow(spread, _PATHS))


def _proofs(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """The result: each leaf's proof, and the root that follows from its tampered or own digest and its siblings."""

    def prove(leaves, above):
        order = leaves.sort_by("idx")
        subroot, root = (above.column(c)[0].as_py().hex() for c in ("subroot", "root"))
        proofs, folded = [], []
        for (digest, steps), tampered in zip(_paths(leaves, above), order.column("tampered").to_pylist(), strict=True):
            proofs.append(_hash("".join(b + a for b, a in steps).encode()))
            node = digest if tampered is None else tampered.hex()
            for before, after in steps:
                node = _hash(f"{before}{node}{after}".encode())
            folded.append(node)
        n = order.num_rows
        return pa.table({
            "doc_id": order.column("doc_id"), "leaf": [d.hex() for d in order.column("digest").to_pylist()], "subroot": [subroot] * n,
            "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]
        })

    leaves = leaves.select("g", "idx", "doc_id", "digest", "tampered", "left", _group())
    return leaves.groupBy("g", "up").cogroup(paths.groupBy("g", "idx")).applyInArrow(prove, _RESULT)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row for each row of ``docs``.

    docs: (doc_id, source, lang, n_chars, text, ...), any of them null; other columns are left alone. Leaves of a language ascend
    by id (see ``ranked`` for nulls, ties and repeats); every 8 consecutive nodes become their digest until one is left, and the
    languages' roots, null first, become the root in the same way. A key of the trie is a rank without its lowest digits: a task folds
    512 neighbours, which share the longest prefix, and the next round has one node for them. Proofs go down the same way.
    Rows with null text or of a single language are leaves like any other; an empty table gives no row.
    """
    rows = written(ranked(written(leaves(docs), "leaves")), "ranked-leaves")
    trees = _climb(rows)
    subroots = trees[-1]
    top = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), "digest", _depth(F.lit(subroots.count())).alias("left"))
    over = _climb(top)
    nothing = F.array().cast("array<struct<before: string, after: string>>")
    paths = over[-1].select("g", "idx", nothing.alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    for level in reversed(over[:-1]):
        paths = _descend(level, paths)
    paths = paths.select(F.col("idx").alias("g"), "path", "root").join(subroots.select("g", "idx", F.col("digest").alias("subroot")), "g")
    paths = paths.select("g", "idx", "path", "subroot", "root")
    for level in reversed(trees[1:-1]):
        paths = _descend(level, paths)
    return _proofs(rows, paths)
