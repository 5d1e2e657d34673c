"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking by inner product."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.llm.common import written
from sparkloft.llm.vectors import matrix, usable

TABLES = 2
FUNCTIONS = 4
WIDTH = 0.9  # of a bucket, on vectors of the unit ball
REACH = 4  # bucket numbers run from -REACH to REACH; the outermost are open
SUCCESS = 0.97  # estimated chance that a neighbour as far as the k-th is in a visited bucket of some table
SAMPLE = 4000  # vectors that the distance of the k-th neighbour is estimated on at most
SHARD = 8192  # hashed vectors in a shard at most
QUERY_BLOCK = 256

_SIDE = 2 * REACH + 1


@functools.cache
def hash_functions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal (2-stable) directions and offsets of all tables for vectors of ``dim`` components and the one that is added."""
    rng = np.random.default_rng(1000 + dim)
    a = np.linalg.qr(
        rng.normal(size=(dim + 1, dim + 1))
    )[0] if dim + 1 >= TABLES * FUNCTIONS else rng.normal(size=(dim + 1, dim + 1)) / math.sqrt(dim + 1)
    a = np.resize(a.T, (TABLES * FUNCTIONS, dim + 1)).T * math.sqrt(dim + 1)
    return a, rng.uniform(0, 1, TABLES * FUNCTIONS)


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Base vectors on a sphere with one more component, where the nearest have the largest inner product."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]], 1)


def lift_query(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q / np.sqrt((q * q).sum(1))[:, None], np.zeros((len(q), 1))], 1)


def positions(x: np.ndarray) -> np.ndarray:
    a, b = hash_functions(x.shape[1] - 1)
    return x @ a / WIDTH + b


def buckets(x: np.ndarray) -> np.ndarray:
    """[vector, table] bucket codes."""
    h = np.clip(np.floor(positions(x)), -REACH, REACH).astype(np.int64) + REACH
    power = _SIDE ** np.arange(FUNCTIONS)
    return np.stack([h[:, t * FUNCTIONS : (t + 1) * FUNCTIONS] @ power + t * _SIDE**FUNCTIONS for t in range(TABLES)], 1)


_ERF = np.vectorize(math.erf, otypes=[float])


def probes(q: np.ndarray, distance: float, held: np.ndarray, k: int) -> list[np.ndarray]:
    """Buckets to visit for each lifted query, in the order of their estimated success.

    A neighbour at ``distance`` is off by a normal deviate of that size in each function, so the chance of a perturbed bucket
    is the product of its intervals' chances. Buckets are visited until the chances of a table add up to its share of SUCCESS. ``held`` has the ids in
    each [table, bucket]: the chances of those that are not empty must reach that share of their own sum as well (few vectors,
    or uneven lengths, leave most buckets empty), and the visited ones hold k ids besides the query's own, or all there are.
    """
    at = positions(q)
    edges = np.concatenate([[-np.inf], np.arange(-REACH + 1, REACH + 1), [np.inf]])
    z = (edges[None, None] - at[:, :, None]) * WIDTH / (distance * math.sqrt(2))
    gap = np.maximum(np.maximum(z[:, :, :-1], -z[:, :, 1:]), 0) ** 2
    chance = np.diff((1 + _ERF(np.clip(z, -8, 8))) / 2, axis=2)
    goal = 1 - (1 - SUCCESS) ** (1 / TABLES)
    out = []
    for row, far in zip(chance, gap, strict=True):
        found = []
        for t in range(TABLES):
            p = row[t * FUNCTIONS]
            for f in row[t * FUNCTIONS + 1 : (t + 1) * FUNCTIONS]:
                p = (f[:, None] * p[None]).ravel()  # the first function varies fastest, as in the codes
            order = np.argsort(-p, kind="stable")
            first = int(np.searchsorted(np.cumsum(p[order]), goal)) + 1
            n = np.count_nonzero(held[t][order[:first]])
            order = order[held[t][order] > 0]
            sums = np.cumsum(p[order])
            n = max(n, int(np.searchsorted(sums, goal * sums[-1])) + 1)
            if held[t][order[:n]].sum() <= k:
                sure = np.count_nonzero(p[order])
                if sure < len(order):  # chances too small to tell apart: by distance
                    g = far[t * FUNCTIONS]
                    for f in far[t * FUNCTIONS + 1 : (t + 1) * FUNCTIONS]:
                        g = (f[:, None] + g[None]).ravel()
                    order[sure:] = order[sure:][np.argsort(g[order[sure:]], kind="stable")]
                n = max(n, int(np.searchsorted(np.cumsum(held[t][order]), k + 1)) + 1)
            found.append(order[:n] + t * _SIDE**FUNCTIONS)
        out.append(np.concatenate(found))
    return out


@dataclass
class Layout:
    """Which shards hold a bucket: a full one is split over several, small ones share one."""

    first: dict[int, int]
    pieces: dict[int, int]

    @classmethod
    def of(cls, sizes: dict[int, int]) -> Layout:
        total = sum(sizes.values())
        full = math.ceil(total / math.ceil(total / SHARD))  # shards of like size
        first, pieces, shard, room = {}, {}, 0, full
        for code in sorted(sizes):
            n = sizes[code]
            if n > SHARD:
                shard += room < full
                first[code], pieces[code] = shard, math.ceil(n / SHARD)
                shard, room = shard + pieces[code], full
                continue
            if room <= 0:
                shard, room = shard + 1, full
            first[code], pieces[code] = shard, 1
            room -= n
        return cls(first, pieces)


def _distance(sample: np.ndarray, queries: np.ndarray, n: int, k: int) -> float:
    """Distance within which nine in ten queries have their k-th neighbour of n, from a sample (an upper estimate where it is small)."""
    rank = max(1, round(k * len(sample) / max(n, 1)))
    d2 = np.sort(2 - 2 * np.clip(queries @ sample.T, -1, 1), axis=1)[:, 1 : rank + 1]
    return float(np.sqrt(np.quantile(d2[:, -1], 0.9))) if d2.size else 1.0


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that ``is_query`` (a condition on vec_id) picks, the k other rows of
    largest inner product among those found, ties to the smaller vec_id. A query gets k rows, or all candidates if there are fewer.

    vectors: (vec_id long, embedding array<float>, ...). Vectors that are null, zero or hold null or non-finite components, and rows
    with a null vec_id, take no part; vectors of another length than the query are no candidates. Equal vectors are
    hashed once and listed by id. Rows that repeat a vec_id count once. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    rows = rows.dropDuplicates(["vec_id"])
    # of equal vectors only the k + 1 smallest ids can be among the k nearest: each task cuts to them before the shuffle
    first = W.Window.partitionBy("embedding").orderBy("vec_id")
    ids = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    base = written(
        ids.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("embedding")), "ann-base"
    )
    queries = rows.where(is_query).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    about = {
        r["dim"]: (math.sqrt(r["longest"]), r["n"]) for r in base.groupBy("dim").agg(
            F.max(squares).alias("longest"), F.count("*").alias("n")
        ).collect()
    }
    schema = "query_id long, rank int, vec_id long, score double"
    if not about:
        return spark.createDataFrame([], schema)
    picked = base.orderBy(F.xxhash64("ids"), "ids").limit(SAMPLE).select("embedding", "dim").collect()
    near = {}
    for dim, (longest, n) in about.items():
        x = np.array([r["embedding"] for r in picked if r["dim"] == dim], float)
        near[dim] = max(0.05, _distance(lift(x, longest), lift_query(x[:300]), n, k)) if len(x) > 1 else 1.0

    def hashed(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                code = buckets(lift(matrix(part.column("embedding")), about[int(dim)][0]))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("dim"), pa.array(code[:, t]), part.column("ids"), part.column("embedding")],
                        names=["dim", "code", "ids", "embedding"]
                    )

    codes = base.mapInArrow(hashed, "dim int, code long, ids array<long>, embedding array<double>")
    # as many counts as the tables have buckets, at most TABLES * _SIDE ** FUNCTIONS for each vector length
    sizes: dict[int, dict[int, int]] = {}
    held: dict[int, np.ndarray] = {}
    for r in codes.groupBy("dim", "code").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("held")).collect():
        sizes.setdefault(r["dim"], {})[r["code"]] = r["n"]
        held.setdefault(r["dim"], np.zeros((TABLES, _SIDE**FUNCTIONS), np.int64)).ravel()[r["code"]] = r["held"]
    sent = spark.sparkContext.broadcast({d: Layout.of(s) for d, s in sizes.items()})
    ids_in = spark.sparkContext.broadcast(held)

    def deal(batches):
        for b in batches:
            shard = np.zeros(b.num_rows, np.int64)
            for i, (dim, code, ids) in enumerate(
                zip(b.column("dim").to_pylist(), b.column("code").to_pylist(), b.column("ids").to_pylist(), strict=True)
            ):
                layout = sent.value[dim]
                shard[i] = layout.first[code] + ids[0] * 2654435761 % (1 << 32) % layout.pieces[code]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("dim"), pa.array(shard), pa.nulls(b.num_rows, pa.int64()), b.column("ids"), b.column("embedding"),
                    pa.array([[c] for c in b.column("code").to_pylist()], pa.list_(pa.int64()))
                ],
                names=["dim", "shard", "query_id", "ids", "embedding", "codes"]
            )

    def ask(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            take, shards, visited = [], [], []
            for dim in np.unique(dims):
                if int(dim) not in sent.value:
                    continue
                where, layout = np.flatnonzero(dims == dim), sent.value[int(dim)]
                q = lift_query(matrix(b.column("embedding").take(pa.array(where))))
                for i, found in zip(where.tolist(), probes(q, near[int(dim)], ids_in.value[int(dim)], k), strict=True):
                    by: dict[int, list[int]] = {}
                    for c in found.tolist():
                        for s in range(layout.first[c], layout.first[c] + layout.pieces[c]):
                            by.setdefault(s, []).append(c)
                    take += [i] * len(by)
                    shards += by.keys()
                    visited += by.values()
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("dim").take(at), pa.array(shards, pa.int64()), b.column("vec_id").take(at), pa.nulls(len(take), pa.list_(pa.int64())),
                    b.column("embedding").take(at), pa.array(visited, pa.list_(pa.int64()))
                ],
                names=["dim", "shard", "query_id", "ids", "embedding", "codes"]
            )

    dealt = "dim int, shard long, query_id long, ids array<long>, embedding array<double>, codes array<long>"
    both = codes.mapInArrow(deal, dealt).unionByName(queries.mapInArrow(ask, dealt))

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("query_id").is_valid().to_numpy(zero_copy_only=False)
        held, wanted = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        out = {"query_id": [], "vec_id": [], "score": []}
        if held.num_rows and wanted.num_rows:
            x, q = matrix(held.column("embedding")), matrix(wanted.column("embedding"))
            ids, names = held.column("ids").to_pylist(), wanted.column("query_id").to_pylist()
            kinds, of = np.unique(held.column("codes").combine_chunks().flatten().to_numpy(), return_inverse=True)
            visits = wanted.column("codes").to_pylist()
            longest = float(np.sqrt((x * x).sum(1).max()))
            for a in range(0, len(q), QUERY_BLOCK):
                s = q[a : a + QUERY_BLOCK] @ x.T
                for i in range(len(s)):
                    s[i, ~np.isin(kinds, visits[a + i])[of]] = -np.inf
                # every vector that ties with the last place within rounding stays until exact scores and ids decide; a shard can hold
                # a vector once for each table
                few = min(TABLES * (k + 1), s.shape[1])
                least = np.partition(s, s.shape[1] - few, axis=1)[:, s.shape[1] - few]
                least = least - 1e-12 * longest * np.sqrt((q[a : a + QUERY_BLOCK] ** 2).sum(1))
                for i in range(len(s)):
                    cand = np.flatnonzero((s[i] >= least[i]) & np.isfinite(s[i]))
                    exact = (x[cand] * q[a + i]).sum(1)  # equal vectors get equal scores, wherever they stand
                    me = names[a + i]
                    seen = sorted({(-v, j) for v, c in zip(exact.tolist(), cand.tolist(), strict=True) for j in ids[c] if j != me})[:k]
                    out["query_id"].append(me)
                    out["vec_id"].append([j for _, j in seen])
                    out["score"].append([-v for v, _ in seen])
        return pa.table(
            {
                "query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.list_(pa.int64())),
                "score": pa.array(out["score"], pa.list_(pa.float64()))
            }
        )

    lists = both.groupBy("dim", "shard").applyInArrow(search, "query_id long, vec_id array<long>, score array<double>")
    pairs = lists.select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("x")).select("query_id", "x.vec_id", "x.score")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # found in several tables
    ranked = pairs.withColumn("rank", F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
