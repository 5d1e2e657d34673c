"""A vector index on storage: inverted lists are partitions, and a search reads those that a bound on their best score cannot rule out."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloft.functions.vector import literal, score
from sparkloft.operators.retrieval import top

MOST_LISTS = 4096
SAMPLE_A_LIST = 32  # vectors that the centres are fitted on, for each list
ROUNDS = 8
ROWS_A_FILE = 200_000
SLACK = 1e-9  # of a bound, for rounding
RANGES = 64  # lists up to which a search also bounds the angles of rows, so that row groups are skipped


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centres of unit vectors by spherical k-means, from evenly spread starting points."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.sqrt((total * total).sum(1))
        c = np.where(size[:, None] > 0, total / np.where(size, size, 1)[:, None], c)
    return c


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


@dataclass
class Lists:
    """What is known of every list: centre, largest angle of a vector to it, norms, rows. The last list holds the zero vectors."""

    centres: np.ndarray
    angle: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rows: np.ndarray

    def angles(self, query: np.ndarray) -> np.ndarray:
        norm = math.sqrt(query @ query)
        near = self.centres @ query / norm if norm else np.zeros(len(self.centres))
        return np.append(np.arccos(np.clip(near, -1, 1)), 0.0)

    def bounds(self, query: np.ndarray, metric: str) -> np.ndarray:
        """The largest score that a vector of each list can have: by the triangle inequality its angle to the query is at least theirs less the list's."""
        norm = math.sqrt(query @ query)
        cos = np.cos(np.maximum(0.0, self.angles(query) - self.angle))
        if metric == "cosine":
            best = np.where((self.most > 0) & (norm > 0), cos, 0.0)
            return np.clip(best, 0, 1)
        if metric == "inner_product":
            return np.maximum(0.0, norm * np.where(cos > 0, self.most, self.least) * cos)
        if metric == "l2":
            length = np.clip(norm * cos, self.least, self.most)  # of the nearest vector that the list could hold
            return 1 / (1 + np.sqrt(np.maximum(0.0, norm**2 + length**2 - 2 * norm * length * cos)))
        raise ValueError(f"unknown metric {metric!r}")


class VectorIndex:
    """An index in a folder that driver and executors share.

    ``rows/segment=S/list=L`` hold (chunk_id, embedding, any other columns, norm, angle to the centre), sorted by angle; ``lists/segment=S``,
    which is written last, says what each list of the segment spans. Rows that have no vector of the index's dimension, or a null or NaN in it,
    are not indexed: a full scan gives them no score either. ``visited`` tells how many lists the last search read, of how many.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._path, self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.visited = (0, 0)
        self._known: tuple[list[int], Lists] | None = None

    def _segments(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/lists/segment=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def _removed(self) -> DataFrame | None:
        if not self._fs.exists(self._path(f"{self.path}/removed")):
            return None
        return self.spark.read.parquet(f"{self.path}/removed").groupBy("chunk_id").agg(F.max("upto").alias("upto"))

    def build(self, vectors: DataFrame, lists: int | None = None) -> VectorIndex:
        """A new index of vectors (chunk_id, embedding, ...). Centres are fitted on a bounded sample; every row is indexed."""
        first = vectors.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
        dim = first["n"] if first else 0
        rows = self._usable(vectors, dim)
        n = rows.count()
        lists = lists or max(1, min(MOST_LISTS, math.isqrt(n)))
        sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(lists * SAMPLE_A_LIST).select("embedding").toArrow()
        x = _matrix(sample.column(0).combine_chunks(), dim) if n else np.zeros((0, dim))
        size = np.sqrt((x * x).sum(1))
        x = x[size > 0] / size[size > 0, None]
        centres = _centres(x, min(lists, len(x))) if len(x) else np.zeros((0, dim))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        self.spark.createDataFrame([(dim, vectors.schema.json())], "dim int, fields string").coalesce(1).write.parquet(f"{self.path}/shape")
        self.add(vectors, new=True)
        return self

    @staticmethod
    def _usable(vectors: DataFrame, dim: int) -> DataFrame:
        bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
        return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & ~F.coalesce(bad, F.lit(True)))

    def _shape(self) -> tuple[int, np.ndarray]:
        dim = self.spark.read.parquet(f"{self.path}/shape").first()[0]
        centres = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()  # MOST_LISTS at most
        return dim, np.array([r["centre"] for r in centres], float).reshape(len(centres), dim)

    def add(self, vectors: DataFrame, new: bool = False) -> int:
        """A segment of more vectors; ids that are indexed already are replaced (``new``: there are none). Returns its number."""
        dim, centres = self._shape()
        segment = max(self._segments(), default=0) + 1
        rows = self._usable(vectors, dim)
        fields = [*vectors.schema.fields, T.StructField("norm", T.DoubleType()), T.StructField("angle", T.DoubleType()), T.StructField("list", T.IntegerType()), T.StructField("part", T.IntegerType())]

        def place(batches):
            seen = 0
            for b in batches:
                x = _matrix(b.column(b.schema.get_field_index("embedding")), dim)
                norm = np.sqrt((x * x).sum(1))
                near = (x / np.where(norm, norm, 1)[:, None]) @ centres.T if len(centres) else np.zeros((len(x), 1))
                home = np.where(norm > 0, near.argmax(1), len(centres))
                angle = np.where(norm > 0, np.arccos(np.clip(near.max(1), -1, 1)), 0.0)
                part = (seen + np.arange(len(x))) // ROWS_A_FILE  # a long list of a task goes to several files
                seen += len(x)
                more = [pa.array(norm), pa.array(angle), pa.array(home.astype(np.int32)), pa.array(part.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "norm", "angle", "list", "part"])

        if not new:  # what the segments so far hold of these ids is gone
            self.remove(vectors.select("chunk_id"))
        placed = rows.mapInArrow(place, T.StructType(fields))
        spread = max(1, rows.count() // (ROWS_A_FILE * max(1, len(centres))))
        placed = placed.repartition("list", "part", F.pmod(F.xxhash64("chunk_id"), F.lit(spread))).drop("part").sortWithinPartitions("list", "angle")
        placed.write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/rows/segment={segment}")
        spans = self._read([segment]).groupBy("list").agg(F.max("angle").alias("angle"), F.min("norm").alias("least"), F.max("norm").alias("most"), F.count("*").alias("n"))
        spans.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/segment={segment}")
        return segment

    def remove(self, ids: DataFrame) -> None:
        """Chunks (chunk_id) go from all segments so far; adding one later brings it back."""
        last = max(self._segments(), default=0)
        ids.select("chunk_id", F.lit(last).alias("upto")).write.mode("append").parquet(f"{self.path}/removed")

    def _read(self, segments: list[int]) -> DataFrame:
        fields = T.StructType.fromJson(json.loads(self.spark.read.parquet(f"{self.path}/shape").first()["fields"])).fields
        more = [T.StructField(n, k) for n, k in (("norm", T.DoubleType()), ("angle", T.DoubleType()), ("segment", T.IntegerType()), ("list", T.IntegerType()))]
        rows = self.spark.read.schema(T.StructType([*fields, *more])).parquet(f"{self.path}/rows")
        return rows.where(F.col("segment").isin(segments))

    def live(self) -> DataFrame:
        """All indexed rows that were not removed or replaced, with norm, angle, segment and list."""
        rows = self._read(self._segments())
        gone = self._removed()
        if gone is None:
            return rows
        return rows.join(gone, "chunk_id", "left").where("upto is null or upto < segment").drop("upto")

    def lists(self) -> Lists:
        segments = self._segments()
        if self._known is None or self._known[0] != segments:
            dim, centres = self._shape()
            n = len(centres) + 1
            out = Lists(centres, np.zeros(n), np.full(n, np.inf), np.zeros(n), np.zeros(n, np.int64))
            spans = self.spark.read.option("basePath", f"{self.path}/lists").parquet(*[f"{self.path}/lists/segment={s}" for s in segments])
            spans = spans.groupBy("list").agg(F.max("angle"), F.min("least"), F.max("most"), F.sum("n"))
            for at, angle, least, most, rows in spans.collect():  # one row a list
                out.angle[at], out.least[at], out.most[at], out.rows[at] = angle + SLACK, least, most, rows
            self._known = segments, out
        return self._known[1]

    def search(
        self, query: list[float], k: int, threshold: float = 0.0, metric: str = "cosine", where: Column | None = None, probes: int | None = None
    ) -> DataFrame:
        """(chunk_id, score, other columns): what a scan of all vectors finds, the ``k`` best, then those of ``threshold`` or more.

        The lists with the best bounds that hold some k rows are read first; their k-th score, or the threshold, rules out all lists whose bound
        is lower, and the rest is read. With ``probes`` only that many lists with the nearest centres are read, which is faster and not exact.
        """
        q = np.array(query, float)
        known = self.lists()
        some = np.flatnonzero(known.rows)
        if not len(some):
            return self._best(some, query, k, metric, where)
        if probes is not None:
            near = some[np.argsort(known.angles(q)[some], kind="stable")][:probes]
            self.visited = len(near), len(some)
            return self._best(near, query, k, metric, where).where(F.col("score") >= threshold)
        bound = known.bounds(q, metric)
        order = some[np.argsort(-bound[some], kind="stable")]
        enough = int(np.searchsorted(np.cumsum(known.rows[order]), 4 * k)) + 1
        first, rest = order[:enough], order[enough:]
        best = self._best(first, query, k, metric, where)
        hits = best.collect()  # k rows
        floor = max(hits[-1]["score"] if len(hits) == k else 0.0, threshold)
        rest = rest[bound[rest] >= floor - SLACK]
        self.visited = len(first) + len(rest), len(some)
        found = self.spark.createDataFrame(hits, best.schema)
        if len(rest):
            found = top(found.unionByName(self._best(rest, query, k, metric, where, self._within(rest, q, floor, metric))), k)
        return found.where(F.col("score") >= threshold)

    def _within(self, lists: np.ndarray, q: np.ndarray, floor: float, metric: str) -> Column | None:
        """Angles to the centre that a row with a cosine of ``floor`` or more must have, list by list."""
        if metric != "cosine" or len(lists) > RANGES or not q.any():
            return None
        angles, reach = self.lists().angles(q), math.acos(min(1.0, max(0.0, floor))) + 1e-6
        out = F.lit(False)
        for i in lists.tolist():
            out |= (F.col("list") == i) & F.col("angle").between(float(angles[i] - reach), float(angles[i] + reach))
        return out

    def _best(self, lists: np.ndarray, query: list[float], k: int, metric: str, where: Column | None, within: Column | None = None) -> DataFrame:
        rows = self.live().where(F.col("list").isin(lists.tolist()))
        for condition in (within, where):
            rows = rows if condition is None else rows.where(condition)
        hits = rows.withColumn("score", score(F.col("embedding"), literal(query), metric)).drop("embedding", "norm", "angle", "list", "segment")
        return top(hits, k)

    def compact(self, path: str) -> VectorIndex:
        """A new index of the live rows, with centres fitted anew."""
        return VectorIndex(self.spark, path).build(self.live().drop("norm", "angle", "list", "segment"))
