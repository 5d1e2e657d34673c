"""A keyword index on storage: segments of postings in runs and blocks of chunks, and tombstones.

A search reads the postings of its terms only, and ids and lengths of the blocks whose best possible score reaches the k-th. Adding writes a
segment, removing writes tombstones; neither rewrites what is there. Postings name chunks by number: an id is written once, not with every word.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.functions.text import tokens
from sparkloft.operators import inverted
from sparkloft.operators.retrieval import B, K1, idf, normalised, top
from sparkloft.storage import written

TOKENS_A_RUN = 2_000_000  # a task holds so many and writes them as a run
TOKENS_A_FILE = 5_000_000  # of a compacted index, on average
BLOCK_BITS = 6  # chunks in a block: 64, a bit each of a long
FIRST_BLOCKS = 16  # blocks with the best bounds, scored first: their k-th score rules out others
BROADCAST_BLOCKS = 200_000  # block numbers (8 bytes each) that are broadcast at most

_ROWS = f"{inverted.ROWS}, segment int"


def _shared(tf: Column, dl: Column, mean: float) -> Column:
    """What of a term's weight a chunk gets, from its count there and the chunk's length."""
    return tf / (tf + K1 * (1 - B + B * dl / F.lit(float(mean))))


def _share(tf: str, dl: str, mean: float) -> Column:
    return _shared(F.col(tf), F.col(dl), mean)


class KeywordIndex:
    """An index in a folder that driver and executors share.

    ``words``: the Column of terms of a text (plain tokens unless given); queries must be analysed the same way.
    """

    def __init__(self, spark: SparkSession, path: str, words=tokens):
        self.spark, self.path, self.words = spark, path.rstrip("/"), words
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self.read = (0, 0)
        self._path, self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _segments(self) -> list[int]:
        """Segments that are whole: what they hold in all is written last."""
        found = self._fs.globStatus(self._path(f"{self.path}/totals/segment=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def _totals(self) -> dict[int, tuple[int, int]]:
        """Of each segment: its chunks and their terms."""
        segments = self._segments()
        if not segments:
            return {}
        rows = self.spark.read.option("basePath", f"{self.path}/totals").parquet(*[f"{self.path}/totals/segment={s}" for s in segments]).collect()
        return {r["segment"]: (r["chunks"], r["terms"]) for r in rows}

    def add(self, chunks: DataFrame) -> int:
        """A new segment of chunks (chunk_id, text); ids that are indexed already are replaced, rows of one id stay side by side. Returns its number."""
        return self._write(inverted.runs(chunks.select("chunk_id", self.words(F.col("text")).alias("w")), TOKENS_A_RUN, 1 << BLOCK_BITS))

    def _write(self, rows: DataFrame) -> int:
        """A segment of ``inverted.ROWS``, as the tasks that make them hold them."""
        segment = max(self._segments(), default=0) + 1
        path = f"{self.path}/postings/segment={segment}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        blocks = self.spark.read.schema(inverted.ROWS).parquet(path).where("term is null")
        size = F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)
        totals = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(size), F.lit(0)).alias("terms")).coalesce(1)
        totals.write.mode("overwrite").parquet(f"{self.path}/totals/segment={segment}")
        return segment

    def remove(self, ids: DataFrame) -> None:
        """Chunks (chunk_id) go from all segments so far; adding one later brings it back."""
        last = max(self._segments(), default=0)
        ids.select("chunk_id", F.lit(last).alias("upto")).write.mode("append").parquet(f"{self.path}/removed")

    def _plain(self) -> bool:
        """Whether there is one segment and nothing was removed: then every row is live."""
        return len(self._segments()) == 1 and not self._there("removed")

    def _rows(self) -> DataFrame:
        segments = self._segments()
        rows = self.spark.read.schema(_ROWS).parquet(f"{self.path}/postings") if segments else self.spark.createDataFrame([], _ROWS)
        return rows.where(F.col("segment").isin(segments))

    def _heads(self) -> DataFrame:
        """(segment, run, blk, ids, dls): the chunks of every block."""
        return self._rows().where("term is null").select("segment", "run", "blk", "ids", "dls")

    def live(self) -> DataFrame:
        """(chunk_id, segment, run, blk, at, dl): the newest version of every chunk that was not removed since, with its place."""
        rows = self._heads().select("segment", "run", "blk", F.posexplode(F.arrays_zip("ids", "dls")).alias("at", "x"))
        rows = rows.select(F.col("x")["ids"].alias("chunk_id"), "segment", "run", "blk", "at", F.col("x")["dls"].alias("dl"))
        if not self._segments() or self._plain():
            return rows
        if self._there("removed"):
            rows = rows.unionByName(self.spark.read.parquet(f"{self.path}/removed").select("chunk_id", "upto"), allowMissingColumns=True)
        else:
            rows = rows.withColumn("upto", F.lit(None).cast("int"))
        same = W.Window.partitionBy("chunk_id")
        rows = rows.withColumns({"newest": F.max("segment").over(same), "gone": F.max("upto").over(same)})
        return rows.where("segment = newest and (gone is null or gone < segment)").drop("upto", "newest", "gone")

    def _alive(self) -> DataFrame | None:
        """(segment, blk, mask, n, size) of blocks with live chunks: a bit for each, how many and their terms. None if all are live."""
        if self._plain():
            return None
        bit = F.expr("shiftleft(1L, at)")
        return written(self.live().groupBy("segment", "blk").agg(F.bit_or(bit).alias("mask"), F.count("*").alias("n"), F.sum("dl").alias("size")), "live")

    def _blocks(self, terms: Iterable[str] | None = None) -> DataFrame:
        """(term, segment, run, n, docs) of the whole segments; of some terms only their pages are read."""
        rows = self._rows()
        rows = rows.where("term is not null") if terms is None else rows.where(F.col("term").isin(list(dict.fromkeys(terms))))
        return rows.select("term", "segment", "run", "n", "docs")

    def _opened(self, terms: Iterable[str] | None, alive: DataFrame | None) -> DataFrame:
        """(term, segment, blk, docs): of each block the live chunks that hold a term."""
        rows = inverted.opened(self._blocks(terms), BLOCK_BITS).select("term", "segment", "blk", "docs")
        if alive is None:
            return rows
        kept = F.filter("docs", lambda d: F.getbit(F.col("mask"), d["at"]) == 1)
        return rows.join(alive.select("segment", "blk", "mask"), ["segment", "blk"]).select("term", "segment", "blk", kept.alias("docs"))

    @staticmethod
    def _hits(opened: DataFrame, heads: DataFrame) -> DataFrame:
        """(term, segment, blk, at, chunk_id, tf, dl): a row for each chunk that holds a term."""
        found = F.transform("docs", lambda d: F.struct(d["at"], F.get("ids", d["at"]).alias("chunk_id"), d["tf"], F.get("dls", d["at"]).alias("dl")))
        return opened.join(heads.select("segment", "blk", "ids", "dls"), ["segment", "blk"]).select("term", "segment", "blk", F.inline(found))

    def postings(self, terms: Iterable[str] | None = None) -> DataFrame:
        """(term, chunk_id, tf, dl, blk) of the live chunks."""
        alive = self._alive() if self._segments() else None
        return self._hits(self._opened(terms, alive), self._heads()).select("term", "chunk_id", "tf", "dl", "blk")

    @staticmethod
    def _weight(df: dict[str, int], n: int) -> Column:
        return F.create_map(*[x for t, d in df.items() for x in (F.lit(t), F.lit(float(idf(n, d))))])[F.col("term")]

    @staticmethod
    def _scored(hits: DataFrame, df: dict[str, int], n: int, mean: float) -> DataFrame:
        """(chunk_id, score): shares are added in the order of terms, so chunks with equal counts and lengths have equal scores."""
        parts = [F.coalesce(F.sum(F.when(F.col("term") == t, F.lit(float(idf(n, d))) * _share("tf", "dl", mean))), F.lit(0.0)).alias(f"p{i}") for i, (t, d) in enumerate(df.items())]
        scored = hits.groupBy("segment", "blk", "at", "chunk_id").agg(*parts)
        return scored.select("chunk_id", sum((F.col(f"p{i}") for i in range(1, len(parts))), F.col("p0")).alias("score"))

    def scores(self, terms: Iterable[str]) -> DataFrame:
        """(chunk_id, score): BM25 of the chunks that hold any of the terms."""
        terms = list(dict.fromkeys(terms))
        none = self.spark.createDataFrame([], "chunk_id string, score double")
        if not terms or not self._segments():
            return none
        alive = self._alive()
        n, size = next(iter(self._totals().values())) if alive is None else alive.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        opened = self._opened(terms, alive)
        found = {r["term"]: r["df"] for r in opened.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()} if size else {}  # a row for each query term
        df = {t: found[t] for t in terms if found.get(t)}
        return self._scored(self._hits(opened, self._heads()), df, n, size / n) if df else none

    def best(self, terms: Iterable[str], k: int) -> DataFrame:
        """(chunk_id, score): the k best of ``scores``, from few blocks.

        A block's bound is the sum of the most that each term can give to any of its chunks: that of its largest count in the shortest chunk. The
        blocks with the best bounds are scored first; no chunk of a block whose bound is below their k-th score can be among the best, so of such
        blocks neither ids nor lengths are read. These hold for one segment without removals; until ``compact``, others are scored whole.
        ``read`` tells how many blocks of how many the last call read.
        """
        terms = list(dict.fromkeys(terms))
        if not terms or not self._segments() or not self._plain():
            return top(self.scores(terms), k)
        ((n, size),) = self._totals().values()
        found = {r["term"]: r["df"] for r in self._blocks(terms).groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each query term
        df = {t: found[t] for t in terms if t in found}
        if not size or not df:
            return top(self.scores(terms), k)
        mean, opened, heads = size / n, inverted.opened(self._blocks(terms), BLOCK_BITS), self._heads()
        most = opened.select("term", "blk", "tf").join(heads.select("blk", F.get("dls", F.lit(0)).alias("dl")), "blk")
        bounds = most.groupBy("blk").agg(F.sum(self._weight(df, n) * _share("tf", "dl", mean)).alias("bound"))
        first = bounds.orderBy(F.desc("bound"), "blk").limit(max(FIRST_BLOCKS, 4 * k >> BLOCK_BITS)).collect()

        def scored(of) -> DataFrame:
            return top(self._scored(self._hits(of(opened), of(heads)), df, n, mean), k)

        hits = scored(lambda x: x.where(F.col("blk").isin([r["blk"] for r in first]))).collect()  # k rows
        found = self.spark.createDataFrame(hits, "chunk_id string, score double")
        floor = hits[-1]["score"] * (1 - 1e-12) if len(hits) == k else 0.0
        rest = bounds.where((F.col("bound") >= floor) & ~F.col("blk").isin([r["blk"] for r in first])).select("blk")
        more, every = bounds.agg(F.count_if((F.col("bound") >= floor) & ~F.col("blk").isin([r["blk"] for r in first])), F.count("*")).first()
        self.read = len(first) + more, every
        if not more:
            return found
        rest = F.broadcast(rest) if more <= BROADCAST_BLOCKS else rest
        return top(found.unionByName(scored(lambda x: x.join(rest, "blk", "left_semi"))), k)

    def search(self, terms: Iterable[str], k: int, chunks: DataFrame | None = None, where: Column | None = None) -> DataFrame:
        """(chunk_id, score): top k over the largest score. A filter on chunks (``where``) comes after the cut to 3 k and the division."""
        if where is None:
            return normalised(self.best(terms, k))
        hits = normalised(self.best(terms, 3 * k))
        kept = chunks.where(where).join(F.broadcast(hits), "chunk_id").select("chunk_id", "score")  # at most 3 k rows
        return top(kept, k)

    def compact(self, path: str) -> KeywordIndex:
        """The live postings as one segment of a new index."""
        return self._copied(path, F.col("chunk_id"))

    def rehome(self, old: str, new: str, path: str) -> KeywordIndex:
        """A new index whose chunk ids that begin with ``old`` begin with ``new``: what a move of a project asks for. No text is read."""
        return self._copied(path, F.when(F.col("chunk_id").startswith(old), F.concat(F.lit(new), F.substr("chunk_id", F.lit(len(old) + 1)))).otherwise(F.col("chunk_id")))

    def _copied(self, path: str, name: Column) -> KeywordIndex:
        """Live chunks are dealt anew to runs and blocks: whole runs go to a task, packed, and those without a live chunk stay behind."""
        copy, live = KeywordIndex(self.spark, path, self.words), written(self.live(), "live")
        size = live.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        unit = F.concat_ws(".", F.col("segment").cast("string"), F.col("run").cast("string")).alias("unit")
        runs = F.broadcast(live.select("segment", "run").distinct())  # one for each TOKENS_A_RUN tokens or task that added
        words = inverted.packed(self._blocks().join(runs, ["segment", "run"], "left_semi").select(unit, "term", "n", "docs"))
        doc = (F.shiftleft(F.col("blk") - F.col("run"), BLOCK_BITS) + F.col("at")).cast("int").alias("doc")
        rows = live.select(unit, doc, "dl", name.alias("chunk_id")).unionByName(words, allowMissingColumns=True)
        dealt = rows.repartition(size // TOKENS_A_FILE + 1, "unit").sortWithinPartitions("unit", F.col("packed").isNotNull())
        copy._write(inverted.joined(dealt, TOKENS_A_RUN, 1 << BLOCK_BITS))
        return copy
