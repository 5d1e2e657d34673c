"""Full-text search with phrases, OR and exclusion over written postings that keep the places of words."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloft.functions.text import tokens
from sparkloft.operators import inverted
from sparkloft.operators.retrieval import normalised, top

BUCKETS = (16, 4096)
POSTINGS_A_BUCKET = 20_000_000
POSTINGS_A_FILE = 5_000_000


@dataclass(frozen=True)
class Clause:
    """Words that must follow each other (one word: must be there), or must not."""

    words: tuple[str, ...]
    excluded: bool = False


def clauses(query: str) -> list[list[tuple[str, bool]]]:
    """A question's alternatives, each a list of (text, excluded): quotes make a phrase, a minus before excludes, ``or`` parts alternatives."""
    groups: list[list[tuple[str, bool]]] = [[]]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if plain.lower() == "or" and not minus:
            groups.append([])
        else:
            groups[-1].append((quoted or plain, bool(minus)))
    return [g for g in groups if g]


class FulltextIndex:
    """Positional postings of weighted fields in a folder that driver and executors share. A row is what one row of chunks has of a word.

    ``fields``: the weight of each text column. A search reads the buckets of its words; the places of the words of a phrase are
    intersected after each has been moved back by its place in the phrase, within one field.
    """

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, float], words=tokens):
        self.spark, self.path, self.fields, self.words = spark, path.rstrip("/"), fields, words

    def build(self, chunks: DataFrame) -> FulltextIndex:
        """Writes the postings of chunks (chunk_id, fields ...). An id that repeats counts with all its rows."""
        parts = [F.struct(F.lit(i).alias("field"), self.words(F.col(f)).alias("w")) for i, f in enumerate(self.fields)]
        rows = chunks.select("chunk_id", F.inline(F.array(*parts)))
        found = inverted.places(rows)
        chunks.select("chunk_id").distinct().write.mode("overwrite").parquet(f"{self.path}/chunks")
        n = rows.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
        buckets = max(BUCKETS[0], min(BUCKETS[1], n // POSTINGS_A_BUCKET))
        files = n // (buckets * POSTINGS_A_FILE) + 1
        placed = found.withColumn("bucket", self._bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(files)))
        placed.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        self.spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/shape")
        return self

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, chunk_id, field, places) of some terms."""
        buckets = self.spark.read.parquet(f"{self.path}/shape").first()[0]
        rows = self.spark.read.schema("term string, chunk_id string, field int, places array<int>, bucket int").parquet(f"{self.path}/postings")
        if not terms:
            return rows.where(F.lit(False)).drop("bucket")
        numbers = self.spark.range(1).select(*[self._bucket(F.lit(t), buckets) for t in terms]).first()
        return rows.where(F.col("bucket").isin(sorted(set(numbers))) & F.col("term").isin(terms)).drop("bucket")

    def compiled(self, query: str) -> list[list[Clause]]:
        """The alternatives of a query, their texts analysed as the index's; clauses without a word are left out."""
        groups = clauses(query)
        texts = [t for g in groups for t, _ in g]
        if not texts:
            return []
        found = iter(self.spark.range(1).select(*[self.words(F.lit(t)).alias(f"c{i}") for i, t in enumerate(texts)]).first())
        out = [[Clause(tuple(next(found)), excluded) for _, excluded in g] for g in groups]
        return [g for g in ([c for c in g if c.words] for g in out) if g]

    def search(self, query: str, k: int) -> DataFrame:
        """(chunk_id, score): the k best chunks that one of the query's alternatives fits, over the largest score.

        A chunk scores weight * n / (n + 1) for every word that no alternative excludes and each field, with n places there. An alternative of exclusions
        only fits all chunks without these; they score 0. A query without words finds nothing.
        """
        groups = self.compiled(query)
        if not groups:
            return self.spark.createDataFrame([], "chunk_id string, score double")
        wanted = sorted({w for g in groups for c in g if not c.excluded for w in c.words})
        terms = sorted({w for g in groups for c in g for w in c.words})
        hits = self.postings(terms).groupBy("chunk_id").agg(F.collect_list(F.struct("term", "field", "places")).alias("hits"))
        if any(all(c.excluded for c in g) for g in groups):
            hits = self.spark.read.parquet(f"{self.path}/chunks").join(hits, "chunk_id", "left")
        hits = hits.withColumn("hits", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)))
        fits = F.lit(False)
        for g in groups:
            all_of = F.lit(True)
            for c in g:
                all_of &= ~self._has(c.words) if c.excluded else self._has(c.words)
            fits |= all_of
        score = F.lit(0.0)
        for w in wanted:
            for field, weight in enumerate(self.fields.values()):
                n = F.aggregate(F.filter("hits", self._of(w, field)), F.lit(0), lambda a, x: a + F.size(x["places"]))
                score += F.lit(float(weight)) * n / (n + 1.0)
        scored = hits.where(fits).select("chunk_id", score.alias("score"))
        return normalised(top(scored, k))

    def _has(self, words: tuple[str, ...]) -> Column:
        if len(words) == 1:
            return F.exists("hits", lambda x: x["term"] == words[0])
        found = F.lit(False)
        for field in range(len(self.fields)):
            together = None
            for i, w in enumerate(words):
                mine = F.flatten(F.transform(F.filter("hits", self._of(w, field)), lambda x: x["places"]))
                moved = F.transform(mine, self._back(i))
                together = moved if together is None else F.array_intersect(together, moved)
            found |= F.size(together) > 0
        return found

    @staticmethod
    def _of(word: str, field: int):
        return lambda x: (x["term"] == word) & (x["field"] == field)

    @staticmethod
    def _back(by: int):
        return lambda p: p - by
