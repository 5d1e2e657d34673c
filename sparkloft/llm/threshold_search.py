"""Ranked lexical search by Fagin's threshold algorithm over shards of documents."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.llm.common import small_batches, written

K = 50
SCALE = 1_000_000_000
ITEMS = 512  # items that are searched in one pass; more are searched in blocks of half as many
CELLS = 1 << 22  # of a shard's forward index: documents times terms, 4 bytes each
STEP = 64  # places of each list that are read before the threshold is looked at first; twice as many each time
FLOOR_SHARE = 8  # one document in so many sets the floor below which no document can be among the best
FLOOR_ROWS = 16384  # documents of that share that are searched in one task

# fixed: what parts terms, and A-Z in lower case
_PARTS = bytes.maketrans(
    bytes(c for c in range(128) if not chr(c).isalnum()) + bytes(range(65, 91)), b" " * 66 + bytes(range(97, 123))
)
_FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"
_HITS = "item int, doc_id long, score long"


def words(text: str | None) -> list[bytes]:
    """Terms of a whole text in UTF-8: runs of letters and digits, all beyond ASCII included; only A-Z change. None for null."""
    return text.encode().translate(_PARTS).split() if text else []


@dataclass(frozen=True)
class Statistics:
    """Of all documents: how many have a term, all their terms, and the weight of each term of the vocabulary."""

    documents: int
    terms: int
    weights: np.ndarray


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): the terms of each document that ``vocabulary`` holds, by ascending number, and all n of its terms."""

    def run(batches):
        for b in batches:
            n, ids, counts, ends = [], [], [], [0]
            for x in b.column(1):
                found = words(x.as_py())
                mine = sorted((i, c) for t, c in Counter(found).items() if (i := vocabulary.get(t)) is not None)
                n.append(len(found))
                ids += [i for i, _ in mine]
                counts += [c for _, c in mine]
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FORWARD)


def statistics(forward: DataFrame, size: int) -> Statistics:
    """Counts over the whole index. A task sends one row for each term of the vocabulary that it has."""

    def count(batches):
        held = np.zeros(size, np.int64)
        for b in batches:
            held += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some])], names=["term", "df"])

    n, length = forward.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for term, held in forward.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # one row a term
        df[term] = held
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    return Statistics(n, length, weights)


def _shares(counts: np.ndarray, n: np.ndarray, known: Statistics) -> np.ndarray:
    """What a term's weight is multiplied by: grows with its count, falls with the document's length."""
    m = 50 + 50 * n * known.documents // max(known.terms, 1)
    return SCALE * counts // (1000 * counts + 20 * m)


class Shard:
    """Documents of one block: impact-sorted lists by term, and a forward index with a row for each document."""

    def __init__(self, doc_ids: pa.Array, n, terms, ends, counts, known: Statistics):
        docs = np.repeat(np.arange(len(n)), np.diff(ends))
        share = _shares(counts.astype(np.int64), n[docs], known)
        self.doc_ids, self.known, self.docs_held = doc_ids, known, len(n)
        valid = np.array(doc_ids.is_valid())
        places = np.lexsort((doc_ids.fill_null(0).to_numpy(zero_copy_only=False), valid))  # ties go by id, null first
        self.place = np.empty(len(n), np.int64)
        self.place[places] = np.arange(len(n))
        order = np.lexsort((-share, terms))
        self.docs, self.shares = docs[order], share[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(known.weights) + 1))
        self.forward = np.zeros((len(n), len(known.weights)), np.int32)  # shares are at most a million
        self.forward[docs, terms] = share

    def best(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents looked up) of the k best that score at least ``floor``, which is above 0.

        Lists are read in round-robin, more places at a time as it goes on; each document that comes up is scored from its row of
        the forward index. No document that has not come up can score more than the impacts last read add up to (a list at its end
        adds nothing): reading stops when that is strictly below the k-th score, or the floor, so that ties at the k-th score all come up.
        """
        weights = self.known.weights[terms]
        start, end = self.starts[terms], self.starts[terms + 1]
        some = (weights > 0) & (end > start)
        terms, weights, start, end = terms[some], weights[some], start[some], end[some]
        seen = np.zeros(self.docs_held, bool)
        found, scores, depth, step = [], [], 0, STEP
        kth = floor
        while len(terms) and depth < (end - start).max():
            at = start[:, None] + np.arange(depth, depth + step)
            new = self.docs[at[at < end[:, None]]]
            new = np.unique(new[~seen[new]])
            seen[new] = True
            score = self.forward[np.ix_(new, terms)].astype(np.int64) @ weights
            found.append(new)
            scores.append(score)
            depth, step = depth + step, step * 2
            every = np.concatenate(scores)
            if len(every) >= k:
                kth = max(kth, int(np.partition(every, len(every) - k)[len(every) - k]))
            last = start + depth - 1
            left = np.where(last < end, self.shares[np.minimum(last, len(self.shares) - 1)], 0)
            if int(left @ weights) < kth:
                break
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        docs, score = np.concatenate(found), np.concatenate(scores)
        looked = len(docs)
        docs, score = docs[score >= kth], score[score >= kth]
        order = np.lexsort((self.place[docs], -score))[:k]
        return docs[order], score[order], looked


def _shards(batches, known: Statistics):
    """Shards of so many documents that their forward index stays within CELLS."""
    size = max(1, CELLS // max(1, len(known.weights)))

    def shard(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        doc_ids, n, terms, counts = (t.column(i).combine_chunks() for i in range(4))
        ends = terms.offsets.to_numpy()
        terms, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in (terms, counts))
        return Shard(doc_ids, n.to_numpy(), terms, ends - ends[0], counts, known)

    waiting, rows = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - rows)
            b = b.slice(part.num_rows)
            waiting.append(part)
            rows += part.num_rows
            if rows == size:
                yield shard(waiting)
                waiting, rows = [], 0
    if rows:
        yield shard(waiting)


def _search(forward: DataFrame, items: list[np.ndarray], known: Statistics, k: int, floors: np.ndarray) -> DataFrame:
    """(item, doc_id, score): of each task the k best of every item, all at least its floor; the floors rise as a task's shards go by."""

    def run(batches):
        floor = floors.copy()
        best = [np.empty(0, np.int64)] * len(items)
        for shard in _shards(batches, known):
            item, docs, scores = [], [], []
            for i, terms in enumerate(items):
                doc, score, _ = shard.best(terms, k, int(floor[i]))
                best[i] = np.sort(np.concatenate([best[i], score]))[-k:]
                if len(best[i]) == k:
                    floor[i] = max(floor[i], best[i][0])
                item.append(np.full(len(doc), i, np.int32))
                docs.append(doc)
                scores.append(score)
            ids = shard.doc_ids.take(pa.array(np.concatenate(docs)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(item)), ids, pa.array(np.concatenate(scores))], names=["item", "doc_id", "score"])

    return forward.mapInArrow(run, _HITS)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = W.Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, texts: dict[int, list[str]], k: int) -> DataFrame:
    """The k best documents of a block of items: (item, rank, doc_id, score)."""
    spark = docs.sparkSession
    terms = {i: {t for text in some for t in words(text)} for i, some in texts.items()}
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*terms.values())))}
    numbers = sorted(terms)
    items = [np.array(sorted(vocabulary[t] for t in terms[i]), np.int64) for i in numbers]
    forward = written(forward_index(docs, vocabulary), "forward-index")
    known = statistics(forward, len(vocabulary))
    share = forward.where(F.pmod(F.xxhash64("doc_id"), F.lit(FLOOR_SHARE)) == 0)
    tasks = share.count() // FLOOR_ROWS + 1
    none = np.ones(len(items), np.int64)
    floors = none.copy()
    kth = _top(_search(share.repartition(tasks), items, known, k, none), k).where(F.col("rank") == k)
    for item, score in kth.select("item", "score").collect():  # one row an item
        floors[item] = max(1, score)
    found = _top(_search(forward, items, known, k, floors), k)
    names = spark.createDataFrame(list(enumerate(numbers)), "item int, number int")
    return found.join(F.broadcast(names), "item").select("number", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, best first, equal scores by ascending doc_id.

    docs: (doc_id, text, ...), items: (item_id, text, ...); other columns are left alone. Texts are read whole. A null text has no
    terms; such a document does not count, such an item gets no row, as does one whose terms no document has. Rows of one item_id
    are one item with the terms of all; a null id is an item too. Repeated rows of documents are documents of their own; a null
    doc_id comes first among equal scores. Empty tables give no row.

    Up to 512 items are taken at once, more in blocks by a hash. The texts are read once a block: a forward index of the items' terms is written, and
    statistics come from all of it. A task searches its shards one after another, each by the threshold algorithm; a shard is so
    small that its forward index has four million cells. The k-th best score of an eighth of the documents is a floor for all:
    k documents reach it, so what scores less is not among the best, and shards stop early and send little. No document is left out.
    """
    spark = docs.sparkSession
    ids = items.select(F.col("item_id").alias("id")).distinct()
    n = ids.count()
    blocks = 1 if n <= ITEMS else -(-2 * n // ITEMS)  # by a hash, half full on average
    ids = ids.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    placed = written(items.select("item_id", "text").join(ids, F.col("item_id").eqNullSafe(F.col("id"))).select("item_id", "text", "block"), "items")
    of_item = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {of_item}, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = placed.where(F.col("block") == block)
        texts, known = {}, {}
        for item_id, text in rows.select("item_id", "text").collect():  # a block of items
            texts.setdefault(known.setdefault(item_id, len(known)), []).append(text)
        if not texts:
            continue
        names = spark.createDataFrame([(i, n) for i, n in known.items()], f"item_id {of_item}, number int")
        found = _block(docs, texts, k).join(F.broadcast(names), "number")
        out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_TERMS}') AS t FROM documents),
sized AS (SELECT doc_id, r, t, len(t) AS n FROM doc WHERE len(t) > 0),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS term FROM benchmark),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, nn),
hit AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term), whole GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score
FROM hit WHERE score > 0 QUALIFY rank <= {K}
"""
