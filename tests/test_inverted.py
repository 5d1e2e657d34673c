"""Postings are made where a text is: words cross no shuffle before they are postings."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloft.functions.text import tokens
from sparkloft.operators import inverted, keyword_index, retrieval
from sparkloft.operators.fulltext import FulltextIndex
from sparkloft.operators.keyword_index import KeywordIndex
from sparkloft.storage import folder

ROWS = [("c1", "b a b"), ("c2", None), ("c3", ""), ("c1", "a c"), ("c4", "Ä b"), ("c5", "b")]


@pytest.fixture()
def chunks(spark):
    return spark.createDataFrame(ROWS, "chunk_id string, text string")


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_places_of_words_without_a_shuffle(chunks):
    found = inverted.places(chunks.select("chunk_id", F.lit(0).alias("field"), tokens(F.col("text")).alias("w")))
    assert exchanges(found) == 0
    got = sorted((r["term"], r["chunk_id"], r["field"], tuple(r["places"])) for r in found.collect())
    assert got == [("a", "c1", 0, (0,)), ("a", "c1", 0, (1,)), ("b", "c1", 0, (0, 2)), ("b", "c4", 0, (1,)), ("b", "c5", 0, (0,)), ("c", "c1", 0, (1,)), ("ä", "c4", 0, (0,))]


def test_postings_deal_out_texts_only_and_rows_of_an_id_together(chunks):
    found = retrieval.postings(chunks)
    assert exchanges(found) == 1 and "explode" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["term"], r["chunk_id"], r["tf"], r["dl"]) for r in found.collect())
    assert got == [("a", "c1", 2, 2), ("b", "c1", 2, 2), ("b", "c4", 1, 2), ("b", "c5", 1, 1), ("c", "c1", 1, 2), ("ä", "c4", 1, 2)]


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_blocks_are_whole_whatever_the_batches(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = spark.range(200).coalesce(1).selectExpr("concat('c', id) AS chunk_id", "id div 64 AS blk", "CAST(2 AS INT) AS dl", "array('x', concat('y', id % 3)) AS w")
        found = inverted.blocks(rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert Counter((r["term"], r["blk"]) for r in found).most_common(1)[0][1] == 1
    assert sorted((d["chunk_id"], d["tf"], d["dl"]) for r in found if r["term"] == "x" for d in r["docs"]) == sorted((f"c{i}", 1, 2) for i in range(200))
    assert {r["blk"]: len(r["docs"]) for r in found if r["term"] == "x"} == {0: 64, 1: 64, 2: 64, 3: 8}


def test_rows_of_an_id_count_together_in_a_search(spark, chunks):
    index = FulltextIndex(spark, folder(spark, "f"), {"text": 1.0}).build(chunks)
    got = {r["chunk_id"]: round(r["score"], 6) for r in index.search("a", 10).collect()}
    assert got == {"c1": 1.0}
    got = {r["chunk_id"]: round(r["score"], 6) for r in index.search("b or a", 10).collect()}
    assert got["c1"] == 1.0 and got["c5"] == round(0.5 / (2 / 3 + 2 / 3), 6)


def test_a_compacted_index_finds_the_same(spark, chunks):
    index = KeywordIndex(spark, folder(spark, "k"))
    one = chunks.dropDuplicates(["chunk_id"])
    index.add(one.withColumn("text", F.lit("b b wrong")))
    index.add(one)
    index.remove(one.where("chunk_id = 'c5'").select("chunk_id"))
    small = index.compact(folder(spark, "k"))
    assert small._plain() and not small.search(["wrong"], 5).collect()
    a, b = ({r["chunk_id"]: round(r["score"], 9) for r in x.search(["b", "a"], 5).collect()} for x in (index, small))
    assert a == b and a and "c5" not in a


def test_postings_as_bytes_and_back():
    term = np.array([0, 0, 0, 1, 2, 2, 3])
    doc = np.array([0, 127, 128 + 16_384, 2_000_000_000, 5, 300, 0])
    tf = np.array([1, 1, 1, 1, 128, 1, 20_000])
    first, n, docs = inverted._docs(term, doc, tf)
    assert first.tolist() == [0, 3, 4, 6] and n.tolist() == [3, 1, 2, 1]
    for part in (slice(0, 4), slice(1, 3)):
        row, got, count = inverted._read(docs[part], n[part])
        here = np.isin(term, np.arange(4)[part])
        assert (row + part.start).tolist() == term[here].tolist() and got.tolist() == doc[here].tolist() and count.tolist() == tf[here].tolist()
    assert inverted._docs(term[:0], doc[:0], tf[:0])[2] == pa.array([], pa.binary())


def written_bytes(index) -> int:
    return index._fs.getContentSummary(index._path(f"{index.path}/postings")).getLength()


@pytest.fixture()
def many(spark):
    """20,000 chunks of 40 words out of 997; ids are hashes, as those of chunks are."""
    word = "transform(sequence(1, 40), i -> concat('w', pmod(xxhash64(id, i), 997)))"
    return spark.range(0, 20_000, 1, 4).selectExpr("id", "concat('chunk_', substr(md5(CAST(id AS STRING)), 1, 16)) AS chunk_id", f"array_join({word}, ' ') AS text")


def test_adding_shuffles_nothing_and_writes_an_id_once(spark, many):
    words = many.select("chunk_id", tokens(F.col("text")).alias("w"))
    assert exchanges(inverted.runs(words, 1000, 64)) == 0
    index = KeywordIndex(spark, folder(spark, "k"))
    index.add(many)
    n = index._blocks().agg(F.sum("n")).first()[0]
    assert n == words.select(F.sum(F.size(F.array_distinct("w")))).first()[0]
    assert written_bytes(index) < 3 * n


def test_compacting_deals_out_packed_runs_and_leaves_dead_ones(spark, many, monkeypatch):
    monkeypatch.setattr(keyword_index, "TOKENS_A_RUN", 30_000)
    monkeypatch.setattr(keyword_index, "TOKENS_A_FILE", 100_000)
    index = KeywordIndex(spark, folder(spark, "k"))
    index.add(many.where("id % 2 = 0").withColumn("text", F.lit("wrong w1 w1")))
    index.add(many)
    index.remove(many.where("id % 5 = 0").select("chunk_id"))
    small = index.compact(folder(spark, "k"))
    left = many.where("id % 5 <> 0")
    assert small._plain() and small.live().count() == left.count() and small._blocks(["wrong"]).count() == 0
    assert small._blocks().select("run").distinct().count() > 10
    want = {r["chunk_id"]: round(r["score"], 9) for r in retrieval.bm25_scores(left, ["w1", "w20"]).collect()}
    for found in (index, small):
        assert {r["chunk_id"]: round(r["score"], 9) for r in found.scores(["w1", "w20"]).collect()} == want
    n = left.select(F.sum(F.size(F.array_distinct(tokens(F.col("text")))))).first()[0]
    assert small._blocks().agg(F.sum("n")).first()[0] == n and written_bytes(small) < 3 * n and len(want) > 500


def test_chunks_of_one_id_stay_side_by_side_as_in_a_scan(spark):
    rows = spark.createDataFrame([("a", "x y"), ("a", "x x x z"), ("b", "x"), ("c", "q"), (None, "x z"), (None, "z")], "chunk_id string, text string")
    index = KeywordIndex(spark, folder(spark, "k"))
    index.add(rows.where("chunk_id = 'a'").limit(1))
    index.add(rows)
    want = sorted((str(r["chunk_id"]), round(r["score"], 9)) for r in retrieval.bm25_scores(rows, ["x", "z"]).collect())
    for found in (index, index.compact(folder(spark, "k"))):
        assert sorted((str(r["chunk_id"]), round(r["score"], 9)) for r in found.best(["x", "z"], 10).collect()) == want
