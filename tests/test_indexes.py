"""Written indexes: bounds, what a search reads, and results equal to a scan's."""

import numpy as np
import pytest

from sparkloft.operators import keyword_index, retrieval
from sparkloft.operators.keyword_index import KeywordIndex
from sparkloft.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 3
    x = centres[rng.integers(30, size=3000)] + rng.normal(size=(3000, 16)) * 0.3
    x[:5] = 0
    rows = [(f"c{i:04d}", v.tolist(), "even" if i % 2 == 0 else "odd") for i, v in enumerate(x.astype(np.float32))]
    rows += [("null", None, "odd"), ("short", [1.0], "odd"), ("hole", [1.0, None] + [0.0] * 14, "odd"), ("nan", [float("nan")] * 16, "odd")]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, kind string").repartition(5)
    return df, VectorIndex(spark, str(tmp_path_factory.mktemp("v") / "i")).build(df), x


def hits(df):
    return [(r["chunk_id"], round(r["score"], 9)) for r in df.orderBy(retrieval.F.desc("score"), "chunk_id").collect()]


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
def test_equals_a_scan_and_reads_few_lists(clustered, metric):
    df, index, x = clustered
    usable = df.where("chunk_id like 'c%'")
    shares = []
    for i in (7, 400, 1500):
        q = [float(v) for v in x[i]]
        for k, threshold in ((1, 0.0), (10, 0.0), (25, 0.7)):
            assert hits(index.search(q, k, threshold, metric)) == hits(retrieval.vector_search(usable, q, k, threshold, metric))
            shares.append(index.visited[0] / index.visited[1])
    if metric == "cosine":
        assert max(shares) < 0.5 and np.mean(shares) < 0.2, shares


def test_filters_zero_queries_and_more_rows_than_there_are(clustered):
    df, index, x = clustered
    usable = df.where("chunk_id like 'c%'")
    where = retrieval.F.col("kind") == "odd"
    q = [float(v) for v in x[9]]
    assert hits(index.search(q, 12, where=where)) == hits(retrieval.vector_search(usable, q, 12, where=where))
    assert hits(index.search([0.0] * 16, 7)) == hits(retrieval.vector_search(usable, [0.0] * 16, 7))
    assert hits(index.search(q, 5000, metric="l2")) == hits(retrieval.vector_search(usable, q, 5000, metric="l2"))


def test_plan_reads_the_named_partitions(clustered):
    df, index, x = clustered
    index.search([float(v) for v in x[400]], 5)
    plan = index._best(np.array([3, 4]), [float(v) for v in x[400]], 5, "cosine", None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_probes_give_most_of_the_neighbours(clustered):
    df, index, x = clustered
    usable = df.where("chunk_id like 'c%'")
    found = wanted = 0
    for i in (50, 800, 2100):
        q = [float(v) for v in x[i]]
        want = dict(hits(retrieval.vector_search(usable, q, 10)))
        found += len(want.keys() & dict(hits(index.search(q, 10, probes=6))).keys())
        wanted += len(want)
        assert index.visited[0] == 6
    assert found >= 0.9 * wanted


def test_segments_replace_and_forget(spark, clustered, tmp_path):
    df, _, x = clustered
    usable = df.where("chunk_id like 'c%'")
    index = VectorIndex(spark, str(tmp_path / "i")).build(usable.where("kind = 'odd'").withColumn("embedding", retrieval.F.reverse("embedding")))
    index.add(usable)
    index.remove(usable.where("chunk_id >= 'c2000'").select("chunk_id"))
    index.add(usable.where("chunk_id >= 'c2990'"))
    left = usable.where("chunk_id < 'c2000' or chunk_id >= 'c2990'")
    q = [float(v) for v in x[2995]]
    assert hits(index.search(q, 20)) == hits(retrieval.vector_search(left, q, 20))
    small = index.compact(str(tmp_path / "j"))
    assert hits(small.search(q, 20)) == hits(retrieval.vector_search(left, q, 20)) and len(small._segments()) == 1


def test_an_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id string, embedding array<float>")
    assert VectorIndex(spark, str(tmp_path / "i")).build(none).search([1.0], 3).count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(6)
    rows = [(f"d{i:05d}", " ".join(f"w{x}" for x in rng.zipf(1.25, 5 + int(rng.pareto(1.2) * 12) % 400) % 900)) for i in range(9000)]
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(4)


@pytest.fixture(scope="module")
def keywords(spark, texts, tmp_path_factory):
    index = KeywordIndex(spark, str(tmp_path_factory.mktemp("k") / "i"))
    index.add(texts)
    return index


@pytest.mark.parametrize("terms,k", [(("w1", "w2", "w3"), 10), (("w40", "w2"), 5), (("w300",), 20), (("w7", "nowhere"), 1), (("w1", "w5", "w9", "w11"), 60), (("w899",), 5000)])
def test_blocks_give_the_best_of_all_scores(texts, keywords, terms, k):
    got = hits(keywords.best(terms, k))
    assert got == hits(retrieval.top(keywords.scores(terms), k)) == hits(retrieval.top(retrieval.bm25_scores(texts, terms), k))
    assert keywords.read[0] <= keywords.read[1]
    if terms in (("w40", "w2"), ("w7", "nowhere")):
        assert keywords.read[0] < 0.5 * keywords.read[1], keywords.read


def test_hot_terms_are_split(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "TOKENS_A_FILE", 500)
    index = KeywordIndex(spark, str(tmp_path / "i"))
    index.add(texts)
    files = index._blocks(["w1"]).select(retrieval.F.input_file_name().alias("f"), "n").groupBy("f").agg(retrieval.F.sum("n").alias("n")).collect()
    assert len(files) > 1 and max(r["n"] for r in files) < 0.6 * sum(r["n"] for r in files)
    assert hits(index.best(("w1", "w2"), 10)) == hits(retrieval.top(retrieval.bm25_scores(texts, ("w1", "w2")), 10))


def test_rehome_and_nothing(spark, texts, keywords, tmp_path):
    moved = keywords.rehome("d000", "e/", str(tmp_path / "i"))
    want = [(c.replace("d000", "e/", 1) if c.startswith("d000") else c, s) for c, s in hits(keywords.scores(("w3",)))]
    assert sorted(hits(moved.scores(("w3",)))) == sorted(want)
    none = KeywordIndex(spark, str(tmp_path / "j"))
    assert none.best(("w1",), 3).count() == 0
    none.add(texts.limit(0))
    assert none.best(("w1",), 3).count() == 0 and none.best((), 3).count() == 0
