"""What graph queries shuffle and hold goes by what they ask for, not by all edges."""

import re

import pytest
from pyspark.sql import functions as F

from sparkloft import views
from sparkloft.operators import graph

SF = "/root/testdata/sf0.01"


@pytest.fixture
def no_small_tables(spark):
    """As with large tables: nothing is broadcast that is not known to be few."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_degrees_of_a_neighborhood_meet_edges_where_they_are_read(spark, no_small_tables):
    nodes, edges = (views.view(spark, SF, x) for x in ("nodes", "edges"))
    near = graph.neighborhood(nodes, edges, ("nation:3", "region:1"), 200, ("geo",))[1]
    shuffled = re.findall(r"SortMergeJoin.*__end", plan(near))
    assert "__end" in plan(near) and not shuffled


def test_filters_on_nodes_reach_the_tables_that_edges_are_made_of(spark):
    edges = views.view(spark, SF, "edges")
    found = graph.neighbors(None, edges, ("order:7", "part:3"))
    assert found.count() == edges.where("valid_until IS NULL AND (source_id IN ('order:7', 'part:3') OR target_id IN ('order:7', 'part:3'))").count() > 0
    joined = plan(found).split("Join")[1:]
    assert joined and all("order:7" in side or "part:3" in side for side in joined)
    odd = spark.createDataFrame([("1", None, "x", "a", None), ("2", "a", "x", "a", None), ("3", "b", "x", None, None)], "id string, source_id string, label string, target_id string, valid_until string")
    assert [r["id"] for r in graph.neighbors(None, odd, ("a",)).collect()] == ["1", "2"]


@pytest.mark.parametrize("few", [10_000, 0])
def test_edges_at_few_names_are_found_once(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_NODES", few, raising=False)
    nodes, edges = (views.view(spark, SF, x) for x in ("nodes", "edges"))
    edges = edges.where("label <> 'calls'").withColumns({"chunk_id": F.concat(F.lit("c"), F.crc32("id") % 7), "weight": (F.crc32("id") % 5).cast("double")})
    chunks = spark.range(7).select(F.concat(F.lit("c"), "id").alias("chunk_id"))
    out = graph.graph_chunks(nodes, edges, chunks, "which NATION_1 has ASIA", 10)
    e = {r["id"]: r for r in edges.where("valid_until IS NULL").collect()}
    rows = graph._matches(nodes, edges, "which NATION_1 has ASIA", False)
    got = sorted((r["entity"], r["subject"], r["predicate"], r["object"], r["subject_type"], r["object_type"], r["id"]) for r in rows.collect())
    n = {r["id"]: r for r in graph.visible(nodes).collect()}
    want = []
    for name in ("NATION_1", "ASIA"):
        for x in e.values():
            ends = [n.get(x["source_id"]), n.get(x["target_id"])]
            want += [(name, ends[0]["name"], x["label"], ends[1]["name"], ends[0]["label"], ends[1]["label"], x["id"]) for y in ends if None not in ends and name.lower() in y["name"].lower()]
    assert got == sorted(want) and got
    assert out.count() > 0
    if few:
        assert not any("lineitem" in f for f in rows.inputFiles())


def test_triples_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "KEYED_OF_A_TASK", 100, raising=False)
    rows = spark.range(1000).select(
        F.concat(F.lit("s"), F.col("id") % 450).alias("subject"), F.lit("made_by").alias("predicate"), F.concat(F.lit("o"), F.col("id") % 450).alias("object"),
        F.lit("f").alias("source_file"), F.lit("c").alias("chunk_id"), F.create_map(F.lit("note"), F.lit("y")).alias("properties"),
    )
    out = graph.triple_edges(rows, "2024")
    assert out.count() == 450
    assert out.rdd.getNumPartitions() == 10  # each holds about a hundred, however large a partition may be
    assert plan(out).split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
