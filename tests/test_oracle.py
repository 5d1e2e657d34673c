"""Every query of the engine against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from sparkloft.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    assert compare(spark, duck, catalog.queries()[name], catalog.oracle_sql()[name], SF) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


CASES = [n for n, f in catalog.queries().items() if n in (
    "absence_metric_day absence_domain_day absence_source_day graph_impact_hub graph_by_type_files graph_chunks_nations tier_forget_source tier_extract_orders "
    "files_of_presets records_rules_by_metric question_scan_plans question_routes question_names folders_debounced fulltext_phrase fulltext_boolean fulltext_exclusion "
    "vector_indexed_topk text_stems_languages language_detected"
).split()]


@pytest.mark.parametrize("name", CASES)
def test_has_rows(spark, name):
    """An equal result proves something only where there is one."""
    assert catalog.queries()[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1


def test_languages_of_unseen_texts(spark):
    from pyspark.sql import functions as F

    from sparkloft.operators.language_profiles import Profiles, counts, detected

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = Profiles.of(counts(docs.where("doc_id % 2 = 0")))
    asked = docs.where("doc_id % 2 = 1").select("lang", detected(F.col("text"), profiles).alias("found"))
    right, n = asked.agg(F.count_if(F.col("lang") == F.col("found")), F.count("*")).first()
    assert right >= 0.98 * n, (right, n)
    odd = spark.createDataFrame([(None,), ("",), ("12 ..",), ("日本",)], "t string").select(detected(F.col("t"), profiles, ("de", "fr"), "xx").alias("l")).collect()
    assert [r["l"] for r in odd] == ["xx"] * 4
    one = spark.createDataFrame([("der die und",)], "t string")
    assert one.select(detected(F.col("t"), profiles, ("fr",)).alias("l")).first()[0] == "fr"
