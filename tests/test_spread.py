"""Small rows that much work follows from are dealt out, however few files they come in."""

import pytest

from sparkloft.operators import code_blocks, code_graph, ordered
from sparkloft.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["code_chunks_blocks", "code_chunks", "code_imports"])
def test_texts_made_of_rows_of_one_file_are_many_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(ordered, "A_TASK", 100)
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    found = []
    spread = ordered.spread
    monkeypatch.setattr(f"sparkloft.plans.queries_{'cases' if name == 'code_chunks_blocks' else 'sources'}.spread", lambda *a: found.append(spread(*a)) or found[-1])
    catalog.queries()[name](spark, SF)
    assert found and found[0].rdd.getNumPartitions() == -(-parts // 100) and found[0].count() == parts


def test_declarations_are_found_the_same_from_masked_code():
    text = "pub struct A { x: i32 }\nimpl A {\n  fn run(&self) { call(\"}\"); /* {\n */ }\n}\n"
    code = code_blocks.masked(text, "rust")
    assert len(code) == len(text) and code.count("\n") == text.count("\n") and "call(   )" in code
    assert code_blocks.symbols(text, "rust", code) == code_blocks.symbols(text, "rust")
    assert code_blocks.split_blocks(text, "rust", 2, 40, code) == code_blocks.split_blocks(text, "rust", 2, 40)


@pytest.mark.parametrize("few", [0, 100])
def test_imports_meet_files_in_parts_of_a_fixed_number(spark, monkeypatch, few):
    monkeypatch.setattr(code_graph, "BROADCAST_FILES", few)
    imports = spark.range(300).selectExpr("concat('pkg/m', id, '.py') AS source_file", "concat('lib', id % 2) AS object")
    files = spark.createDataFrame([("pkg/lib0.py",), ("lib1/__init__.py",), ("lib0.py",)], "source string")
    found = code_graph.resolve_imports(imports, files)
    assert {(r["object"], r["target"]) for r in found.collect()} == {("lib0", "pkg/lib0.py"), ("lib1", "lib1/__init__.py")} and found.count() == 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # parts dealt by bytes held all rows, as these shrink well
