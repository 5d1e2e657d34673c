"""Each stage of the pipeline against a plain version, on its own input, over whole tables."""

import os

import brute
import numpy as np
from oracle import compare, connect

import corpus_pipeline
from sparkloft.llm import queries as q
from sparkloft.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["toxicity", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    rows = sorted(tuple(r) for r in docs.collect())
    at = {c: i for i, c in enumerate(docs.columns)}

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), lambda fold: True)
    want = [r for r, s in zip(rows, toxicity.score_texts(model, [r[at["text"]] for r in rows], {}), strict=True) if s < 0.7]
    one = by["toxicity"](spark, docs, SF).cache()
    assert one.schema == docs.schema and sorted(tuple(r) for r in one.collect()) == want

    two = by["line_dedup"](spark, one, SF).cache()
    text = brute.lines([(r[at["doc_id"]], r[at["source"]], r[at["text"]]) for r in want], 0.05, 3)
    assert two.columns == docs.columns and {r["doc_id"]: r["text"] for r in two.collect()} == text

    three = by["simhash_near_dedup"](spark, two, SF).cache()
    groups = brute.near_duplicates(sorted(text.items()))
    kept = sorted(set(groups.values()))
    assert three.columns == docs.columns and sorted(r["doc_id"] for r in three.collect()) == kept

    four = by["suffix_array_dedup"](spark, three, SF).cache()
    gone = brute.passages([(i, text[i]) for i in kept])
    got = {r["doc_id"]: r["text"] for r in four.collect()}
    assert four.columns == docs.columns
    assert got == {
        i: text[i] if not gone[i].any() else np.frombuffer(text[i].encode(), np.uint8)[~gone[i]].tobytes().decode("utf-8", "ignore") for i in kept
    }

    five = by["packing"](spark, four, SF).collect()
    assert {r["doc_id"] for r in five} == set(kept)
    assert sum(r["length"] for r in five) == sum({r["doc_id"]: r["doc_tokens"] for r in five}.values())


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, extra columns, and no rows at all."""
    line = "a line of a page that many pages have"
    rows = [(i, f"{line}\nown words {i} " + " ".join(f"w{i}x{k}" for k in range(40)), "en", "s0") for i in range(30)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (None, "no id", "en", "s1"), (102, "x " * 50_000, "en", "s1")]
    rows += [(103, "the same text twice, the same text twice", "en", "s1")] * 2 + [(104, rows[0][1], "en", "s2")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1.0, "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        kept[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
    ids = sorted(str(r[0]) for r in rows)
    same = lambda name: sorted(str(r["doc_id"]) for r in kept[name])
    assert same("toxicity") == same("line_dedup") == same("suffix_array_dedup") == ids
    assert all(line not in (r["text"] or "") for r in kept["line_dedup"] if r["source"] == "s0")
    gone = sorted(set(ids) - set(same("simhash_near_dedup")))
    assert gone == ["101", "104"] and same("simhash_near_dedup").count("103") == 2  # empty texts link, as do copies; repeated ids stay
    assert next(r["text"] for r in kept["suffix_array_dedup"] if r["doc_id"] == 104) == "" and sum(r["length"] for r in kept["packing"]) > 50_000


def test_run(spark):
    """The stages one after the other give what run() gives, piece by piece."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    pieces = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in df.collect())
    run = corpus_pipeline.run(spark, SF)
    tokens = lambda found: {i: n for i, _, _, _, n in found}
    a, b = pieces(docs), pieces(run)
    assert tokens(a) == tokens(b) and sum(x[2] for x in a) == sum(x[2] for x in b) == sum(tokens(a).values())
    assert {r["sequence_id"] for r in run.collect()} == set(range(-(-sum(tokens(b).values()) // 1024)))


def test_line_dedup_sql(spark):
    assert compare(spark, connect(SF), q.queries()["op1_line_dedup"], q.oracle_sql()["op1_line_dedup"], SF) is None


def test_threshold_search_sql(spark):
    assert compare(spark, connect(SF), q.queries()["op11_threshold_search"], q.oracle_sql()["op11_threshold_search"], SF) is None


def test_names():
    assert os.path.exists(corpus_pipeline.__file__) and sorted(n.split("_")[0] for n in q.queries()) == sorted(
        [*(f"op{k}" for k in range(1, 14)), "pipeline"]
    )
