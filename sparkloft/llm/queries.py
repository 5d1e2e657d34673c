"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.line_dedup import line_dedup

    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "text", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


def op2_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.pq_dedup import embedding_links

    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.chat import format_turns, train

    turns = _table(spark, sf_dir, "conversations")
    return format_turns(turns, train(turns))


def op4_ann_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.ann import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op7_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.toxicity import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), " ")
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_toxic_words"), places.alias("toxic_spans"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.suffix_dedup import passage_digests

    return passage_digests(_table(spark, sf_dir, "documents"))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.threshold_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"))


def op13_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloft.llm.pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [
        op1_line_dedup, op2_embedding_pq, op3_chat_format, op4_ann_multiprobe, op5_html_extract, op6_mixture_packing, op7_simhash_vptree,
        op8_toxicity_crf, op9_suffix_array, op10_bpe_tree, op11_threshold_search, op12_merkle_trie, op13_weak_pii,
        pipeline
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from sparkloft.llm import line_dedup, threshold_search

    return {"op1_line_dedup": line_dedup.ORACLE_SQL, "op11_threshold_search": threshold_search.ORACLE_SQL}
