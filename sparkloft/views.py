"""Engine tables as projections of the star schema, events and documents; one SQL text serves Spark and the oracle.

Every projection is a plain select, so Catalyst prunes columns and pushes filters through it into the Parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Dialect:
    """What Spark and the oracle's SQL write differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def iso(self, ts: str) -> str:
        return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\")" if self.spark else f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')" if self.spark else f"strftime({ts}, '%Y-%m-%d')"

    def week(self, ts: str) -> str:
        return f"concat(CAST(extract(YEAROFWEEK FROM {ts}) AS STRING), '-W', lpad(CAST(weekofyear({ts}) AS STRING), 2, '0'))" if self.spark else f"strftime({ts}, '%G-W%V')"

    def month(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM')" if self.spark else f"strftime({ts}, '%Y-%m')"

    def epoch(self, ts: str) -> str:
        return f"unix_timestamp({ts})" if self.spark else f"CAST(floor(epoch({ts})) AS BIGINT)"

    def plus_days(self, ts: str, n: str) -> str:
        return f"timestampadd(DAY, CAST({n} AS INT), {ts})" if self.spark else f"({ts} + CAST({n} AS INT) * INTERVAL 1 DAY)"

    def day_zero(self, n: str) -> str:
        return self.day(self.plus_days("TIMESTAMP '2024-01-01 00:00:00'", n))

    def json_k(self, c: str) -> str:
        return f"CAST(get_json_object({c}, '$.k') AS BIGINT)" if self.spark else f"CAST(json_extract_string({c}, '$.k') AS BIGINT)"


_S = "CAST({} AS STRING)".format
_SENSITIVE = "CASE WHEN {} % 17 = 0 THEN 'private' ELSE 'normal' END".format


def _views(d: Dialect) -> dict[str, str]:
    records = f"""
        SELECT event_id AS id, concat('u', {_S('user_id')}) AS subject, event_type AS metric, value,
               CASE WHEN event_type = 'purchase' THEN 'USD' ELSE 'count' END AS unit, {d.iso('ts')} AS ts,
               {d.week('ts')} AS iso_week, {d.month('ts')} AS ym, concat('d', {_S('event_id % 4')}) AS domain,
               concat('src', {_S('user_id % 3')}) AS source, concat('s', {_S('event_id % 100')}) AS source_id,
               CAST(CASE WHEN event_type = 'error' THEN 0.3 ELSE 1.0 END AS DOUBLE) AS confidence,
               {_SENSITIVE('user_id')} AS sensitivity
        FROM events"""
    chunks = f"""
        SELECT concat('chunk_', substr(md5(concat(source, '_', {_S('doc_id')})), 1, 16)) AS chunk_id, doc_id, text,
               concat('docs/', source, '/', {_S('doc_id')}, '.md') AS source,
               CASE doc_id % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'session_decision' ELSE 'doc' END AS source_type,
               lang AS language, concat({d.day_zero('doc_id % 365')}, 'T00:00:00') AS created_at,
               concat('d', {_S('doc_id % 3')}) AS domain, CASE WHEN doc_id % 7 = 0 THEN 'reference' ELSE 'user' END AS authority,
               {_SENSITIVE('doc_id')} AS sensitivity, source AS folder, n_chars
        FROM documents"""
    vectors = """
        SELECT c.chunk_id, e.vec_id, e.embedding, c.source_type, c.language, c.created_at, c.domain, c.authority, c.sensitivity, c.source
        FROM embeddings e JOIN ({chunks}) c ON c.doc_id = e.vec_id""".replace("{chunks}", chunks)
    turns = f"""
        SELECT conv_id AS session_id, turn AS idx, role, 'text' AS kind, text, {d.day_zero('conv_id % 28')} AS day,
               {d.week(d.plus_days("TIMESTAMP '2024-01-01 00:00:00'", 'conv_id % 28'))} AS iso_week,
               concat('tool', {_S('conv_id % 3')}) AS tool, {_SENSITIVE('conv_id')} AS sensitivity
        FROM conversations"""
    nodes = f"""
        SELECT concat('region:', {_S('r_regionkey')}) AS id, r_name AS name, 'Region' AS label, 'geo' AS domain, 'normal' AS sensitivity FROM region
        UNION ALL SELECT concat('nation:', {_S('n_nationkey')}), n_name, 'Nation', 'geo', 'normal' FROM nation
        UNION ALL SELECT concat('customer:', {_S('c_custkey')}), c_name, 'Person', 'sales', {_SENSITIVE('c_custkey')} FROM customer
        UNION ALL SELECT concat('supplier:', {_S('s_suppkey')}), s_name, 'Organization', 'sales', 'normal' FROM supplier
        UNION ALL SELECT concat('part:', {_S('p_partkey')}), p_name, 'File', 'code', 'normal' FROM part
        UNION ALL SELECT concat('order:', {_S('o_orderkey')}), concat('commit ', {_S('o_orderkey')}), 'Commit', 'code', 'normal' FROM orders"""
    ended = f"CASE WHEN o_orderstatus = 'F' THEN {d.iso(d.plus_days('o_orderdate', '90'))} END"
    edges = f"""
        SELECT concat(source_id, '|', label, '|', target_id) AS id, source_id, target_id, label, source_file, valid_from, valid_until FROM (
        SELECT concat('nation:', {_S('n_nationkey')}) AS source_id, concat('region:', {_S('n_regionkey')}) AS target_id, 'in' AS label, 'geo.csv' AS source_file, '1990-01-01T00:00:00' AS valid_from, CAST(NULL AS STRING) AS valid_until FROM nation
        UNION ALL SELECT concat('customer:', {_S('c_custkey')}), concat('nation:', {_S('c_nationkey')}), 'in', 'geo.csv', '1990-01-01T00:00:00', NULL FROM customer
        UNION ALL SELECT concat('supplier:', {_S('s_suppkey')}), concat('nation:', {_S('s_nationkey')}), 'in', 'geo.csv', '1990-01-01T00:00:00', NULL FROM supplier
        UNION ALL SELECT concat('order:', {_S('o_orderkey')}), concat('customer:', {_S('o_custkey')}), 'authored_by', concat('log', {_S('o_orderkey % 10')}), {d.iso('o_orderdate')}, {ended} FROM orders
        UNION ALL SELECT DISTINCT concat('order:', {_S('o_orderkey')}), concat('part:', {_S('l_partkey')}), 'modifies', concat('log', {_S('o_orderkey % 10')}), {d.iso('o_orderdate')}, {ended} FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        UNION ALL SELECT concat('part:', {_S('p_partkey')}), concat('part:', {_S('p_partkey - p_size')}), CASE WHEN p_partkey % 2 = 0 THEN 'calls' ELSE 'depends_on' END, concat('mod', {_S('p_partkey % 50')}), '1995-01-01T00:00:00', NULL FROM part WHERE p_partkey > p_size)
        AS e"""
    edge_sources = f"""
        SELECT concat('nation:', {_S('n_nationkey')}, '|in|region:', {_S('n_regionkey')}) AS id, concat('chunk_', substr(md5(concat(source, '_', {_S('doc_id')})), 1, 16)) AS chunk_id,
               CAST(1.0 - (doc_id % 10) / 20.0 AS DOUBLE) AS weight FROM documents JOIN nation ON n_nationkey = doc_id % 25"""
    query_log = f"""
        SELECT event_id AS id, CAST({d.epoch('ts')} AS DOUBLE) AS ts, event_type AS mode, concat('q', {_S('user_id % 97')}) AS query, value AS latency_ms,
               {d.json_k('props')} % 4 AS result_count, concat({d.day('ts')}, {"date_format(ts, ' HH:00')" if d.spark else "strftime(ts, ' %H:00')"}) AS hour FROM events"""
    usage = f"""
        SELECT CAST(floor({d.epoch('ts')} / 60) AS BIGINT) AS bucket, event_type AS channel, concat('p', {_S('user_id % 2')}) AS provider, concat('m', {_S('user_id % 3')}) AS model,
               concat('src', {_S('user_id % 5')}) AS source, {d.json_k('props')} AS tokens_in, CAST(floor(value) AS BIGINT) AS tokens_out, CAST(1 AS BIGINT) AS calls,
               CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS errors, event_id FROM events"""
    alias = f"""
        SELECT c_mktsegment AS surface, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('scope', {_S('c_nationkey % 4')}) END AS scope, concat('customer:', {_S('c_custkey')}) AS person_id,
               concat({d.day_zero('c_custkey % 200')}, 'T00:00:00') AS valid_from, CASE WHEN c_custkey % 2 = 0 THEN concat({d.day_zero('c_custkey % 200 + 60')}, 'T00:00:00') END AS valid_to FROM customer"""
    link = f"""
        SELECT o_orderkey AS id, concat('session:', {_S('o_orderkey % 50')}, '#', {_S('o_orderkey % 6')}) AS ref, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('customer:', {_S('o_custkey')}) END AS person_id,
               o_orderpriority AS method, (o_orderkey % 11 = 0) AS stale FROM orders"""
    memories = f"""
        SELECT concat('mem_', {_S('doc_id')}) AS id, text, concat('section', {_S('doc_id % 4')}) AS section, CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE concat('session:', {_S('doc_id % 20')}) END AS origin,
               CAST((doc_id % 10) AS DOUBLE) / 10 AS confidence, {d.day_zero('doc_id % 300')} AS created_at, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE {d.day_zero('doc_id % 350')} END AS last_referenced_at,
               (doc_id % 8 <> 0) AS active, {_SENSITIVE('doc_id')} AS sensitivity, doc_id FROM documents"""
    checksum = "md5(text)"
    disk = f"SELECT concat('docs/', source, '/', {_S('doc_id')}) AS path, {checksum} AS checksum, doc_id AS mtime, source AS folder, doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents".replace(
        "strlen(text)", "octet_length(text)" if d.spark else "strlen(text)"
    )
    prior = f"""
        SELECT concat('docs/', source, '/', {_S('doc_id')}) AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE {checksum} END AS checksum, CASE WHEN doc_id % 7 = 0 OR doc_id % 9 = 0 THEN doc_id - 1 ELSE doc_id END AS mtime,
               source AS folder, concat('chunk_', substr(md5(concat(source, '_', {_S('doc_id')})), 1, 16)) AS chunk_id, (doc_id % 31 = 0) AS pending_reindex, doc_id FROM documents WHERE doc_id % 10 <> 0
        UNION ALL SELECT concat('gone/', {_S('doc_id')}), 'gone', doc_id, source, concat('chunk_gone_', {_S('doc_id')}), false, doc_id FROM documents WHERE doc_id % 40 = 3"""
    files = {
        "records": records, "chunks": chunks, "vectors": vectors, "turns": turns, "nodes": nodes, "edges": edges, "edge_sources": edge_sources,
        "query_log": query_log, "usage": usage, "alias": alias, "link": link, "memories": memories, "disk": disk, "manifest_prior": prior
    }
    return files


SPARK_VIEWS = _views(Dialect(True))
ORACLE_VIEWS = _views(Dialect(False))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TABLE = re.compile(r"(?<=FROM |JOIN )(" + "|".join(TABLES) + r")\b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An engine table (or a base table) as a DataFrame; nothing is registered in the session's catalog."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SPARK_VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(text))}
    return spark.sql(_TABLE.sub(r"{\1}", text), **frames)


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL over engine tables: their projections become common table expressions."""
    return "WITH RECURSIVE " + ",\n".join(
        f"{n} AS ({ORACLE_VIEWS[n]})" for n in names
    ) + ("," if sql.lstrip().startswith(",") else "") + "\n" + sql.lstrip().removeprefix(",")


_INDEXES: dict[tuple, tuple] = {}


def _built(spark: SparkSession, sf_dir: str, table: str, kind: str, make):
    """An index of a folder's table: built at the first call in a session, and again, in place of the old one, if the table changes."""
    from sparkloft.storage import drop, folder

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _INDEXES or _INDEXES[key][0] != state:
        if key in _INDEXES:
            drop(spark, _INDEXES[key][1].path)
        _INDEXES[key] = (state, make(folder(spark, kind)))
    return _INDEXES[key][1]


def keyword_index(spark: SparkSession, sf_dir: str):
    """The written keyword index of the chunks of a folder."""
    from sparkloft.operators.keyword_index import KeywordIndex

    def make(path: str) -> KeywordIndex:
        index = KeywordIndex(spark, path)
        index.add(view(spark, sf_dir, "chunks"))
        return index

    return _built(spark, sf_dir, "documents", "keyword-index", make)


def vector_index(spark: SparkSession, sf_dir: str):
    """The written vector index of the embeddings of a folder."""
    from sparkloft.operators.vector_index import VectorIndex

    return _built(spark, sf_dir, "embeddings", "vector-index", lambda path: VectorIndex(spark, path).build(view(spark, sf_dir, "vectors")))


def fulltext_index(spark: SparkSession, sf_dir: str, fields: dict[str, float]):
    """The written positional index of the chunks of a folder."""
    from sparkloft.operators.fulltext import FulltextIndex

    return _built(spark, sf_dir, "documents", f"fulltext-index-{'-'.join(fields)}", lambda path: FulltextIndex(spark, path, fields).build(view(spark, sf_dir, "chunks")))
