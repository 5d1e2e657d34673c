"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloft.llm.common import checkpointed

RATIO = 0.05  # a line on more than this share of its host's pages is boilerplate
MIN_PAGES = 3  # and on at least so many pages
BROADCAST_LINES = 200_000  # 32-byte line keys: at most about 10 MB are broadcast


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line):
    return F.md5(F.trim(line).cast("binary"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): for each host the keys of the lines found on more than ``ratio`` of its pages.

    A line counts once a page, trimmed; blank lines never count. Counts are combined before the shuffle, so a hot host or
    line sends one row a task. A host has fewer than (lines of a mean page) / ratio such lines.
    """
    host = F.coalesce("source", F.lit("")).alias("host")
    pages = docs.groupBy(host).agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    seen = docs.select(host, F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = seen.join(pages, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def line_dedup(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of text; one row for each row, other columns unchanged but n_chars.

    docs: (source, text, ...). The host is source; rows with a null source share one host. n_chars, where there is such a column,
    becomes the length of the new text. Kept lines keep their order, spacing and repeats. A null text stays null
    and counts as a page; a text of boilerplate only becomes empty. Repeated rows are pages of their own.
    Adds two columns: __lines and __dropped, the numbers of lines before and after trimming away (null for null texts).
    """
    found = checkpointed(boilerplate(docs, ratio, min_pages).select(F.col("host").alias("__host"), F.col("lines").alias("__drop")))
    size = found.agg(F.coalesce(F.sum(F.size("__drop")), F.lit(0))).first()[0]
    if size <= BROADCAST_LINES:
        found = F.broadcast(found)
    text = F.col("text")
    out = docs.withColumn("__host", F.coalesce("source", F.lit(""))).join(found, "__host", "left")
    # the keys of a page that are boilerplate of its host: one hash set a row, not a scan for each line
    hits = F.array_intersect(F.transform(_lines(text), _key), F.col("__drop"))
    out = out.withColumn("__hits", F.when(F.col("__drop").isNotNull(), hits))
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col("__hits"), _key(x)))
    some = F.size("__hits") > 0
    before = F.size(_lines(text))
    out = out.withColumn("__lines", F.when(text.isNotNull(), before)).withColumn("__kept", F.when(some, kept))
    out = out.withColumn("__dropped", F.when(text.isNotNull(), F.when(some, before - F.size("__kept")).otherwise(0)))
    out = out.withColumn("text", F.when(some, F.array_join("__kept", "\n")).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, "__lines", "__dropped")


ORACLE_SQL = f"""
WITH line AS (
  SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
pages AS (SELECT coalesce(source, '') AS host, count(*) AS pages FROM documents GROUP BY 1),
seen AS (SELECT host, trim(l) AS l, count(DISTINCT doc_id) AS n FROM line WHERE trim(l) <> '' GROUP BY 1, 2),
often AS (SELECT s.host, s.l FROM seen s JOIN pages p ON s.host = p.host WHERE s.n >= {MIN_PAGES} AND s.n > CAST({RATIO} AS DOUBLE) * p.pages),
kept AS (
  SELECT line.doc_id, string_agg(line.l, chr(10) ORDER BY i) FILTER (WHERE o.l IS NULL) AS text, count(*) AS n_lines, count(o.l) AS n_dropped
  FROM line LEFT JOIN often o ON o.host = line.host AND o.l = trim(line.l) GROUP BY 1)
SELECT d.doc_id, d.source, coalesce(k.text, CASE WHEN d.text IS NULL THEN NULL ELSE '' END) AS text,
       CAST(k.n_lines AS INT) AS n_lines, CAST(k.n_dropped AS INT) AS n_dropped
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
