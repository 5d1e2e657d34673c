"""Chunk statistics, incremental diffs, upserts and session structure."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from sparkloft.functions.text import rendered_turn, token_estimate
from sparkloft.operators.ordered import newest


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Merge emulation: the last of ``new`` for each key replaces the old row."""
    last = newest(new, tuple(key), order)
    return old.join(last.select(*key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def replace_source(old: DataFrame, new: DataFrame, source_id: str) -> DataFrame:
    """All rows of a source give way to the new ones; rows without a source stay."""
    return old.where(~F.col("source_id").eqNullSafe(F.lit(source_id))).unionByName(new)


def delete_where(rows: DataFrame, where: Column) -> DataFrame:
    """Rows that do not match; a null condition does not match."""
    return rows.where(~F.coalesce(where, F.lit(False)))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    t = token_estimate(F.col("text"))
    return chunks.agg(
        F.count("*").alias("chunks"), F.avg(t).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"),
        F.sum(t).alias("total_tokens"), F.countDistinct("source").alias("sources"), F.countDistinct("language").alias("languages")
    )


def token_budget(chunks: DataFrame, floor: int = 50_000, ratio: float = 2.0, chunk_size: int = 512) -> DataFrame:
    out = chunks.agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("chunks"))
    return out.withColumn(
        "budget", F.greatest(F.lit(floor), (F.lit(ratio) * F.col("chunks") * chunk_size).cast("long"))
    ).withColumn("over", F.col("tokens") > F.col("budget"))


def manifest_diff(
    prior: DataFrame, disk: DataFrame, on_disk: DataFrame | None = None, large: int | None = None, now: float = 0.0, cooldown: float = 0.0
) -> DataFrame:
    """(path, state): added, changed, deleted, unchanged, out_of_scope or deferred.

    prior and disk: (path, checksum, mtime[, pending_reindex]). An equal mtime is trusted; else the checksum decides; a
    pending file is changed. A prior file that was not loaded is deleted only if ``on_disk`` (path) lacks it. With ``large``, a changed file
    of so many bytes (disk has size_bytes, prior embedded_at) is deferred until ``cooldown`` seconds after its last embedding.
    """
    p = prior.select(
        "path", F.col("checksum").alias("old_sum"), F.col("mtime").alias("old_time"), F.col("pending_reindex").alias("pending"),
        F.lit(True).alias("had"), *([F.col("embedded_at")] if large else [])
    )
    d = disk.select(
        "path", F.col("checksum").alias("new_sum"), F.col("mtime").alias("new_time"), F.lit(True).alias("has"),
        *([F.col("size_bytes")] if large else [])
    )
    both = p.join(d, "path", "full_outer")
    still = F.lit(False)
    if on_disk is not None:
        both = both.join(on_disk.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
        still = F.coalesce("there", F.lit(False))
    state = (
        F.when(F.col("had").isNull(), "added")
        .when(F.col("has").isNull(), F.when(still, "out_of_scope").otherwise("deleted"))
        .when(F.coalesce("pending", F.lit(False)), "changed")
        .when((F.col("old_time") == F.col("new_time")) | (F.col("old_sum") == F.col("new_sum")), "unchanged")
        .otherwise("changed")
    )
    if large:
        soon = (F.col("size_bytes") >= large) & (F.lit(now) - F.col("embedded_at") < cooldown)
        state = F.when((state == "changed") & F.coalesce(soon, F.lit(False)), "deferred").otherwise(state)
    return both.select("path", state.alias("state"))


def lost_chunks(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """(path, missing): files whose manifest names chunks that the store lacks."""
    return manifest.join(store.select("chunk_id"), "chunk_id", "left_anti").groupBy("path").agg(F.count("*").alias("missing"))


def delta(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, state): new, kept or stale ids of a source's next version."""
    a = stored.select("chunk_id", F.lit(True).alias("old")).distinct()
    b = new.select("chunk_id", F.lit(True).alias("now")).distinct()
    state = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "stale").otherwise("kept")
    return a.join(b, "chunk_id", "full_outer").select("chunk_id", state.alias("state"))


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of texts whose content hash has no cached embedding. cache: (content_hash)."""
    return texts.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256)).join(
        cache.select("content_hash").distinct(), "content_hash", "left_anti"
    )


def session_windows(turns: DataFrame, size: int = 4, stride: int = 2, keep_tail: bool = False, with_tools: bool = False) -> DataFrame:
    """(session_id, window, first_idx, span, text): turns in windows of ``size`` every ``stride``.

    A short window is made only at a session's start, unless ``keep_tail``. A turn knows from its number which windows hold it, so
    no window frame over the session's rows is sorted more than once. ``with_tools`` (turns then have tool_name, tool_inputs) adds tools and
    files, the different names and file paths of a window's tool calls, and renders each kind of turn in its own way.
    """
    w = W.Window.partitionBy("session_id").orderBy("idx")
    n = W.Window.partitionBy("session_id")
    rows = turns.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(n))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / stride)).cast("int")
    last = F.floor(F.col("i") / stride).cast("int")
    rows = rows.withColumn("window", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    full = F.col("window") * stride + size <= F.col("n")
    if not keep_tail:
        rows = rows.where((F.col("window") == 0) | full)
    if with_tools:
        line = rendered_turn(F.col("role"), F.col("kind"), F.col("text"), F.col("tool_name"))
        extra = (F.col("tool_name").alias("tool"), F.try_element_at("tool_inputs", F.lit("file_path")).alias("file"))
    else:
        line, extra = F.concat(F.col("role"), F.lit(": "), F.col("text")), ()
    grouped = rows.groupBy("session_id", "window").agg(F.sort_array(F.collect_list(F.struct("i", "idx", line.alias("line"), *extra))).alias("t"))
    named = [
        F.array_sort(F.array_distinct(F.filter(F.transform("t", _field(f)), lambda v: v.isNotNull()))).alias(c) for f,
        c in (("tool", "tools"), ("file", "files"))
    ] if extra else []
    text = F.array_join(F.transform("t", lambda x: x.line), "\n").alias("text")
    return grouped.select("session_id", "window", F.col("t")[0]["idx"].alias("first_idx"), F.size("t").alias("span"), text, *named)


def _field(name: str):
    return lambda x: x[name]


def count_records(extractions: DataFrame) -> DataFrame:
    """(session_id, metric, value, unit): lengths of an extraction's lists as records."""
    names = ("files_touched", "tools_used", "decisions", "open_threads")
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.size(m), F.lit(0)).cast("double").alias("value")) for m in names]))
    return extractions.select("session_id", rows.alias("r")).select(
        "session_id", "r.metric", "r.value", F.lit("count").alias("unit")
    ).where("value > 0")


def merge_first(prior: DataFrame, new: DataFrame, key: str, text: str, newest_wins: bool = False) -> DataFrame:
    """Union by trimmed, lower-cased text within ``key``: items (key, pos, text), earlier ones before new ones. Of items of one text the
    first stays, or with ``newest_wins``, as for files, the last."""
    both = prior.select(key, "pos", text, F.lit(0).alias("gen")).unionByName(new.select(key, "pos", text, F.lit(1).alias("gen")))
    order = (F.desc("gen"), F.desc("pos")) if newest_wins else ("gen", "pos")
    w = W.Window.partitionBy(key, F.lower(F.trim(F.col(text)))).orderBy(*order)
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def resume_offset(turns: DataFrame) -> DataFrame:
    """(session_id, offset): largest terminal index below the first turn in flight, -1 if there is none. turns: (session_id, idx, terminal)."""
    flight = turns.groupBy("session_id").agg(F.min(F.when(~F.col("terminal"), F.col("idx"))).alias("flight"))
    done = turns.join(flight, "session_id").where(F.col("terminal") & (F.col("flight").isNull() | (F.col("idx") < F.col("flight"))))
    return flight.select("session_id").join(
        done.groupBy("session_id").agg(F.max("idx").alias("offset")), "session_id", "left"
    ).select("session_id", F.coalesce("offset", F.lit(-1).cast("long")).alias("offset"))


def parse_triplets(rows: DataFrame) -> DataFrame:
    """(id, pos, subject, predicate, object) from lines "a | type | p | b | type" or "a | p | b"; other lines are dropped."""
    lines = rows.select("id", F.posexplode(F.split("response", "\n")).alias("pos", "line"))
    p = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    lines = lines.withColumn("p", p).where((F.size("p") == 3) | (F.size("p") >= 5))
    five = F.size("p") >= 5
    out = lines.select(
        "id", "pos", F.col("p")[0].alias("subject"), F.when(five, F.col("p")[2]).otherwise(F.col("p")[1]).alias("predicate"),
        F.when(five, F.get(F.col("p"), F.lit(3))).otherwise(F.col("p")[2]).alias("object")
    )
    return out.where("subject <> '' and predicate <> '' and object <> ''")


def extraction_prompt(text: str, most: int) -> str:
    """What a language model is asked for a text's triplets; parse_triplets reads the answer."""
    return (
        f"List at most {most} facts of the text below, one a line, as\nsubject | subject type | relation | object | object type\n"
        f"Use short names. Write nothing else.\n\n{text}"
    )


def extract_triplets(chunks: DataFrame, provider: Callable[[list[str]], list[str]], most: int = 10, chars: int = 4000) -> DataFrame:
    """(id, pos, subject, predicate, object) that a provider (prompts to answers, called with batches) finds in chunks (chunk_id, text).

    Only the first ``chars`` characters are shown to it, as its context is bounded; ``most`` triplets of a chunk are kept.
    """

    def ask(batches):
        for pdf in batches:
            answers = provider([extraction_prompt((t or "")[:chars], most) for t in pdf["text"]]) if len(pdf) else []
            yield pd.DataFrame({"id": pdf["chunk_id"], "response": list(answers)})

    said = chunks.where("trim(text) <> ''").select("chunk_id", "text").mapInPandas(ask, "id string, response string")
    w = W.Window.partitionBy("id").orderBy("pos")
    return parse_triplets(said).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def summarised(texts: DataFrame, provider: Callable[[list[str]], list[str]], out: str = "summary") -> DataFrame:
    """Texts with what a summarisation provider, called with batches, makes of them; null texts have none."""
    schema = T.StructType([*texts.schema.fields, T.StructField(out, T.StringType())])

    def ask(batches):
        for pdf in batches:
            pdf[out] = None
            known = pdf["text"].notna()
            if known.any():
                pdf.loc[known, out] = list(provider(pdf.loc[known, "text"].tolist()))
            yield pdf

    return texts.mapInPandas(ask, schema)


def unseen_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks of sessions whose content-based id the store lacks, each once: what was indexed before is not indexed again."""
    return chunks.dropDuplicates(["chunk_id"]).join(store.select("chunk_id"), "chunk_id", "left_anti")


def due_folders(changes: DataFrame, queued: DataFrame, now: float, cooldown: float = 10.0) -> DataFrame:
    """(folder, files): folders with changed files (path, folder) that were not queued within the cooldown. queued: (folder, at)."""
    recent = queued.groupBy("folder").agg(F.max("at").alias("at")).where(F.lit(now) - F.col("at") < cooldown)
    return changes.join(recent, "folder", "left_anti").groupBy("folder").agg(F.countDistinct("path").alias("files"))
