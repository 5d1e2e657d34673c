"""Transcripts of three formats as turns, and an archive of them partitioned by day and tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.functions.text import collapse

# Lengths that texts are cut to, and words of the step format.
TEXT, THINKING, RESULT, INPUT = 1500, 300, 240, 200
_MESSAGE = "type string, sessionId string, cwd string, gitBranch string, timestamp string, message struct<role:string, content:variant>"
_ROLLOUT = "timestamp string, type string, payload struct<type:string, role:string, name:string, session_id:string, cwd:string, timestamp:string, content:variant, summary:variant, arguments:variant, output:variant>"
_STEP = "step_index long, source string, type string, status string, created_at string, content string, thinking string, tool_calls array<struct<name:string, args:map<string,string>>>"
TERMINAL = ("DONE", "ERROR")
STEP_RESULTS = ("RUN_COMMAND", "VIEW_FILE", "GREP_SEARCH", "LIST_DIRECTORY", "SEARCH_WEB", "CODE_ACTION")
STEP_PATHS = ("AbsolutePath", "TargetFile", "SearchPath", "DirectoryPath")
TURN = "source_path string, idx long, role string, kind string, text string, tool_name string, tool_inputs map<string,string>, ts string, terminal boolean"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, line_no, value) of JSON-lines files; blank lines go. One file is one task's rows in file order."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("source_path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value")
    )
    return rows.where(F.trim("value") != "")


def _text(v: Column) -> Column:
    """Plain text of a string or of a list of text blocks."""
    blocks = F.try_variant_get(v, "$", "array<struct<type:string,text:string,thinking:string>>")
    return F.coalesce(
        F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n"), F.try_variant_get(v, "$", "string"), F.lit("")
    )


def _indexed(rows: DataFrame) -> DataFrame:
    w = W.Window.partitionBy("source_path").orderBy("line_no", "block")
    return rows.withColumn("idx", F.row_number().over(w).cast("long") - 1)


def message_turns(rows: DataFrame) -> DataFrame:
    """Turns of the message format: one for each text, thinking, tool call and tool result block, numbered in file order."""
    j = rows.select("source_path", "line_no", F.from_json("value", _MESSAGE).alias("j")).where(F.col("j.type").isin("user", "assistant"))
    content = F.col("j.message.content")
    block = "struct<type:string,text:string,thinking:string,name:string,input:map<string,string>,content:variant>"
    blocks = F.coalesce(
        F.try_variant_get(content, "$", f"array<{block}>"),
        F.from_json(
            F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.try_variant_get(content, "$", "string").alias("text")))), f"array<{block}>"
        )
    )
    b = j.select(
        "source_path", "line_no", F.coalesce("j.message.role", "j.type").alias("role"), F.col("j.timestamp").alias("ts"),
        F.posexplode(blocks).alias("block", "b")
    )
    kind = F.col("b.type")
    text = F.when(kind == "text", collapse(F.col("b.text"), TEXT)).when(kind == "thinking", collapse(F.col("b.thinking"), THINKING)).when(
        kind == "tool_result", collapse(_text(F.col("b.content")), RESULT)
    ).otherwise("")
    out = b.withColumn("kind", kind).withColumn("text", text).where(
        kind.isin("tool_use", "tool_result") | kind.isin("text", "thinking") & (F.col("text") != "")
    )
    inputs = F.transform_values(F.map_filter(F.col("b.input"), lambda k, v: v.isNotNull() & (v != "")), lambda k, v: collapse(v, INPUT))
    out = out.withColumn(
        "tool_name", F.when(kind == "tool_use", F.coalesce("b.name", F.lit("?")))
    ).withColumn("tool_inputs", F.when(kind == "tool_use", inputs))
    return _indexed(out).select("source_path", "idx", "role", "kind", "text", "tool_name", "tool_inputs", "ts", F.lit(True).alias("terminal"))


def rollout_turns(rows: DataFrame) -> DataFrame:
    """Turns of the rollout format: response items only, as event messages mirror them; developer messages are machinery."""
    j = rows.select("source_path", "line_no", F.lit(0).alias("block"), F.from_json("value", _ROLLOUT).alias("j")).where("j.type = 'response_item'")
    p, kind = F.col("j.payload"), F.col("j.payload.type")
    out = j.withColumn(
        "kind",
        F.when(kind == "message", "text").when(kind == "reasoning", "thinking").when(kind.isin("function_call", "custom_tool_call"), "tool_use").when(
            kind.isin("function_call_output", "custom_tool_call_output"), "tool_result"
        )
    )
    text = F.when(F.col("kind") == "text", collapse(_text(p["content"]), TEXT)).when(
        F.col("kind") == "thinking", collapse(_text(p["summary"]), THINKING)
    ).when(F.col("kind") == "tool_result", collapse(_text(p["output"]), RESULT)).otherwise("")
    out = out.withColumn("role", F.when(kind == "message", F.coalesce(p["role"], F.lit("assistant"))).otherwise("assistant")).withColumn("text", text)
    out = out.where("kind is not null and role <> 'developer'").where(F.col("kind").isin("tool_use", "tool_result") | (F.col("text") != ""))
    inputs = F.from_json(F.try_variant_get(p["arguments"], "$", "string"), "map<string,string>")
    out = out.withColumn("tool_name", F.when(F.col("kind") == "tool_use", F.coalesce(p["name"], F.lit("?")))).withColumn(
        "tool_inputs", F.when(F.col("kind") == "tool_use", F.transform_values(inputs, lambda k, v: collapse(v, INPUT)))
    )
    return _indexed(out).select(
        "source_path", "idx", "role", "kind", "text", "tool_name", "tool_inputs", F.col("j.timestamp").alias("ts"), F.lit(True).alias("terminal")
    )


def _step_inputs(args: Column) -> Column:
    """Non-empty arguments, and the first path among them as file_path too."""
    kept = F.transform_values(F.map_filter(args, lambda k, v: F.coalesce(v != "", F.lit(False))), lambda k, v: collapse(v, INPUT))
    path = F.coalesce(*[F.try_element_at(kept, F.lit(k)) for k in STEP_PATHS])
    return F.when(
        path.isNotNull() & ~F.map_contains_key(kept, F.lit("file_path")), F.map_concat(kept, F.create_map(F.lit("file_path"), path))
    ).otherwise(kept)


def step_turns(rows: DataFrame) -> DataFrame:
    """Turns of the step format: a step's thinking, content and tool calls share its number; steps in flight are not terminal.

    A step that is written again replaces the earlier line.
    """
    j = rows.select("source_path", "line_no", F.from_json("value", _STEP).alias("j")).where("j.step_index is not null")
    w = W.Window.partitionBy("source_path", "j.step_index").orderBy(F.desc("line_no"))
    j = j.withColumn("n", F.row_number().over(w)).where("n = 1")
    role = F.when(F.col("j.source").startswith("USER"), "user").otherwise("assistant")
    asked = F.trim(F.coalesce(F.nullif(F.regexp_extract("j.content", r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", 1), F.lit("")), F.col("j.content")))
    result = F.col("j.type").isin(*STEP_RESULTS)
    content = F.when(role == "user", asked).otherwise(F.trim(F.coalesce("j.content", F.lit(""))))
    none = F.lit(None).cast("map<string,string>")

    def part(kind: Column, text: Column, name: Column, inputs: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"), name.alias("tool_name"), inputs.alias("tool_inputs"))

    null = F.lit(None).cast("string")
    calls = F.transform(
        F.coalesce("j.tool_calls", F.from_json(F.lit("[]"), "array<struct<name:string,args:map<string,string>>>")),
        lambda c: part(F.lit("tool_use"), F.lit(""), F.coalesce(c["name"], F.lower(F.col("j.type"))), _step_inputs(c["args"]))
    )
    parts = F.concat(
        F.array(
            part(F.lit("thinking"), collapse(F.coalesce("j.thinking", F.lit("")), THINKING), null, none),
            part(F.when(result, "tool_result").otherwise("text"), collapse(content, TEXT), null, none)
        ),
        calls
    )
    out = j.select(
        "source_path", F.col("j.step_index").alias("idx"), role.alias("role"), F.col("j.created_at").alias("ts"),
        F.coalesce(F.col("j.status").isin(*TERMINAL), F.lit(False)).alias("terminal"), F.explode(parts).alias("p")
    )
    return out.where("p.kind = 'tool_use' or p.text <> ''").select(
        "source_path", "idx", "role", "p.kind", "p.text", "p.tool_name", "p.tool_inputs", "ts", "terminal"
    )


PARSERS = {"message": message_turns, "rollout": rollout_turns, "step": step_turns}


def parse_archive(spark: SparkSession, folder: str, formats: dict[str, str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Turns of an archive with folders YYYY-MM-DD-<tool>; ``formats`` names each tool's format (message unless named).

    Day and tool come from the path, so days outside [since, until) are dropped before their lines are parsed.
    """
    rows = lines(spark, folder)
    at = F.regexp_extract("source_path", r"/(\d{4}-\d{2}-\d{2})-([^/]+)/[^/]+$", 1)
    rows = rows.withColumn("day", at).withColumn(
        "tool", F.regexp_extract("source_path", r"/(\d{4}-\d{2}-\d{2})-([^/]+)/[^/]+$", 2)
    ).where("day <> ''")
    if since:
        rows = rows.where(F.col("day") >= since)
    if until:
        rows = rows.where(F.col("day") < until)
    out = None
    for name, parse in PARSERS.items():
        mine = [t for t, f in formats.items() if f == name]
        others = [t for t, f in formats.items() if f != name]
        part = rows.where(
            F.col("tool").isin(*mine) if name != "message" else ~F.col("tool").isin(*others) if others else F.lit(True)
        ) if mine or name == "message" else None
        if part is not None:
            turns = parse(part)
            out = turns if out is None else out.unionByName(turns)
    days = rows.select("source_path", "day", "tool").distinct()
    return out.join(days, "source_path")


def session_titles(turns: DataFrame, most: int = 80) -> DataFrame:
    """(source_path, title): the first line of the first thing a person said."""
    said = turns.where("role = 'user' and kind = 'text' and not text rlike '^<[a-z-]+>'")
    return said.groupBy("source_path").agg(F.min_by(F.substring(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))), 1, most), "idx").alias("title"))


def write_archive(turns: DataFrame, path: str) -> None:
    """Partitioned by day and tool, so that scans prune by both; a day that is written again is replaced."""
    turns.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "tool").parquet(path)


def prune_archive(spark: SparkSession, path: str, keep_from: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("day") >= keep_from)


def final_turns(turns: DataFrame, include_user: bool = True) -> DataFrame:
    """Turns that will not change any more, with or without what people said."""
    done = turns.where("terminal")
    return done if include_user else done.where("not (role = 'user' and kind = 'text')")


def archive_stats(archive: DataFrame) -> DataFrame:
    """(tool, sessions, turns, first_day, last_day) of an archive."""
    return archive.groupBy("tool").agg(
        F.countDistinct("source_path").alias("sessions"), F.count("*").alias("turns"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def tombstones(archive: DataFrame, live: DataFrame, known: DataFrame, at: str) -> DataFrame:
    """(source_path, deleted_at): archived sessions whose live file is gone, and those known before; a session that is back is not.

    live: (source_path); known: (source_path, deleted_at).
    """
    here = live.select("source_path").distinct()
    gone = archive.select("source_path").distinct().join(here, "source_path", "left_anti").join(
        known.select("source_path"), "source_path", "left_anti"
    )
    return known.select("source_path", "deleted_at").join(here, "source_path", "left_anti").unionByName(gone.withColumn("deleted_at", F.lit(at)))


def reconciled(archive: DataFrame, dead: DataFrame) -> DataFrame:
    """The archive without the sessions that have a tombstone."""
    return archive.join(dead.select("source_path"), "source_path", "left_anti")
