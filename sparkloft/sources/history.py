"""Commit logs as DataFrames: an exported log text, or a local repository read by a Python data source."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

COMMIT, END = "\x1e", "\x1f"
FORMAT = f"--pretty=format:{COMMIT}%H%n%an%n%ae%n%cI%n%s%n%b{END}"
SCHEMA = "sha string, author string, email string, committed_at string, subject string, body string, files_changed array<string>, lines_added long, lines_deleted long"


def parse_log(logs: DataFrame) -> DataFrame:
    """Commits of log texts (value) written with FORMAT and --numstat; binary files count no lines."""
    chunk = F.explode(F.filter(F.split("value", COMMIT), lambda x: F.trim(x) != "")).alias("c")
    parts = F.split("c", END)
    rows = logs.select(chunk).select(F.split(parts[0], "\n").alias("h"), F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\n").alias("t"))
    stat = F.filter(F.transform("t", lambda x: F.split(F.trim(x), "\t")), lambda p: (F.size(p) == 3) & (p[2] != ""))
    rows = rows.where(F.size("h") >= 5).withColumn("stat", stat)
    count = lambda i: F.aggregate(
        "stat", F.lit(0).cast("long"),
        lambda s, p: s + F.coalesce(F.try_cast(p[i], "long") if hasattr(F, "try_cast") else p[i].try_cast("long"), F.lit(0))
    )
    h = F.col("h")
    return rows.select(
        F.trim(h[0]).alias("sha"), F.trim(h[1]).alias("author"), F.trim(h[2]).alias("email"), F.trim(h[3]).alias("committed_at"),
        F.trim(h[4]).alias("subject"), F.btrim(F.array_join(F.slice("h", 6, 1 << 20), "\n"), F.lit(" \r\n\t")).alias("body"),
        F.transform("stat", lambda p: p[2]).alias("files_changed"), count(0).alias("lines_added"), count(1).alias("lines_deleted")
    )


class LogSource(DataSource):
    """spark.read.format("commit_log").option("repository", path).load(): one row a commit, its record of the log.

    Options: ``since`` (a known commit; only later ones), ``depth`` (at most so many), ``paths`` (one a line; commits that touch
    them), ``revision`` (HEAD), and ``names`` ("true": bare ids instead of records).
    """

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    """Reads the log from a pipe, so that no task holds more than one commit."""

    def __init__(self, options):
        self.names = options.get("names", "") == "true"
        detail = [f"--pretty=format:{COMMIT}%H"] if self.names else ["--numstat", FORMAT]
        self.args = ["git", "-C", options["repository"], "log", "--no-color", *detail]
        if options.get("depth", "0") != "0":
            self.args.append(f"--max-count={options['depth']}")
        revision = options.get("revision", "HEAD")
        self.args.append(f"{options['since']}..{revision}" if options.get("since") else revision)
        if paths := [p for p in options.get("paths", "").split("\n") if p]:
            self.args += ["--", *paths]

    def read(self, partition):
        with tempfile.TemporaryFile() as said, subprocess.Popen(
            self.args, stdout=subprocess.PIPE, stderr=said, encoding="utf-8", errors="replace"
        ) as git:
            record: list[str] = []
            for line in git.stdout:
                if line.startswith(COMMIT) and record:
                    yield ("".join(record),)
                    record = []
                record.append(line)
            if record:
                yield ("".join(record),)
            if git.wait():
                said.seek(0)
                raise RuntimeError(f"git log of {self.args[2]}: {said.read().decode(errors='replace').strip()}")


def _log(spark: SparkSession, repository: str, since: str | None, depth: int, paths: Iterable[str], **more: str) -> DataFrame:
    spark.dataSource.register(LogSource)
    reader = spark.read.format("commit_log").option("repository", repository).option("depth", depth).option("paths", "\n".join(paths)).options(**more)
    return (reader.option("since", since) if since else reader).load()


def commits(spark: SparkSession, repository: str, since: str | None = None, depth: int = 0, paths: Iterable[str] = ()) -> DataFrame:
    """Commits of a repository that every executor can reach: new ones since a known one, those that touch some paths."""
    return parse_log(_log(spark, repository, since, depth, paths))


def reachable(spark: SparkSession, repository: str, depth: int = 0, paths: Iterable[str] = (), revision: str = "HEAD") -> DataFrame:
    """(sha): the commits that a revision reaches; indexed commits beyond them were rewritten away."""
    rows = _log(spark, repository, None, depth, paths, names="true", revision=revision)
    return rows.select(F.btrim("value", F.lit(COMMIT + " \r\n")).alias("sha")).where("sha <> ''").distinct()


def advance(state: DataFrame, new: DataFrame, repository: str, head: str) -> DataFrame:
    """State (repository, sha, indexed) after an incremental run: the last commit, and how many commits were indexed in all."""
    n = new.agg(F.count("*").alias("n"))
    mine = state.where(F.col("repository") == repository).agg(F.coalesce(F.sum("indexed"), F.lit(0)).alias("before"))
    row = mine.crossJoin(n).select(
        F.lit(repository).alias("repository"), F.lit(head).alias("sha"), (F.col("before") + F.col("n")).alias("indexed")
    )  # one row each
    return state.where(~F.col("repository").eqNullSafe(repository)).select("repository", "sha", "indexed").unionByName(row)


def commit_chunks(rows: DataFrame, most_files: int = 50) -> DataFrame:
    """(sha, text): message and the first files of each commit."""
    files = F.array_join(F.slice("files_changed", 1, most_files), "\n")
    return rows.select(
        "sha",
        F.concat_ws(
            "\n\n", F.nullif("subject", F.lit("")), F.nullif("body", F.lit("")), F.nullif(F.concat(F.lit("Files:\n"), files), F.lit("Files:\n"))
        ).alias("text")
    )
