"""Requests to DataFrames: the nine query modes, filters, re-scoring and the router over one set of engine tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloft import views
from sparkloft.functions.text import WORD
from sparkloft.operators import graph, records, retrieval, scan
from sparkloft.plans import compilers
from sparkloft.storage import checkpointed

MODES = ("vector", "bm25", "hybrid", "graph", "multi", "compute", "scan", "absence", "timeline")


@dataclass(frozen=True)
class Request:
    query: str
    mode: str = "hybrid"
    top_k: int = 5
    similarity_threshold: float = 0.3
    alpha: float = 0.5
    source_types: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    file_paths: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)
    include_sensitive: bool = False
    time_decay: bool = False
    half_life_days: float = 90.0
    as_of: str | None = None
    rerank: bool = False
    entity_types: tuple[str, ...] = ()
    relationship_types: tuple[str, ...] = ()

    def __post_init__(self):
        if not 1 <= len(self.query) <= 1000 or self.mode not in MODES or not 1 <= self.top_k <= 50:
            raise ValueError("a query has 1 to 1000 characters, a known mode and asks for 1 to 50 results")
        if not 0 <= self.similarity_threshold <= 1 or not 0 <= self.alpha <= 1:
            raise ValueError("similarity_threshold and alpha lie in 0..1")
        if self.time_decay and not self.as_of:
            raise ValueError("time decay needs as_of")

    @property
    def filtered(self) -> bool:
        return bool(self.source_types or self.languages or self.file_paths or self.domains or self.metadata)

    def stage_one(self) -> int:
        """How many hits the first stage fetches: ten times for a rerank, five times under filters, 100 at most."""
        return max(self.top_k, min(100, self.top_k * 10) if self.rerank else 0, min(100, self.top_k * 5) if self.filtered else 0)


class Engine:
    """Engine tables in a folder, an embedder for query texts (str -> list of floats) and a scorer (str -> Column) for reranks.

    ``hidden``: source types that are switched off; no request sees them.
    """

    def __init__(
        self, spark: SparkSession, sf_dir: str, embed: Callable[[str], list[float]] | None = None, scorer: Callable[[str], Column] | None = None, hidden: tuple[str, ...] = ()
    ):
        self.spark, self.sf_dir, self.embed, self.scorer, self.hidden = spark, sf_dir, embed, scorer, hidden
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = views.view(self.spark, self.sf_dir, name)
        return self._tables[name]

    def _terms(self, query: str) -> list[str]:
        import re

        return re.findall(WORD.replace(r"\p{L}\p{N}_", r"\w"), query.lower())

    def _vector(self, r: Request, k: int) -> DataFrame:
        if self.embed is None:
            raise ValueError("this engine has no embedder")
        return retrieval.vector_search(self.table("vectors"), self.embed(r.query), k, r.similarity_threshold)

    def _bm25(self, r: Request, k: int) -> DataFrame:
        return views.keyword_index(self.spark, self.sf_dir).search(self._terms(r.query), k)

    def _scored(self, r: Request, scores: DataFrame) -> DataFrame:
        """Chunk columns for a short list of (chunk_id, score), then filters, decay, weights, rerank and the cut."""
        hits = self.table("chunks").join(F.broadcast(scores.select("chunk_id", "score")), "chunk_id")
        hits = hits.where(
            retrieval.request_filter(r.source_types, r.languages, r.file_paths, r.domains, r.metadata, r.include_sensitive, self.hidden)
        )
        if r.time_decay:
            hits = retrieval.time_decay(hits, r.as_of, r.half_life_days)
        if r.rerank and self.scorer is not None:
            return retrieval.rerank(hits, retrieval.guarded(self.scorer, r.query), r.top_k)
        return retrieval.top(hits, r.top_k)

    def _graph(self, r: Request, k: int) -> DataFrame:
        """(chunk_id, score) of the chunks behind the edges that the question's names match; an edge stands for the chunks it came from."""
        edges = self.table("edges").join(self.table("edge_sources"), "id", "left")
        hits = graph.graph_chunks(
            self.table("nodes"), edges, self.table("chunks"), r.query, k, r.include_sensitive, r.entity_types, r.relationship_types
        )
        return hits.select("chunk_id", "score")

    def execute(self, r: Request) -> DataFrame:
        """The result of a request in its own mode; lazy, but for the statistics that keyword scores need."""
        k = r.stage_one()
        if r.mode == "vector":
            return self._scored(r, self._vector(r, k))
        if r.mode == "bm25":
            return self._scored(r, self._bm25(r, k))
        if r.mode == "hybrid":
            return self._scored(r, retrieval.top(retrieval.hybrid(self._vector(r, k), self._bm25(r, k), r.alpha), k))
        if r.mode == "multi":
            lists = [self._bm25(r, k), self._graph(r, k)] + ([self._vector(r, k)] if self.embed else [])
            return self._scored(r, retrieval.top(retrieval.rrf(*lists), k))
        if r.mode == "graph":
            return self._scored(r, checkpointed(self._graph(r, k)))
        plan = self.plan(r)
        if plan is None:
            return self.spark.createDataFrame([], "label string, value double")
        if isinstance(plan, compilers.ComputePlan):
            return records.aggregate(
                self.table("records"), plan.metric, plan.op, plan.group_by, plan.order, plan.limit or r.top_k, since=plan.since, until=plan.until,
                include_sensitive=r.include_sensitive
            )
        if isinstance(plan, compilers.ScanPlan):
            return scan.scan(
                self.table("turns"), self._terms(plan.term), plan.group_by, plan.since, plan.until, plan.order, plan.limit or r.top_k,
                r.include_sensitive
            )
        if isinstance(plan, compilers.AbsencePlan):
            return records.absent(
                self.table("records"), plan.partition, plan.present_in, plan.absent_from, plan.key, plan.metric, r.top_k, since=plan.since,
                until=plan.until, include_sensitive=r.include_sensitive
            )
        nodes, edges = self.table("nodes"), self.table("edges")
        name = graph.timeline_entity(nodes, edges, plan.entity, r.include_sensitive)
        if name is None:
            return self.spark.createDataFrame(
                [], "subject string, predicate string, object string, valid_from string, valid_until string, valid boolean"
            )
        return graph.timeline(nodes, edges, name, r.include_sensitive)

    def plan(self, r: Request):
        """The plan of a set-level mode, or None if the question does not name one. The vocabulary is a few names."""
        if r.mode == "scan":
            return compilers.compile_scan(r.query, explicit=True)
        if r.mode == "timeline":
            return compilers.compile_timeline(r.query)
        names = self._vocabulary(r)
        if r.mode == "compute":
            return compilers.compile_compute(r.query, names["metric"])
        return compilers.compile_absence(r.query, names["metric"], names["source"], names["domain"])

    def _vocabulary(self, r: Request) -> dict[str, list[str]]:
        """Metric, source and domain names that can be in the question: those of which a word is in it.

        The rows are cut to such names before they come to the driver, so no limit is needed, however many names there are.
        """
        words = self.spark.createDataFrame([(w,) for w in dict.fromkeys(compilers.words_of(r.query))] or [("",)], "word string")
        kinds = records.vocabulary(self.table("records"), ("metric", "source", "domain"))
        asked = kinds.withColumn("word", F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
        asked = asked.withColumn("word", F.explode(F.array("word", F.regexp_replace("word", "s$", "")))).join(F.broadcast(words), "word", "left_semi")
        names: dict[str, list[str]] = {"metric": [], "source": [], "domain": []}
        for row in asked.select("kind", "name").distinct().orderBy("kind", "name").collect():
            names[row["kind"]].append(row["name"])
        return names

    def route(self, r: Request) -> tuple[str, DataFrame]:
        """A hybrid question goes to the first mode whose tells it holds and that has an answer; the mode that answered comes along."""
        if r.mode != "hybrid":
            return r.mode, self.execute(r)
        for mode in compilers.intents(r.query)[:-1]:
            out = self.execute(replace(r, mode=mode))
            if not out.isEmpty():  # graph finds nothing rather than falling back to vectors here
                return mode, out
        return ("hybrid", self.execute(r)) if self.embed else ("bm25", self.execute(replace(r, mode="bm25")))
