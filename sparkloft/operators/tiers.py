"""Ingestion by tier, provenance checks, forgetting, and the extension points."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloft.operators.records import confidence, salience, with_buckets

TIERS = ("record", "reference", "document", "entity")
RESERVED = ("chunk_id", "source", "file_name", "chunk_index", "total_chunks", "source_type", "created_at", "sensitivity", "source_id", "domain")


class Registry:
    """User extensions as Column expressions or functions, run in the order of registration."""

    def __init__(self):
        self.domains: set[str] = {"code", "doc", "session", "git"}
        self.extractors: list[Callable[[DataFrame], DataFrame]] = []
        self.validators: list[Callable[[Column, Column, Column], Column]] = []
        self.scorers: list[Column] = []
        self.adapters: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.session_formats: dict[str, str] = {}

    def domain(self, name: str) -> None:
        if not name or name != name.strip().lower():
            raise ValueError(f"a domain is a lower-case name, not {name!r}")
        self.domains.add(name)

    def adapter(self, name: str, emit: Callable[[DataFrame], DataFrame], domain: str | None = None) -> None:
        """A source adapter: payloads (id, payload) to items (tier, domain, source_id, ...); its domain is registered with it."""
        if name in self.adapters:
            raise ValueError(f"there is an adapter {name!r} already")
        self.adapters[name] = emit
        if domain is not None:
            self.domain(domain)

    def session_tool(self, tool: str, form: str) -> None:
        """The transcript format of a tool, for sources.sessions.parse_archive."""
        self.session_formats[tool] = form

    def emit(self, name: str, payloads: DataFrame) -> dict[str, DataFrame]:
        """Items of an adapter, routed to their tiers."""
        return route(self.adapters[name](payloads), self)

    def extract(self, texts: DataFrame) -> DataFrame:
        """Union of what the extractors find."""
        return reduce(lambda a, b: a.unionByName(b), (f(texts) for f in self.extractors))

    def confidence(self, metric: Column, unit: Column, value: Column) -> Column:
        return confidence(metric, unit, value, *(v(metric, unit, value) for v in self.validators))

    def salience(self, ts: Column, as_of: str, half_life_days: float = 90.0) -> Column:
        """Best of the age decay and the registered scorers; a scorer that gives null has no say."""
        return salience(ts, as_of, half_life_days, *(F.coalesce(s, F.lit(0.0)) for s in self.scorers))


def check(items: DataFrame, registry: Registry) -> DataFrame:
    """Adds problem: why an item (tier, domain, source_id, ...) cannot be ingested, null if it can."""
    problem = F.when(~F.col("tier").isin(*TIERS), "unknown tier").when(F.coalesce("source_id", F.lit("")) == "", "no provenance").when(
        ~F.col("domain").isin(*sorted(registry.domains)), "unknown domain"
    )
    return items.withColumn("problem", problem)


def route(items: DataFrame, registry: Registry) -> dict[str, DataFrame]:
    """Items by tier, and the rejected ones; records get their time buckets."""
    checked = check(items, registry)
    good = checked.where("problem is null").drop("problem")
    out = {t: good.where(F.col("tier") == t) for t in TIERS}
    out["record"] = with_buckets(out["record"])
    return out | {"rejected": checked.where("problem is not null")}


def forget(tables: dict[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """Every tier without a source."""
    return {name: t.where(~F.col("source_id").eqNullSafe(F.lit(source_id))) for name, t in tables.items()}


def inject(chunks: DataFrame, constants: dict[str, str]) -> DataFrame:
    """Constants into the extra map of chunks; core keys are protected, a chunk's own values win."""
    if bad := [k for k in constants if k in RESERVED]:
        raise ValueError(f"reserved keys {bad}")
    extra = F.create_map(*[F.lit(x) for kv in constants.items() for x in kv]) if constants else F.create_map().cast("map<string,string>")
    mine = F.coalesce("extra", F.create_map().cast("map<string,string>"))
    return chunks.withColumn("extra", F.map_concat(F.map_filter(extra, lambda k, v: ~F.map_contains_key(mine, k)), mine))


def inject_by(chunks: DataFrame, process: Callable[[dict], dict], constants: dict[str, str] | None = None) -> DataFrame:
    """Constants, then a user's function of a chunk's extra map and core columns, into the extra map.

    ``process`` gets a dict of the chunk and returns one; of what it returns, new scalar values under other keys than the core ones are
    kept as text. A chunk for which it fails keeps what it had. Runs in Arrow batches.
    """
    rows = inject(chunks, constants or {})
    core = [c for c in rows.columns if c != "extra"]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                mine = dict(row.pop("extra") or {})
                try:
                    got = process({**row, **mine}) or {}
                except Exception:  # one bad chunk does not stop the rest
                    got = {}
                new = {k: str(v) for k, v in got.items() if k not in row and k not in RESERVED and isinstance(v, (str, int, float, bool))}
                out.append({**mine, **new})
            pdf["extra"] = out
            yield pdf

    return rows.select(*core, "extra").mapInPandas(run, rows.select(*core, "extra").schema)


def reserved_keys(documents: DataFrame) -> DataFrame:
    """Documents whose own metadata (a map) uses a reserved key, with those keys: they are refused."""
    bad = F.filter(F.map_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda k: k.isin(*RESERVED))
    return documents.withColumn("reserved", bad).where(F.size("reserved") > 0)
