"""compute, absence and scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloft.functions.text import tokens
from sparkloft.operators import records, scan
from sparkloft.plans.catalog import query, rounded
from sparkloft.plans.compilers import compile_absence, compile_compute, compile_scan

METRICS = ["signup", "error", "click", "view", "purchase"]
AS_OF = "2024-02-01 00:00:00"
_OK = "confidence >= 0.7 AND sensitivity = 'normal'"


def _grouped(label: str, metric: str, op: str, order: str = "DESC", limit: str = "", extra: str = "") -> str:
    return f"""
    , g AS (SELECT {label} AS label, {op} AS value FROM records WHERE metric = '{metric}' AND {_OK} AND {label} IS NOT NULL {extra} GROUP BY 1 ORDER BY 2 {order}, 1 {limit})
    SELECT label, round(value, 6) AS value, round(abs(value) / (SELECT max(abs(value)) FROM g), 6) AS score FROM g"""


def _total(op: str, metric: str) -> str:
    return f"SELECT CAST(NULL AS STRING) AS label, round(v, 6) AS value, CAST(CASE WHEN v <> 0 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM (SELECT coalesce({op}, 0.0) AS v FROM records WHERE metric = '{metric}' AND {_OK}) AS x"


def _ask(t, question: str):
    p = compile_compute(question, METRICS)
    return rounded(records.aggregate(t("records"), p.metric, p.op, p.group_by, p.order, p.limit, since=p.since, until=p.until), "value", "score")


QUESTIONS = {
    "compute_top_week": ("which week had the highest purchase", _grouped("iso_week", "purchase", "sum(value)", limit="LIMIT 1")),
    "compute_total_sum": ("total purchase", _total("sum(value)", "purchase")),
    "compute_count": ("how many clicks", _total("CAST(count(*) AS DOUBLE)", "click")),
    "compute_avg": ("average view", _total("avg(value)", "view")),
    "compute_max": ("highest signup", _total("max(value)", "signup")),
    "compute_min": ("lowest signup", _total("min(value)", "signup")),
    "compute_by_week": ("total view per week", _grouped("iso_week", "view", "sum(value)")),
    "compute_by_month": (
        "average click per month in january 2024",
        _grouped("ym", "click", "avg(value)", extra="AND ts >= '2024-01-01T00:00:00' AND ts <= '2024-02-01T00:00:00'")
    ),
    "compute_by_source": ("total purchase by source", _grouped("source", "purchase", "sum(value)")),
    "compute_by_subject": ("how many purchases per subject", _grouped("subject", "purchase", "CAST(count(*) AS DOUBLE)")),
    "compute_by_unit": ("sum of purchase by unit", _grouped("unit", "purchase", "sum(value)")),
}
for _name, (_question, _sql) in QUESTIONS.items():
    query(_name, _sql, "records")(lambda t, spark, sf, q=_question: _ask(t, q))


@query(
    "compute_exclude_source",
    _grouped("iso_week", "purchase", "sum(value)", "ASC", extra="AND (source IS NULL OR source NOT IN ('src1')) AND domain = 'd2'"), "records"
)
def _exclude(t, spark, sf):
    return rounded(records.aggregate(t("records"), "purchase", "sum", "week", "asc", exclude_sources=("src1",), domain="d2"), "value", "score")


@query(
    "records_vocab",
    "SELECT DISTINCT kind, name FROM (SELECT 'metric' AS kind, metric AS name FROM records UNION ALL SELECT 'source', source FROM records UNION ALL SELECT 'domain', domain FROM records UNION ALL SELECT 'subject', subject FROM records) AS x WHERE name IS NOT NULL",
    "records"
)
def _vocab(t, spark, sf):
    return records.vocabulary(t("records"))


@query("records_stats", "SELECT count(*) AS records, count(*) FILTER (WHERE confidence < 0.7) AS unverified FROM records", "records")
def _stats(t, spark, sf):
    return records.stats(t("records"))


@query(
    "records_confidence",
    "SELECT id, CAST(CASE WHEN metric IN ('files_touched', 'tools_used', 'decisions', 'open_threads') AND unit = 'count' THEN 1.0 WHEN metric = 'amount' AND (unit IS NULL OR unit = 'USD') THEN 1.0 WHEN isfinite(value) THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence FROM (SELECT id, value, unit, CASE metric WHEN 'purchase' THEN 'amount' WHEN 'click' THEN 'decisions' ELSE metric END AS metric FROM records) AS r",
    "records"
)
def _confidence(t, spark, sf):
    r = t("records").withColumn(
        "metric", F.when(F.col("metric") == "purchase", "amount").when(F.col("metric") == "click", "decisions").otherwise(F.col("metric"))
    )
    return r.select("id", records.confidence(F.col("metric"), F.col("unit"), F.col("value")).alias("confidence"))


@query(
    "records_salience",
    f"SELECT id, round(power(0.5, greatest(0.0, (epoch(TIMESTAMP '{AS_OF}') - epoch(CAST(ts AS TIMESTAMP))) / 86400.0) / 90.0), 6) AS salience FROM records",
    "records"
)
def _salience(t, spark, sf):
    return t("records").select("id", F.round(records.salience(F.col("ts"), AS_OF), 6).alias("salience"))


RULES = [
    ("purchase", "USD", 100.0, None, 1.0), ("purchase", None, None, 20.0, 0.6), ("error", None, 50.0, 60.0, 0.6), ("click", "USD", None, None, 1.0)
]


@query(
    "records_taught_rules",
    ", rules(metric, unit, lo, hi, tier) AS (VALUES ('purchase', 'USD', 100.0, NULL, 1.0), ('purchase', NULL, NULL, 20.0, 0.6), ('error', NULL, 50.0, 60.0, 0.6), ('click', 'USD', NULL, NULL, 1.0)) SELECT r.id, CAST(max(u.tier) AS DOUBLE) AS rule_tier FROM records r LEFT JOIN rules u ON u.metric = r.metric AND (u.unit IS NULL OR u.unit = r.unit) AND (u.lo IS NULL OR r.value >= u.lo) AND (u.hi IS NULL OR r.value <= u.hi) GROUP BY r.id",
    "records"
)
def _taught(t, spark, sf):
    rules = spark.createDataFrame(RULES, "metric string, unit string, value_min double, value_max double, tier double")
    return records.taught(t("records"), rules).select("id", "rule_tier")


@query("records_currency", r"""
    WITH d AS (SELECT event_id AS doc_id, concat('paid $', CAST(event_id AS STRING), ',', lpad(CAST(event_id % 1000 AS STRING), 3, '0'), '.50 and $ 7 of ', event_type) AS text FROM events),
    m AS (SELECT doc_id, regexp_extract_all(text, '\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)', 1) AS a FROM d)
    SELECT doc_id, CAST(unnest(generate_series(0, len(a) - 1)) AS INT) AS pos, 'amount' AS metric, 'USD' AS unit, CAST(replace(unnest(a), ',', '') AS DOUBLE) AS value FROM m""")
def _currency(t, spark, sf):
    e = t("events").select(
        F.col("event_id").alias("doc_id"),
        F.concat(
            F.lit("paid $"), F.col("event_id").cast("string"), F.lit(","), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"),
            F.lit(".50 and $ 7 of "), "event_type"
        ).alias("text")
    )
    return records.currency(e)


_SIDE = "SELECT {k} FROM records WHERE {p} = '{v}' AND confidence >= {c} AND sensitivity = 'normal'".format


@query(
    "absence_metric",
    f"SELECT DISTINCT subject AS label FROM records WHERE metric = 'purchase' AND {_OK} AND subject NOT IN ({
        _SIDE(k='subject', p='metric', v='signup', c=0.7)
    })",
    "records"
)
def _absence_metric(t, spark, sf):
    p = compile_absence("who has purchase but not signup", METRICS, [], [])
    return records.absent(t("records"), p.partition, p.present_in, p.absent_from, p.key)


@query(
    "absence_source",
    f"SELECT DISTINCT source_id AS label FROM records WHERE source = 'src0' AND {_OK} AND metric = 'purchase' AND source_id NOT IN ({
        _SIDE(k='source_id', p='source', v='src1', c=0.7)
    } AND metric = 'purchase' AND source_id IS NOT NULL)",
    "records"
)
def _absence_source(t, spark, sf):
    return records.absent(t("records"), "source", "src0", "src1", "source_id", metric="purchase")


@query(
    "absence_month",
    f"SELECT DISTINCT subject AS label FROM records WHERE domain = 'd1' AND {_OK} AND ts >= '2024-01-01T00:00:00' AND ts < '2024-02-01T00:00:00' AND subject NOT IN ({
        _SIDE(k='subject', p='domain', v='d3', c=0.7)
    } AND ts >= '2024-01-01T00:00:00' AND ts < '2024-02-01T00:00:00')",
    "records"
)
def _absence_month(t, spark, sf):
    p = compile_absence("in d1 without d3 in january 2024", METRICS, [], ["d1", "d3"])
    return records.absent(t("records"), p.partition, p.present_in, p.absent_from, p.key, since=p.since, until=p.until)


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _scan_sql(label: str, order: str = "", where: str = "") -> str:
    return f"SELECT label, CAST(sum(n) AS BIGINT) AS value FROM (SELECT {label} AS label, len(list_filter({_WORDS}, lambda x: x = 'the')) AS n FROM turns WHERE sensitivity = 'normal' {where}) AS s WHERE n > 0 GROUP BY 1 {order}"


def _scan(t, question: str):
    p = compile_scan(question)
    return scan.scan(t("turns"), [p.term], p.group_by, p.since, p.until, p.order, p.limit)


for _name, _question, _sql in (
    ("scan_total", "how often did I say 'the'", _scan_sql("'total'")),
    ("scan_by_week", "did I mention 'the' per week", _scan_sql("iso_week")),
    ("scan_by_day", "did I mention 'the' each day in january 2024", _scan_sql("day", where="AND day >= '2024-01-01' AND day < '2024-02-01'")),
    ("scan_by_source", "did I mention 'the' per source", _scan_sql("tool")),
    ("scan_top_week", "which week did I mention 'the' least", _scan_sql("iso_week", "ORDER BY 2, 1 LIMIT 1")),
):
    query(_name, _sql, "turns")(lambda t, spark, sf, q=_question: _scan(t, q))


@query(
    "scan_phrase",
    rf"SELECT label, CAST(sum(n) AS BIGINT) AS value FROM (SELECT tool AS label, (len(s) - len(replace(s, '|of||the|', ''))) // 9 AS n FROM (SELECT tool, concat('|', array_to_string({_WORDS}, '||'), '|') AS s FROM turns WHERE sensitivity = 'normal') AS w) AS x WHERE n > 0 GROUP BY 1",
    "turns"
)
def _phrase(t, spark, sf):
    return scan.scan(t("turns"), ["of", "the"], "source")
