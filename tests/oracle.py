"""Runs registered queries beside their DuckDB SQL and compares rows; also usable from the command line."""

from __future__ import annotations

import math
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def compare(spark, connection, f, sql: str, sf_dir: str) -> str | None:
    """None if they agree, else what differs."""
    df = f(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connection.execute(sql)
    b = rows([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; {a[1][:2]} and {b[1][:2]}"
    for x, y in zip(a[1], b[1], strict=True):
        if x != y and not all(
            p == q or isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) < 2e-5 for p, q in zip(x, y, strict=True)
        ):
            return f"{x} and {y}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession

    from sparkloft.plans import catalog

    spark = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false"
    ).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf = sys.argv[1]
    c = connect(sf)
    queries, sql = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        try:
            said = compare(spark, c, queries[name], sql[name], sf)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
            c = connect(sf)
        if said:
            bad += 1
            print(name, said[:600], flush=True)
    print(len(queries), "queries,", bad, "differ")
