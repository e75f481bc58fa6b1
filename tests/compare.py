"""Run registered queries beside their SQL and compare rows, order aside."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        v = round(v, 6)
        return 0.0 if v == 0 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, sf_dir, name, query, sql):
    """None when equal, else a short account of the difference; also seconds and row count."""
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return None, spent, len(got)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", spent, len(got)
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        only = [r for r in a if r not in set(b)][:1] if len(a) < 20000 else ""
        return f"{len(a)} rows != {len(b)}; e.g. {str(only)[:300]}", spent, len(got)
    for x, y in zip(a, b):
        if x != y:
            for n, p, q in zip(sorted(names), x, y):
                if p != q:
                    return f"column {n}: {str(p)[:300]!r} != {str(q)[:300]!r} in {str(x)[:150]}", spent, len(got)
    return None, spent, len(got)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    from recordloom.session import configure
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = configure(SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
                      .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            diff, spent, n = check(spark, con, sf, name, query, sqls.get(name))
        except Exception as e:  # report and go on
            diff, spent, n = f"{type(e).__name__}: {str(e)[:1500]}", 0.0, 0
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name:28s} {n:8d} rows {spent:6.2f}s {diff or ''}", flush=True)
    print("failures:", bad)
