"""Run catalogue queries on Spark and their SQL on DuckDB and compare the two tables."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


TIMES: dict = {}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    started = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = table(names, cursor.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}", 0
    middle = time.time()
    got = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    TIMES.update(duck=middle - started, spark=time.time() - middle)
    if got == expected:
        return "", sum(got.values())
    lost, extra = list((expected - got).items()), list((got - expected).items())
    return f"rows {sum(got.values())} vs {sum(expected.values())}; missing {lost[:3]}; extra {extra[:3]}", 0


def main(names, folder):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from siftweb.session import build_session

    spark = build_session("compare", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con, queries, oracle = connect(folder), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        started = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in oracle:
                problem, n = compare(frame, con, oracle[name])
            else:
                problem, n = "", len(frame.collect())
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, n = f"{type(exc).__name__}: {str(exc)[:900]}", 0
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - started:.1f}s "
              f"{' '.join(f'{k}={v:.1f}' for k, v in TIMES.items())} "
              f"{'' if name in oracle else '[rows only]'} {problem[:1500]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    main(args, folder)
