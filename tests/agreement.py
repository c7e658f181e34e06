"""Run registered queries in Spark and their SQL in DuckDB and compare rows: `python tests/agreement.py [sf] [prefix ...]`."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("dec", str(value))
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return (type(value).__name__, value)
    if isinstance(value, float):
        return ("float", repr(value + 0.0))
    if isinstance(value, datetime.datetime):
        return ("ts", value.replace(tzinfo=None).isoformat())
    if isinstance(value, datetime.date):
        return ("date", value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, build, sql):
    start = time.time()
    df = build(spark, sf_dir)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(got)} rows", took, len(got) > 0
    cur = con.execute(sql)
    want_columns, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if columns != want_columns:
        return f"COLUMNS {columns} != {want_columns}", took, False
    if got != want:
        extra, missing = sorted(set(got) - set(want), key=repr), sorted(set(want) - set(got), key=repr)
        return f"ROWS {len(got)} != {len(want)}; only spark {extra[:2]}; only sql {missing[:2]}", took, False
    return f"ok {len(got)} rows", took, len(got) > 0


def main():
    from vouchline.plans import catalog
    from vouchline.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), []
    for name, build in catalog.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            note, took, good = compare(spark, con, sf_dir, name, build, catalog.SQL.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            note, took, good = f"ERROR {type(error).__name__} {str(error)[:600]}", 0.0, False
        print(f"{'  ' if good else '!!'} {name:28s} {took:6.2f}s {note}", flush=True)
        if not good:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
