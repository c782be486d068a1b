"""Runs queries beside their SQL and compares rows: python tests/compare.py FOLDER [NAME...]."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        path = os.path.join(folder, f)
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def differences(df, con, sql: str) -> tuple[int, int, list, list]:
    """Rows of both sides, and up to five that only one has."""
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != names:
        raise AssertionError(f"columns {names} and {sorted(columns)}")
    order = [columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    return sum(got.values()), sum(want.values()), list((got - want).elements())[:5], list((want - got).elements())[:5]


def main(folder: str, only: list[str]) -> int:
    import __spark_entry__ as e
    from longreach.runtime import session

    spark, con, bad = session(), connect(folder), 0
    sql = e.oracle_sql()
    for name, run in e.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            if name in sql:
                n, m, extra, missing = differences(run(spark, folder), con, sql[name])
                ok = not extra and not missing
                print(f"{'ok ' if ok else 'BAD'} {name}: {n} rows, {m} wanted, {time.time() - began:.1f} s", *([f"\n    extra {extra}\n    missing {missing}"] if not ok else []), flush=True)
            else:
                n = run(spark, folder).count()
                ok = True
                print(f"--  {name}: {n} rows, no SQL, {time.time() - began:.1f} s", flush=True)
        except Exception as error:  # noqa: BLE001
            ok = False
            print(f"BAD {name}: {str(error)[:1500]}", flush=True)
        bad += not ok
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
