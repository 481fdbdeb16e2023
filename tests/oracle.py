"""Compare registered queries with their SQL: same columns, same rows in any order.

Run as a script: `python tests/oracle.py [folder] [name ...]`.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def mismatch(spark_df, con, sql) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    want = rows_of(names, result.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}; {diff(got, want)}"
    return None if want == got else diff(got, want)


def diff(got, want) -> str:
    extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"{len(extra)} rows differ; spark {str(extra[:2])[:900]} sql {str(missing[:2])[:900]}"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from faturalens.plans.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls, bad = oracle_sql(), 0
    for name, build in queries().items():
        if argv[1:] and not any(part in name for part in argv[1:]):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in sqls:
                problem = mismatch(df, con, sqls[name])
                size = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0]
            else:
                problem, size = None, df.count()
        except Exception as error:
            problem, size = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={size} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main(sys.argv[1:])
