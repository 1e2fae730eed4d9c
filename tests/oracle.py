"""Run registered queries on Spark and their SQL twins on DuckDB, and compare.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import signal
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ROOT = Path("/root/testdata")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        value = value.replace(tzinfo=None)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


def compare(build, sql, spark, con, sf_dir):
    """(ok, message) for one query."""
    begin = time.time()
    df = build(spark, sf_dir)
    got = df.collect()
    spent = time.time() - begin
    if sql is None:
        return None, f"{len(got)} rows, spark {spent:.2f}s, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = rows(df.columns, got), rows(names, want)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sql_types = dict(zip(names, types))
    same = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = [f"{n}:{spark_types[n]}/{sql_types[n]}" for n in names if same.get(spark_types[n]) != sql_types[n]]
    note = f"{len(left)} rows, spark {spent:.2f}s" + (f" TYPES {odd}" if odd else "")
    if left != right:
        in_left, in_right = set(left), set(right)
        only_l = [x for x in left if x not in in_right][:2]
        only_r = [x for x in right if x not in in_left][:2]
        return False, f"{len(left)} vs {len(right)}; spark {str(only_l)[:600]}; sql {str(only_r)[:600]}"
    return (not odd), note


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--limit", type=int, default=60, help="seconds a query may take")
    args = parser.parse_args()
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from anamnesis.session import local_session

    spark = local_session()
    sf_dir = str(ROOT / f"sf{args.sf}")
    con = connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    failed = []
    def overdue(*_):
        con.interrupt()
        spark.sparkContext.cancelAllJobs()
        raise TimeoutError(f"longer than {args.limit}s")

    signal.signal(signal.SIGALRM, overdue)
    for name in names:
        begin = time.time()
        signal.alarm(args.limit)
        try:
            ok, message = compare(queries[name], oracles.get(name), spark, con, sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:900]}"
        if ok is False:
            failed.append(name)
        signal.alarm(0)
        print(f"{'FAIL' if ok is False else 'ok  '} {name:28s} {time.time() - begin:6.2f}s {message}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
