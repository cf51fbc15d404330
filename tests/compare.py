"""Run registered queries against DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from concurrent.futures import ThreadPoolExecutor

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(spark, con, folder, name, fn, sql):
    """None when equal, else a short description of the difference."""
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; e.g. {[r for r in got if r not in want][:2]} / {[r for r in want if r not in got][:2]}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ in {sorted(columns)}: {wrong[:2]} (duckdb types {types}; spark {df.dtypes})"
    if not got:
        return "no rows on either side"
    return None


def compare_all(spark, folder, queries, oracles, workers=6):
    """(name, problem, seconds) of all queries, several at a time."""
    con = duck(folder)

    def one(name):
        start = time.time()
        try:
            problem = compare(spark, con.cursor(), folder, name, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        return name, problem, time.time() - start

    with ThreadPoolExecutor(workers) as pool:
        yield from pool.map(one, queries)


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from chalkline.session import local_session

    folder, only = argv[0], argv[1:]
    spark = local_session(cores="8")

    def wanted(name):
        return not only or any(
            name == o or name.startswith(o + "_") or (o.endswith("*") and name.startswith(o[:-1])) for o in only
        )

    queries = {n: f for n, f in entry.queries().items() if wanted(n)}
    oracles = entry.oracle_sql()
    bad = 0
    for name, problem, took in compare_all(spark, folder, queries, oracles):
        bad += bool(problem)
        checked = "" if name in oracles else "(rows only)"
        print(f"{'BAD ' if problem else 'ok  '} {name} {took:.2f}s {checked} {problem or ''}", flush=True)
    print(f"{bad} bad of {len(queries)}")


if __name__ == "__main__":
    main(sys.argv[1:])
