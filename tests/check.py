"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

``python tests/check.py [name ...]`` checks the named queries (prefixes do), or all of them.
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

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    """A comparable form of a value: exact, and different for whole numbers, decimals and floats."""
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value) if isinstance(value, (bool, int, decimal.Decimal)) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def compare(spark, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = contract.queries()[name](spark, sf_dir)
    left = rows(df.columns, df.collect())
    columns, data = oracle_rows(sf_dir, contract.oracle_sql()[name])
    right = rows(columns, data)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(set(df.columns) ^ set(columns))}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    if left != right:
        at = next(i for i in range(len(left)) if left[i] != right[i])
        pairs = [(c, a, b) for c, a, b in zip(sorted(df.columns), left[at], right[at]) if a != b]
        return f"{sum(a != b for a, b in zip(left, right))} of {len(left)} rows, first: {pairs[:6]}"
    return None if left else "no rows"


if __name__ == "__main__":
    from tests.conftest import make_session

    session = make_session()
    wanted = sys.argv[1:]
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    for query in contract.queries():
        if (wanted and not any(query.startswith(w) for w in wanted)) or query not in contract.oracle_sql():
            continue
        begin = time.time()
        try:
            difference = compare(session, query, folder)
        except Exception as error:  # report and go on with the next query
            difference = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if difference is None else 'FAIL'} {query} {time.time() - begin:.1f}s {difference or ''}", flush=True)
