"""Run registered queries against their reference SQL and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, float) and (math.isnan(value) or value == 0):
        return None if math.isnan(value) else 0.0
    if isinstance(value, dt.datetime):
        return value.date()
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(shaped, key=repr)


def differences(name, spark, folder, con, queries, oracles) -> list[str]:
    """What differs between a query and its SQL; empty when they agree."""
    frame = queries[name](spark, folder)
    found = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in oracles:
        return [] if found[1] else ["no rows"]
    cursor = con.execute(oracles[name])
    columns = [d[0] for d in cursor.description]
    wanted = sorted_rows(columns, cursor.fetchall())
    if found[0] != wanted[0]:
        return [f"columns {found[0]} and {wanted[0]}"]
    if len(found[1]) != len(wanted[1]):
        ours, theirs = set(found[1]), set(wanted[1])
        extra = [f"only here {r}" for r in list(ours - theirs)[:3]]
        extra += [f"only there {r}" for r in list(theirs - ours)[:3]]
        return [f"{len(found[1])} and {len(wanted[1])} rows", *extra]
    pairs = [(a, b) for a, b in zip(found[1], wanted[1], strict=True) if a != b]
    return [f"{a}\n   {b}" for a, b in pairs[:3]] + (
        [f"{len(pairs)} rows differ"] if pairs else []
    )


def main(folder: str, names: list[str]) -> int:
    from checks.queries import QUERIES, SQL
    from spanwise.session import local_session

    spark, con = local_session(8, folder=tempfile.mkdtemp(prefix="spanwise-")), connect(folder)
    failed = 0
    for name in names or QUERIES:
        begun = time.time()
        try:
            wrong = differences(name, spark, folder, con, QUERIES, SQL)
        except Exception as error:  # noqa: BLE001
            wrong = [f"{type(error).__name__}: {str(error)[:900]}"]
        failed += bool(wrong)
        print(f"{'FAIL' if wrong else 'ok':5}{time.time() - begun:6.1f}s {name}", flush=True)
        for line in wrong:
            print("   ", line, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
