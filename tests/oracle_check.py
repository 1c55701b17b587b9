"""Run registered queries and their SQL twins side by side: ``python tests/oracle_check.py [names…]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "hour") else value.isoformat()
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, name, query, sql, folder):
    """None when equal, else a message."""
    frame = query(spark, folder)
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want_columns, want = rows_of(names, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got == want:
        return None if got else "EMPTY"
    left, right = set(map(repr, got)), set(map(repr, want))
    return (f"rows {len(got)} vs {len(want)}; only ours {sorted(left - right)[:3]}; "
            f"only sql {sorted(right - left)[:3]}")


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from shelfmark.session import local_session

    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    known, sqls = queries(), oracle_sql()
    wanted = sys.argv[1:]
    chosen = [n for n in known if not wanted or any(n.startswith(w) for w in wanted)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            message = compare(spark, con, name, known[name], sqls.get(name), folder)
        except Exception as error:  # report and go on with the next query
            message = f"{type(error).__name__}: {str(error)[:700]}"
        bad += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {time.time() - start:6.2f}s "
              f"{'' if name in sqls else '[rows] '}{name} {message or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
