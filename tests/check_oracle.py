"""Compare every registered query with its SQL: ``python tests/check_oracle.py [folder] [name ...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from quire.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return db


def compare(spark, db, folder, name, query, sql):
    """None when columns and rows agree, else what differs."""
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if sql is None:
        return None if got else "no rows"
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    if got == want:
        return None
    only_got = [r for r in got if r not in set(want)][:3] if len(got) < 200000 else got[:2]
    only_want = [r for r in want if r not in set(got)][:3] if len(want) < 200000 else want[:2]
    return f"{len(got)} rows against {len(want)}; only here {only_got}; only there {only_want}"


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, db = local_session(cores="8"), database(folder)
    sqls, bad = contract.oracle_sql(), 0
    for name, query in contract.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problem = compare(spark, db, folder, name, query, sqls.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}"[:1500], flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
