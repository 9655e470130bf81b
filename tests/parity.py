"""Run queries in Spark and their SQL in DuckDB, and compare all rows."""

import math
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows),
        key=lambda row: [(x is None, str(type(x)), x if x is not None else 0) for x in row],
    )


def compare(spark, db, sf_dir, query, sql):
    """None if equal, else what differs; and the seconds of both engines."""
    start = time.time()
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    middle = time.time()
    result = db.execute(sql)
    theirs = result.fetchall()
    times = (round(middle - start, 2), round(time.time() - middle, 2))
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", times
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", times
    if not a:
        return "no rows", times
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        return f"{len(different)} of {len(a)} rows differ, such as {different[:2]}", times
    return None, times


if __name__ == "__main__":
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    only = sys.argv[2:]
    spark, db = session(), connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        try:
            if name in sqls:
                verdict, times = compare(spark, db, sf_dir, query, sqls[name])
            else:
                start = time.time()
                rows = query(spark, sf_dir).collect()
                verdict, times = f"rows only: {len(rows)} {rows[:2]}", round(time.time() - start, 2)
        except Exception as error:  # noqa: BLE001
            verdict, times = f"ERROR {str(error)[:600]}", None
        print(name, "ok" if verdict is None else verdict, times, flush=True)
