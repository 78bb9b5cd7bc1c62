"""Run registered queries beside their SQL and compare the values.

    python tests/check_oracle.py [folder] [query ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from pagelode.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    return db


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]

    def text(value):
        if value is None or value is pd.NaT or value != value:
            return "null"
        if isinstance(value, float):
            return repr(value + 0.0)
        return repr(value.item()) if hasattr(value, "item") else repr(value)

    return sorted(
        tuple(text(v) for v in row) for row in frame.astype(object).itertuples(index=False)
    )


def compare(got: pd.DataFrame, wanted: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} != {sorted(wanted.columns)}"
    left, right = rows(got), rows(wanted)
    if left == right:
        return ""
    only_left = [r for r in left if r not in set(right)][:2]
    only_right = [r for r in right if r not in set(left)][:2]
    return f"{len(left)} rows / {len(right)} rows\n   spark {only_left}\n   sql   {only_right}"


def main(folder, names):
    from __spark_entry__ import oracle_sql, queries

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db, sql, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        try:
            start = time.time()
            got = run(spark, folder).toPandas()
            took = time.time() - start
            start = time.time()
            wanted = db.execute(sql[name]).df() if name in sql else None
            sql_took = time.time() - start
            verdict = "" if wanted is None else compare(got, wanted)
        except Exception as error:  # report and go on
            took = sql_took = -1
            got, verdict = [], f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(verdict)
        mark = "FAIL" if verdict else "ok" if name in sql else "rows"
        print(f"{mark:5}{name:25}{len(got):9} rows {took:7.2f}s  sql {sql_took:5.2f}s {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
