"""Run every registered query beside its SQL and compare rows; also usable from the shell.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        return f"f{value:.9g}" if value else "f0"
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(set(ours.columns) ^ set(theirs.columns))}"
    whole = [c for c in theirs.columns if str(theirs[c].dtype) == "Int64" and ours[c].dtype.kind == "f"]
    ours = ours.astype({c: "Int64" for c in whole})  # whole numbers with nulls, which pandas gets from Spark as floats
    a, b = rows_of(ours), rows_of(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first {sorted(ours.columns)} {wrong[0][0]} / {wrong[0][1]}"
    strange = {c: (k, kinds(theirs)[c]) for c, k in kinds(ours).items() if k != kinds(theirs)[c]}
    return f"ok but kinds {strange}" if strange else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from smsight.session import local_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        try:
            t = time.time()
            ours = run(spark, folder).toPandas()
            t1 = time.time()
            theirs = con.execute(sql[name]).df() if name in sql else None
            t2 = time.time()
            problem = f"no SQL, {len(ours)} rows" if theirs is None else compare(ours, theirs)
            print(f"{'ok  ' if problem is None else 'DIFF' if theirs is not None else 'rows'} {name} "
                  f"n={len(ours)} spark={t1 - t:.2f}s duckdb={t2 - t1:.2f}s {problem or ''}", flush=True)
            failed += problem is not None and theirs is not None
        except Exception as error:  # report and go on
            failed += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
