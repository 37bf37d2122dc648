"""Run registered queries and their SQL side by side.

    python -m tests.compare /root/testdata/sf0.01 [name or prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def sql_session(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{folder}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or v is pd.NaT:
            return "NULL"
        if isinstance(v, bool):
            return f"b:{v}"
        if isinstance(v, float):
            return "f:" + repr(0.0 if v == 0 else v)
        if isinstance(v, int):
            return f"i:{v}"
        return f"{type(v).__name__}:{v}"

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    columns = spark_df.columns
    mine = canonical([tuple(r) for r in spark_df.collect()], columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = canonical(cursor.fetchall(), names)
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} rows differ, e.g. {wrong[0]}" if wrong else None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from gapwise.session import build_session

    spark, con = build_session(), sql_session(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    chosen = [q for q in queries if not names or any(q.startswith(n) for n in names)]
    failed = []
    for name in chosen:
        start = time.perf_counter()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                problem = difference(df, con, oracle[name])
            else:
                rows = df.collect()
                problem = None
                print("   ", rows[:3])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        took = time.perf_counter() - start
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.2f}s "
              f"{'' if name in oracle else '(rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(chosen) - len(failed)}/{len(chosen)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
