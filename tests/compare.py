"""Run queries in Spark and DuckDB and compare rows, names and types. Usage: compare.py <sf folder> [query ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def same(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b
    return a == b


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}: {got[:1]} / {want[:1]}"
    diff = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ, first {sorted(names)} {diff[0]}"
    kinds = {str(d[0]): str(d[1]) for d in result.description}
    spark_kinds = dict(df.dtypes)
    pairs = {"bigint": {"BIGINT", "NUMBER"}, "int": {"INTEGER", "NUMBER"}, "double": {"DOUBLE", "NUMBER"}}
    types = [
        f"{n}:{spark_kinds[n]}/{kinds[n]}" for n in names if spark_kinds[n] in pairs and kinds[n] not in pairs[spark_kinds[n]]
    ]
    return "types " + ", ".join(types) if types else ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from skyloom.session import session

    spark = session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sys.argv[1])
    wanted = sys.argv[2:]
    bad = 0
    for name, sql in oracle_sql().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, queries()[name], sql, sys.argv[1])
        except Exception as error:
            problem = "error " + str(error)[:700]
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '}{name:28s}{time.time() - start:7.2f} {problem}", flush=True)
    print("bad:", bad, "without SQL:", sorted(set(queries()) - set(oracle_sql())))
