"""Compare registered queries with their SQL: python tests/oracle_check.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)


def views(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(f"{x:.9g}") + 0.0 if isinstance(x, float) else bool(x) if type(x).__name__ == "bool_" else x


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def differs(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """What differs between the two results, or an empty text."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows; {ours[:2]} {theirs[:2]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows, such as {bad[0]}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sqls = views(sf_dir), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or list(queries):
        began = time.time()
        try:
            said = differs(spark, con, name, queries[name], sqls[name], sf_dir) if name in sqls else f"rows {queries[name](spark, sf_dir).count()} (no SQL)"
        except Exception as error:
            said = f"FAILED {type(error).__name__}: {str(error)[:400]}"
        print(f"\n@@ {name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
