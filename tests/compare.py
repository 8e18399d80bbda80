"""Run registered queries and their SQL side by side: `python tests/compare.py [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def difference(df, con, sql: str) -> str | None:
    """None if rows, column names and kinds of type agree, else what does not."""
    names = sorted(df.columns)
    ours = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    types = {d[0]: str(d[1]) for d in cursor.description}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(n, t, types[n]) for n, t in df.dtypes if kinds.get(t) != types[n]]
    theirs = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    a, b = sorted(ours, key=key), sorted(theirs, key=key)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, e.g. {wrong[0]}"[:600]
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            found = difference(df, con, sql[name]) if name in sql else f"rows only: {len(df.collect())}"
            print(f"{'ok  ' if found is None else '    '}{name} {time.time() - start:.1f}s {found or ''}", flush=True)
        except Exception as e:
            print(f"FAIL {name} {time.time() - start:.1f}s {type(e).__name__} {str(e)[:500]}", flush=True)
