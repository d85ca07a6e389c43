"""Compares queries with their SQL: python -m tests.oracle_check SF_DIR [NAME...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame) -> tuple:
    names = sorted(frame.columns)
    return names, sorted(repr(tuple(float(f"{x:.6f}") + 0.0 if isinstance(x, float) else x for x in r)) for r in frame[names].itertuples(index=False, name=None))


def compare(spark, sf_dir: str, name: str, f, sql: str) -> str:
    """Empty if equal, else what differs."""
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    a, b = rows(f(spark, sf_dir).toPandas()), rows(db.sql(sql).df())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    differ = [(x, y) for x, y in zip(a[1], b[1], strict=False) if x != y]
    return f"{len(a[1])} and {len(b[1])} rows, {len(differ)} differ: {str(differ[:2])[:600]}" if differ or len(a[1]) != len(b[1]) else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sqls = __spark_entry__.oracle_sql()
    for name, f in __spark_entry__.queries().items():
        if name in sqls and (not sys.argv[2:] or name in sys.argv[2:]):
            began = time.time()
            try:
                said = compare(spark, sys.argv[1], name, f, sqls[name])
            except Exception as e:
                said = f"{type(e).__name__} {str(e)[:500]}"
            print(name, said or "equal", f"{time.time() - began:.1f} s", flush=True)
