"""Compare a registered query with its SQL counterpart in DuckDB."""

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

TABLE_ROOT = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 4) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def normalized(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, build, sql, folder):
    """None when both sides agree, else a short description."""
    df = build(spark, folder)
    left = normalized(df.columns, [tuple(r) for r in df.collect()])
    cursor = connect(folder).execute(sql)
    right = normalized([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows; only spark {_only(left, right)}; only sql {_only(right, left)}"
    if left[1] != right[1]:
        bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
        return f"{len(bad)} of {len(left[1])} rows differ, first {str(bad[0][0])[:600]} != {str(bad[0][1])[:600]}"
    return None


def _only(a, b):
    return str(sorted(set(a[1]) - set(b[1]), key=repr)[:2])[:400]


def session(cpus=8, partitions=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    # python -m tests.compare SCALE [NAME ...]
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = session()
    for name in names:
        start = time.time()
        try:
            if name in sql:
                verdict = difference(spark, queries[name], sql[name], f"{TABLE_ROOT}/{sys.argv[1]}") or "ok"
            else:
                verdict = f"rows {queries[name](spark, f'{TABLE_ROOT}/{sys.argv[1]}').count()}"
        except Exception as error:  # report and go on with the next query
            verdict = f"FAILED {type(error).__name__} {str(error)[:900]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {verdict}", flush=True)
