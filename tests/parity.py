"""python tests/parity.py SF_DIR [NAME...]: each query against its SQL in DuckDB, rows compared regardless of order."""

import glob
import math
import os
import sys

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "is_finite"):
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        inner = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{inner}'")
    return con


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"rows {len(got)} / {len(want)}; first differing: {bad}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, bad = connect(sys.argv[1]), e.queries(), e.oracle_sql(), 0
    for name in sys.argv[2:] or list(queries):
        try:
            if name not in oracles:
                print(name, "no SQL,", queries[name](spark, sys.argv[1]).count(), "rows", flush=True)
                continue
            said = compare(spark, con, queries[name], oracles[name], sys.argv[1])
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:400]}"
        bad += bool(said)
        print(name, said or "equal", flush=True)
    sys.exit(bool(bad))
