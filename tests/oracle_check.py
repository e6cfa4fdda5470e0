"""Compare registered queries with their reference SQL on one data folder.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


TYPES = {
    "bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def compare(spark, con, sf_dir, name, run, sql):
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return "rows-only" if got else "EMPTY", len(got), ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), f"{sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        a, b = set(got), set(want)
        return "VALUES", len(got), f"want {len(want)} rows; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    bad = {c: (t, types[c]) for c, t in df.dtypes if TYPES.get(t, t) != types[c]}
    if bad:
        return "TYPES", len(got), str(bad)
    return ("ok" if got else "EMPTY"), len(got), ""


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            status, n, note = compare(spark, con, sf_dir, name, run, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            status, n, note = "ERROR", 0, f"{type(e).__name__}: {str(e)[:400]}"
        failed += status not in ("ok", "rows-only")
        print(f"{status:10} {name:36} rows={n} {time.time() - began:.2f}s {note}", flush=True)
    print("failed", failed, "queries", len(queries), "oracles", len(oracles))
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
