"""Run queries next to their oracles and compare values.

    python -m workload.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

DEFAULT_DIR = "/root/testdata/sf0.01"


def local_session(name: str = "spanvigil") -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else f"{number + 0.0:.6g}" if abs(number) < 1e5 else f"{number:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_cell, value)) + "]"
    return str(value)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, con, query, oracle, sf_dir):
    """None when both sides agree, else a short description; plus rows, seconds."""
    start = time.time()
    frame = query(spark, sf_dir)
    rows = frame.collect()
    seconds = time.time() - start
    if oracle is None:
        return None, len(rows), seconds
    relation = con.sql(oracle)
    left = normalised(frame.columns, rows)
    right = normalised(relation.columns, relation.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", len(rows), seconds
    if left[1] != right[1]:
        only_left = [r for r in left[1] if r not in set(right[1])]
        only_right = [r for r in right[1] if r not in set(left[1])]
        return (
            f"{len(left[1])} vs {len(right[1])} rows\n  cols {left[0]}\n  spark  {only_left[:4]}\n  oracle {only_right[:4]}",
            len(rows),
            seconds,
        )
    return None, len(rows), seconds


def main(argv):
    from workload.catalog import ORACLES, QUERIES

    sf_dir = argv[0] if argv else DEFAULT_DIR
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(), oracle_connection(sf_dir)
    bad = 0
    for name in names:
        try:
            problem, n, seconds = difference(spark, con, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as error:  # report and go on with the other queries
            problem, n, seconds = f"{type(error).__name__}: {str(error)[:900]}", -1, 0.0
        bad += problem is not None
        state = "FAIL" if problem else "ok  " if name in ORACLES else "rows"
        print(f"{state} {name:28s} {n:7d} rows {seconds:6.2f}s" + (f"  {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
