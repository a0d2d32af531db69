"""Run registered queries next to their SQL twins and compare every value.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    missing = frame.isna().to_numpy()
    values = frame.to_numpy(dtype=object, copy=True)
    values[missing] = None
    return sorted(map(tuple, values.tolist()), key=repr)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)}/{len(a)} rows differ, first {wrong[0][0]} != {wrong[0][1]}"
    return None


def main(argv: list[str]) -> int:
    from checks.oracle import SQL
    from checks.queries import QUERIES

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = session(os.environ.get("BENCH_CPUS", "8")), database(sf)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            middle = time.time()
            if name not in SQL:
                print(f"rows {name}: {len(got)} in {middle - start:.1f}s", flush=True)
                continue
            problem = differences(got, con.execute(SQL[name]).df())
        except Exception as error:  # report and go on with the next query
            middle, problem, got = time.time(), f"{type(error).__name__}: {str(error)[:900]}", []
        failed += problem is not None
        print(
            f"{'FAIL' if problem else 'ok'} {name}: {len(got)} rows, spark {middle - start:.1f}s, "
            f"sql {time.time() - middle:.1f}s {problem or ''}",
            flush=True,
        )
    print(f"{len(names) - failed}/{len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
