"""Run registered queries beside their SQL and report differences: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.catalog import QUERIES
from checks.oracle import ORACLE

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shoptrace")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str, threads: int | None = None) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    if threads:
        con.execute(f"SET threads = {threads}")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame[sorted(frame.columns)].copy()
    for name in out.columns:
        out[name] = [_text(v) for v in out[name]]
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def _text(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "hour"):
        stamp = pd.Timestamp(value)
        return str(stamp.date()) if stamp == stamp.normalize() else str(stamp)
    if hasattr(value, "year"):
        return str(value)[:10]
    if isinstance(value, str):
        return repr(value)
    try:
        return repr(float(value) + 0.0)
    except (TypeError, ValueError):
        return str(value)


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when both hold the same rows; otherwise what differs."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    a, b = _canonical(ours), _canonical(theirs)
    if a.equals(b):
        return None
    wrong = (a != b).any(axis=1)
    return f"{int(wrong.sum())} rows differ, first:\n{a[wrong].head(3).to_string()}\n{b[wrong].head(3).to_string()}"


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(), connect(folder)
    failed = 0
    for name in names:
        started = time.time()
        try:
            ours = QUERIES[name](spark, folder).toPandas()
            spent = time.time() - started
            if name in ORACLE:
                result = con.execute(ORACLE[name])
                problem = differences(ours, result.df())
            else:
                problem = None if len(ours) else "no rows"
        except Exception as error:  # report and go on with the next query
            spent, ours = time.time() - started, []
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={len(ours)} {spent:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
