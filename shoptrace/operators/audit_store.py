"""Audit records kept per file: a later run reads only the files it has not seen.

The store is a folder with two Parquet tables, ``records`` (``audit.file_records``) and ``top_prices`` (``audit.audit_top_prices``), each row
marked with the file's path, size and modification time and the price limit. A file is unseen if no record has its mark: a new file, or
one written anew. Records of files that are gone, or have changed since, stay in the store but are not returned.

Rows are only ever appended, ``records`` last, so a run that fails half-way leaves its files unseen and is simply repeated; rows
written twice are equal and count once. A file without rows leaves a record of 0 rows, so it isn't read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptrace.operators import audit
from shoptrace.sources.events import list_files, read_events

MARK = ("src", "file_size", "modified", "high_limit")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:  # nothing stored yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def unseen_files(spark: SparkSession, paths: Sequence[str], store: str, high: float = audit.HIGH_PRICE) -> DataFrame:
    """(delivery, *MARK) of the files of these paths that the store has no record of."""
    files = list_files(spark, paths).withColumn("high_limit", F.lit(float(high)))
    known = _table(spark, f"{store}/records")
    return files if known is None else files.join(known.select(*MARK).distinct(), list(MARK), "left_anti")


def refresh(spark: SparkSession, paths: Sequence[str], store: str, high: float = audit.HIGH_PRICE) -> int:
    """Bring the store up to date with the files of ``paths``; returns how many files were read.

    Names of unseen files pass through the driver, as the names of all files do in any scan.
    """
    unseen = unseen_files(spark, paths, store, high)
    by_delivery: dict[int, list[str]] = {}
    for row in unseen.select("delivery", "src").collect():
        by_delivery.setdefault(row.delivery, []).append(row.src)
    if not by_delivery:
        return 0
    raw = read_events(spark, [by_delivery[d] for d in sorted(by_delivery)])
    marks = unseen.select(*MARK)
    top = audit.audit_top_prices(raw).join(marks, "src")
    top.write.mode("append").parquet(f"{store}/top_prices")
    records = marks.join(audit.file_records(raw, high), "src", "left").fillna(0)
    records.write.mode("append").parquet(f"{store}/records")
    return sum(map(len, by_delivery.values()))


def stored(spark: SparkSession, paths: Sequence[str], store: str, high: float = audit.HIGH_PRICE) -> tuple[DataFrame, DataFrame]:
    """The records and the top prices of the files that are in ``paths`` now."""
    marks = list_files(spark, paths).select("src", "file_size", "modified", F.lit(float(high)).alias("high_limit"))
    records, top = (spark.read.parquet(f"{store}/{t}").join(marks, list(MARK), "left_semi") for t in ("records", "top_prices"))
    plain = [c for c in MARK if c != "src"]
    return records.dropDuplicates([*MARK, "event_type"]).drop(*plain), top.dropDuplicates([*MARK, "price_rank"]).drop(*plain)


def incremental_audit(spark: SparkSession, paths: Sequence[str], store: str, high: float = audit.HIGH_PRICE) -> DataFrame:
    """``audit.audit_combined`` of all files of ``paths``, of which only unseen ones are read."""
    refresh(spark, paths, store, high)
    return audit.combined(stored(spark, paths, store, high)[0])
