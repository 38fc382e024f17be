"""Intermediate tables that several steps read.

They are written as Parquet to the shared folder of ``spark.checkpoint.dir``: a lost executor costs nothing, each reader
prunes columns, and real sizes reach the optimiser.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="shoptrace-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/shoptrace/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return a reader of the written table."""
    return written(df, label)[0]


def written(df: DataFrame, label: str = "table") -> tuple[DataFrame, str]:
    """Write ``df`` once; a reader of the written table, and its path for ``release``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written_bucketed(df: DataFrame, label: str, columns: Sequence[str], buckets: int) -> tuple[DataFrame, str]:
    """``written``, hashed and sorted by ``columns`` into buckets: grouping or joining on these (and more) columns needs no shuffle.

    A bucket is read by one task, so no combination of the columns' values may hold a large part of the rows.
    """
    spark = df.sparkSession
    path, name = new_path(spark, label), f"shoptrace_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, *columns)  # one file per bucket
    spread.write.bucketBy(buckets, *columns).sortBy(*columns).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name), path


def release(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written`` that nothing will read again. Only folders below the shared one are accepted."""
    if not path.startswith(f"{shared_folder(spark)}/shoptrace/"):
        raise ValueError(f"not an intermediate table: {path}")
    files, place = _files(spark, path)
    files.delete(place, True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a whole table lies there: the writer leaves its mark last."""
    files, mark = _files(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place
