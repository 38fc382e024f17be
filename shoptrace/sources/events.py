"""Reading raw and cleaned event logs, writing results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
#: Column with the text of a line that does not fit its file's header.
CORRUPT = "_corrupt_record"

# The columns of an event log.
EVENT_COLUMNS = (
    "event_time",
    "event_type",
    "product_id",
    "category_id",
    "category_code",
    "brand",
    "price",
    "user_id",
    "user_session",
)


def read_events(spark: SparkSession, paths: Sequence[str | list[str]], multi_line: bool = False, keep_corrupt: bool = False) -> DataFrame:
    """Header CSV logs, one path (file, folder or glob) or list of paths per delivery, matched by column name, duplicates kept.

    Every column is text: types are fixed later by the cleaning step, so nothing drifts between deliveries and no pass over
    the data is spent on inference. ``src`` is the full path of the
    file a row came from. Quoted fields follow the CSV standard: a quote inside is doubled. Within one delivery the headers must agree;
    Spark checks that and raises. Line breaks inside quoted fields need ``multi_line``: without it a row ends at each line end, with it
    a file is no longer split, so one task reads each file and many files of moderate size should be given. ``keep_corrupt`` adds a
    column with the text of lines that have too few or too many fields, whose missing fields are NULL.
    """
    if not paths:
        raise ValueError("read_events needs at least one path")
    reader = spark.read.option("header", True).option("enforceSchema", False).option("escape", QUOTE)
    reader = reader.option("multiLine", multi_line)
    logs = []
    for path in paths:
        log = reader.csv(path)
        if keep_corrupt:
            wide = T.StructType([*log.schema, T.StructField(CORRUPT, T.StringType())])
            whole = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)  # pruned lines are not judged
            log = whole.schema(wide).csv(path)
        logs.append(log.withColumn("src", F.col("_metadata.file_path")))
    merged = union_logs(logs)
    for name in EVENT_COLUMNS:
        if not has_column(merged, name):
            merged = merged.withColumn(name, F.lit(None).cast("string"))
    return merged


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(delivery, src, file_size, modified) of the files of each path; their contents are not read."""
    listed = []
    for number, path in enumerate(paths):
        files = spark.read.format("binaryFile").load(path)
        mark = [F.col(f"_metadata.{c}").alias(name) for c, name in (("file_path", "src"), ("file_size", "file_size"), ("file_modification_time", "modified"))]
        listed.append(files.select(F.lit(number).alias("delivery"), *mark))
    return reduce(DataFrame.unionByName, listed)


def union_logs(logs: Sequence[DataFrame]) -> DataFrame:
    """Union of deliveries by column name; a column absent from one is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def has_column(df: DataFrame, name: str) -> bool:
    """Whether an optional column, such as ``country``, is present."""
    return name in df.columns


def write_events(typed: DataFrame, path: str) -> None:
    """Store cleaned events partitioned by type, so later readers prune to the types they ask for.

    Rows keep their arrival order, which keeps the time range of each row group narrow; no shuffle is spent.
    """
    typed.write.mode("overwrite").partitionBy("event_type").parquet(path)


def write_parts(df: DataFrame, path: str, by: str) -> None:
    """Replace just those parts (values of ``by``) of a stored table that ``df`` has rows of; other parts are not touched.

    A part is replaced as a whole when the job commits, so a run that failed can be repeated and leaves no rows behind.
    """
    write_result(df, path, "parquet", by)


def write_result(df: DataFrame, path: str, fmt: str = "csv", by: str | None = None) -> None:
    """Store a result table as header CSV (blanks preserved) or Parquet.

    With ``by``, such as a month column, only the parts that ``df`` has rows of are replaced.
    """
    writer = df.write.mode("overwrite")
    if by is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(by)
    if fmt == "csv":
        (
            writer.option("header", True)
            .option("escape", QUOTE)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown result format {fmt!r}")
