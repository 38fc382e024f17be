"""A training-data pipeline over ``documents``: quality rules, near-dedup, PII, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``. Packing groups follow the mixed order, which is the order of rows in the written files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptrace.llm import mixing, near_dedup, packing, pii, quality_rules
from shoptrace.llm.shared import documents, ship
from shoptrace.sources.tables import materialise


ORDER = ("in_part", "in_file", "in_row")


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the place of each row: of a written table by file and row, else by part and row.

    Spark deals files out by size, so the order of rows is read off the files. Other columns are left out, whatever their names.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta)
        file = meta["file_name"]
        places = (F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long"), file, meta["row_index"])
    except AnalysisException:  # no written table
        places = (F.lit(0), F.lit(""), F.monotonically_increasing_id())
    return docs.select(docs["doc_id"], docs["text"], *(p.alias(c) for p, c in zip(places, ORDER, strict=True)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.interleave(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(packing.token_lengths(in_order(docs), ORDER), order=ORDER)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fertility bands need vocabularies, MinHash and best-fit are no SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written and read again, the last one returned."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
