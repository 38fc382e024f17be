"""Two event logs derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the tables read here; stating them saves a pass over the file footers.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_extendedprice double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _products(spark: SparkSession, folder: str) -> DataFrame:
    """All products with a category of some hundreds."""
    return _table(spark, folder, "part").selectExpr("p_partkey", "p_brand", "concat(p_type, '.', p_size) AS category")


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """A dirty log: padded and upper-case types, blank and NULL labels, odd prices, blank sessions; ``src`` is the file."""
    keyed = _table(spark, folder, "events").selectExpr(
        "*", "cast(get_json_object(props, '$.k') AS bigint) AS product_id"
    )
    return keyed.join(_products(spark, folder), F.expr("product_id = p_partkey"), "left").selectExpr(
        "substring(cast(ts AS string), 1, 19) AS event_time",
        "CASE event_type WHEN 'click' THEN ' Cart ' WHEN 'purchase' THEN 'PURCHASE' ELSE event_type END AS event_type",
        "product_id",
        "product_id % 6 AS category_id",
        "CASE WHEN product_id % 10 = 9 THEN '' ELSE category END AS category_code",
        "CASE product_id % 10 WHEN 9 THEN NULL WHEN 8 THEN '  ' WHEN 7 THEN concat(p_brand, ' \"a, b\"') ELSE p_brand END AS brand",
        "CASE WHEN event_id % 97 = 0 THEN 0D WHEN event_id % 101 = 0 THEN -value "
        "WHEN event_id % 103 = 0 THEN NULL ELSE value END AS price",
        "user_id",
        "CASE WHEN event_id % 89 = 0 THEN '' ELSE concat(user_id, '-', dayofyear(ts) div 7) END AS user_session",
        "CASE WHEN ts < TIMESTAMP_NTZ '2024-01-16 00:00:00' THEN 'part_a' ELSE 'part_b' END AS src",
    )


def raw_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """A log over many months: order lines as view, cart or purchase events of yearly sessions."""
    lines = _table(spark, folder, "lineitem").selectExpr("*", "l_partkey AS product_id")
    return (
        lines.join(_table(spark, folder, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(_products(spark, folder), F.expr("product_id = p_partkey"), "left")
        .selectExpr(
            "o_orderdate AS event_time",
            "CASE l_returnflag WHEN 'N' THEN 'view' WHEN 'A' THEN 'cart' ELSE 'purchase' END AS event_type",
            "product_id",
            "product_id % 6 AS category_id",
            "CASE WHEN product_id % 10 = 9 THEN '' ELSE category END AS category_code",
            "CASE WHEN product_id % 10 = 9 THEN NULL ELSE p_brand END AS brand",
            "l_extendedprice AS price",
            "o_custkey AS user_id",
            "concat(o_custkey, '-', year(o_orderdate)) AS user_session",
        )
    )
