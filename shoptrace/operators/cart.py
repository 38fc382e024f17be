"""Cart abandonment over (session, product) pairs with a cart event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptrace.functions.rules import UNKNOWN, cents, mean_money, pct

MIN_PAIRS = 5_000

def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def _mean_price(flag: str | None = None) -> Column:
    price = cents("product_price")
    if flag is not None:
        price = F.when(F.col(flag) == 1, price)
    return mean_money(F.sum(price), F.count(price))


def _abandon_pct() -> Column:
    return pct(F.sum("cart_abandoned"), F.count(F.lit(1))).alias("cart_abandonment_rate_pct")


def _bought_pct() -> Column:
    return pct(F.sum("saw_purchase_event"), F.count(F.lit(1))).alias("cart_to_purchase_rate_pct")


def cart_overview(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("cart_session_products"),
        F.count_distinct("user_session").alias("cart_sessions"),
        _sum("saw_purchase_event").alias("purchased_after_cart"),
        _sum("cart_abandoned").alias("abandoned_after_cart"),
        _abandon_pct(),
        _bought_pct(),
        _mean_price("cart_abandoned").alias("avg_abandoned_cart_price"),
        _mean_price("saw_purchase_event").alias("avg_converted_cart_price"),
    )


def cart_monthly(pairs: DataFrame) -> DataFrame:
    """By the month of a pair's first event of any type."""
    return (
        pairs.groupBy(F.col("first_month").alias("month_date"))
        .agg(
            F.count(F.lit(1)).alias("cart_session_products"),
            F.sum("cart_abandoned").alias("abandoned_after_cart"),
            _abandon_pct(),
            _bought_pct(),
        )
        .orderBy("month_date")
    )


def cart_by_category(pairs: DataFrame) -> DataFrame:
    return (
        pairs.groupBy("category_code")
        .agg(
            F.count(F.lit(1)).alias("cart_session_products"),
            F.sum("cart_abandoned").alias("abandoned_after_cart"),
            F.sum("saw_purchase_event").alias("purchased_after_cart"),
            _abandon_pct(),
            _mean_price().alias("avg_cart_price"),
        )
        .orderBy(F.desc("abandoned_after_cart"), "category_code")
    )


def cart_by_price_band(pairs: DataFrame) -> DataFrame:
    return (
        pairs.groupBy("price_band", "band_order")
        .agg(
            F.count(F.lit(1)).alias("cart_session_products"),
            F.sum("cart_abandoned").alias("abandoned_after_cart"),
            F.sum("saw_purchase_event").alias("purchased_after_cart"),
            _abandon_pct(),
        )
        .orderBy("band_order")
    )


def cart_top_categories(by_category: DataFrame, min_pairs: int = MIN_PAIRS, k: int = 10) -> DataFrame:
    """Known categories with enough pairs, most abandoned pairs first."""
    return (
        by_category.where((F.col("cart_session_products") >= min_pairs) & (F.col("category_code") != UNKNOWN))
        .orderBy(F.desc("abandoned_after_cart"), "category_code")
        .limit(k)
    )


def cart_extremes(by_band: DataFrame, monthly: DataFrame) -> DataFrame:
    """The price band that loses most, and the latest month. Columns: fact, label, cart_abandonment_rate_pct."""
    worst = by_band.orderBy(F.desc("cart_abandonment_rate_pct"), "band_order").limit(1)
    latest = monthly.where(F.col("month_date").isNotNull()).orderBy(F.desc("month_date")).limit(1)
    rate = "cart_abandonment_rate_pct"
    return worst.select(F.lit("worst_price_band").alias("fact"), F.col("price_band").alias("label"), rate).unionByName(
        latest.select(F.lit("latest_month").alias("fact"), F.col("month_date").cast("string").alias("label"), rate)
    )
