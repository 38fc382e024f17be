"""Revenue distribution, trends, top lists and basket size, over purchase events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptrace.functions.rules import cents, mean_money, money, pct, quantile2
from shoptrace.operators.ordering import histogram, quantile, value_counts, with_cumulative
from shoptrace.operators.sampling import sample_groups
from shoptrace.sources.tables import materialise


def revenue_distribution(purchases: DataFrame) -> DataFrame:
    """Rows, total, mean, median, p90, p99 and maximum price. One pass over the log; the rest works on distinct prices."""
    counts = materialise(value_counts(purchases, "price"), "price-counts")
    total = F.sum(cents("price") * F.col("n"))
    return with_cumulative(counts, "price", ["n"]).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("purchase_rows"),
        money(total).alias("total_revenue_proxy"),
        mean_money(total, F.sum("n")).alias("avg_purchase_price"),
        quantile2(quantile(0.50, "price")).alias("median_purchase_price"),
        quantile2(quantile(0.90, "price")).alias("p90_purchase_price"),
        quantile2(quantile(0.99, "price")).alias("p99_purchase_price"),
        money(F.max(cents("price"))).alias("max_purchase_price"),
    )


def price_histogram(purchases: DataFrame, bins: int = 60, upper_q: float | None = None) -> DataFrame:
    """Equal-width histogram of prices, of all or of those up to a quantile."""
    counts = materialise(value_counts(purchases, "price"), "price-counts")
    if upper_q is not None:
        limit = with_cumulative(counts, "price", ["n"]).agg(quantile(upper_q, "price").alias("q")).scalar()
        counts = counts.where(F.col("price") <= limit)
    return histogram(counts, "price", bins)


def monthly_trend(purchases: DataFrame) -> DataFrame:
    total = F.sum(cents("price"))
    return (
        purchases.groupBy("month_date")
        .agg(
            F.count(F.lit(1)).alias("purchase_events"),
            F.count_distinct("user_id").alias("purchasing_users"),
            money(total).alias("revenue_proxy"),
            mean_money(total, F.count(F.lit(1))).alias("avg_purchase_price"),
        )
        .orderBy("month_date")
    )


def monthly_growth(trend: DataFrame) -> DataFrame:
    """Revenue change against the previous month present, in percent. The window sees one row per month."""
    previous = F.lag(cents("revenue_proxy")).over(Window.orderBy("month_date"))
    return trend.select(
        "month_date",
        "revenue_proxy",
        money(previous).alias("previous_revenue_proxy"),
        pct(cents("revenue_proxy") - previous, previous).alias("growth_pct"),
    )


def daily_trend(purchases: DataFrame) -> DataFrame:
    return (
        purchases.groupBy("event_date")
        .agg(
            F.count(F.lit(1)).alias("purchase_events"),
            F.count_distinct("user_id").alias("purchasing_users"),
            money(F.sum(cents("price"))).alias("revenue_proxy"),
        )
        .orderBy("event_date")
    )


def top_customers(purchases: DataFrame, k: int = 15) -> DataFrame:
    total = F.sum(cents("price"))
    return (
        purchases.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("purchase_events"),
            F.count_distinct("user_session").alias("purchase_sessions"),
            money(total).alias("revenue_proxy"),
            mean_money(total, F.count(F.lit(1))).alias("avg_purchase_price"),
        )
        .orderBy(F.desc("revenue_proxy"), "user_id")
        .limit(k)
    )


def top_products(purchases: DataFrame, k: int = 15) -> DataFrame:
    return (
        purchases.groupBy("product_id", "brand", "category_code")
        .agg(
            F.count(F.lit(1)).alias("purchase_events"),
            F.count_distinct("user_id").alias("buyers"),
            money(F.sum(cents("price"))).alias("revenue_proxy"),
        )
        .orderBy(F.desc("revenue_proxy"), F.asc_nulls_last("product_id"), "brand", "category_code")
        .limit(k)
        .withColumn("label", F.concat_ws(" | ", F.col("product_id").cast("string"), "brand"))
    )


def basket_summary(purchases: DataFrame) -> DataFrame:
    """Items and revenue per (session, user): means, medians and the 90th percentile of items.

    Both measures go through one narrow table of distinct values, so sessions are formed once.
    """
    baskets = purchases.groupBy("user_session", "user_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum(cents("price")).alias("c")
    )
    measures = baskets.select(
        F.explode(
            F.array(
                F.struct(F.lit("items").alias("measure"), F.col("items").cast("double").alias("value")),
                F.struct(F.lit("revenue").alias("measure"), money("c").alias("value")),
            )
        ).alias("m")
    ).select("m.*")
    counts = materialise(value_counts(measures, "value", ["measure"]), "basket-counts")
    per_measure = with_cumulative(counts, "value", ["n"], ["measure"]).groupBy("measure").agg(
        F.sum("n").alias("n"),
        mean_money(F.sum(cents("value") * F.col("n")), F.sum("n")).alias("mean"),
        quantile2(quantile(0.5, "value")).alias("median"),
        quantile2(quantile(0.9, "value")).alias("p90"),
    )

    def pick(measure: str, column: str):
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    return per_measure.agg(
        F.coalesce(pick("items", "n"), F.lit(0)).alias("purchase_sessions"),
        pick("items", "mean").alias("avg_items_per_purchase_session"),
        pick("items", "median").alias("median_items_per_purchase_session"),
        pick("items", "p90").alias("p90_items_per_purchase_session"),
        pick("revenue", "mean").alias("avg_revenue_per_purchase_session"),
        pick("revenue", "median").alias("median_revenue_per_purchase_session"),
    )


def basket_distribution(purchases: DataFrame) -> DataFrame:
    """Sessions per number of items; here a session is its id alone."""
    return (
        purchases.groupBy("user_session")
        .agg(F.count(F.lit(1)).alias("items_in_session"))
        .groupBy("items_in_session")
        .agg(F.count(F.lit(1)).alias("session_count"))
        .orderBy("items_in_session")
    )


def session_revenue_sample(purchases: DataFrame, n: int = 200_000, seed: int = 0) -> DataFrame:
    """Revenue of n sampled sessions, the same ones on every run. Only events of drawn sessions are shuffled."""

    def revenues(events: DataFrame) -> DataFrame:
        summed = events.groupBy("user_session").agg(F.sum(cents("price")).alias("c"))
        return summed.select("user_session", money("c").alias("session_revenue_proxy"))

    return sample_groups(purchases, "user_session", n, revenues, seed)


def session_revenue_histogram(sample: DataFrame, bins: int = 60) -> DataFrame:
    counts = materialise(value_counts(sample, "session_revenue_proxy"), "session-revenue-counts")
    return histogram(counts, "session_revenue_proxy", bins)
