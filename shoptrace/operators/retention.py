"""Cohort retention and repeat purchases.

``sessions`` is one row per (user, session), ``journey`` one row per user; both are usually written tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrace.functions.rules import cents, mean2, money, month_of, months_between, pct, quantile2
from shoptrace.operators.ordering import histogram, value_counts
from shoptrace.sources.tables import materialise


def _user_months(sessions: DataFrame) -> DataFrame:
    """One row per (user, month): sessions and cents. A busy user shrinks to one row per month before any window."""
    return sessions.groupBy("user_id", month_of("session_date").alias("month_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("session_value")).alias("c")
    )


def cohort_activity(sessions: DataFrame) -> DataFrame:
    """Customers active per cohort month and activity month.

    A user's cohort is the least of their active months, so no join with the journey is needed, and after merging sessions
    to (user, month) a plain count is a distinct count.
    """
    active = _user_months(sessions).select(
        F.min("month_date").over(Window.partitionBy("user_id")).alias("cohort_month"),
        F.col("month_date").alias("activity_month"),
    )
    return (
        active.groupBy("cohort_month", "activity_month")
        .agg(F.count(F.lit(1)).alias("active_customers"))
        .select(
            "cohort_month",
            "activity_month",
            months_between("cohort_month", "activity_month").alias("month_number"),
            "active_customers",
        )
    )


def cohort_sizes(journey: DataFrame) -> DataFrame:
    return journey.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))


def cohort_retention(activity: DataFrame, sizes: DataFrame) -> DataFrame:
    """Share of a cohort active in each later month. Both sides have at most one row per pair of months."""
    return (
        activity.join(sizes, "cohort_month")
        .withColumn("retention_pct", pct("active_customers", "cohort_size"))
        .orderBy("cohort_month", "month_number")
    )


def cohort_heatmap(retention: DataFrame, months: Sequence[int] | None = None) -> DataFrame:
    """Cohorts by months since first purchase (columns m0, m1, ...), gaps 0.

    Without ``months`` the columns are the month numbers that occur, as many as the calendar has; they are read first, so
    ``retention`` should be a written table.
    """
    wide = retention.groupBy("cohort_month").pivot("month_number", None if months is None else list(months)).agg(F.max("retention_pct"))
    if months is None:
        months = sorted((c for c in wide.columns if c != "cohort_month"), key=int)
    return wide.select(
        "cohort_month", *[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(f"m{m}") for m in months]
    ).orderBy("cohort_month")


def cohort_month(retention: DataFrame, cohort: str, month_number: int = 1) -> DataFrame:
    """Retention of one cohort in one month; 0 if absent."""
    cell = (F.col("cohort_month") == F.lit(cohort).cast("date")) & (F.col("month_number") == month_number)
    return retention.where(cell).agg(F.coalesce(F.max("retention_pct"), F.lit(0.0)).alias("retention_pct"))


def repeat_summary(journey: DataFrame, horizons: Sequence[int] = (7, 30)) -> DataFrame:
    """Repeat customers and revenue, time to the second purchase, and repeats within each horizon, in one aggregate.

    Only customers observed for at least the horizon count towards it. The median keeps one entry per distinct number of
    days, which the calendar bounds.
    """
    repeat = F.col("is_repeat_customer") == 1
    days, observed = F.col("days_to_second_purchase"), F.col("days_observed_since_first_purchase")
    revenue = cents("customer_revenue_proxy")
    customers, repeats = F.count(F.lit(1)), F.count_if(repeat)

    def within(h: int) -> list[Column]:
        eligible = F.count_if(observed >= h)
        repeated = F.count_if((observed >= h) & F.col("second_purchase_date").isNotNull() & (days <= h))
        return [
            eligible.alias(f"eligible_{h}d"),
            repeated.alias(f"repeated_{h}d"),
            pct(repeated, eligible).alias(f"repeat_within_{h}d_pct"),
        ]

    return journey.agg(
        customers.alias("total_customers"),
        repeats.alias("repeat_customers"),
        pct(repeats, customers).alias("repeat_customer_share_pct"),
        money(F.sum(F.when(repeat, revenue))).alias("repeat_revenue_proxy"),
        pct(F.sum(F.when(repeat, revenue)), F.sum(revenue)).alias("repeat_revenue_share_pct"),
        mean2(F.sum(days), F.count(days)).alias("avg_days_to_second_purchase"),
        quantile2(F.median(days)).alias("median_days_to_second_purchase"),
        *[c for h in horizons for c in within(h)],
    )


def monthly_repeat_mix(sessions: DataFrame) -> DataFrame:
    """Sessions and revenue per month, of repeat and of one-time customers.

    Whether a user repeats follows from their months alone, so sessions are not joined with the journey.
    """
    total = F.sum("n").over(Window.partitionBy("user_id"))
    kind = F.when(total > 1, "Repeat customers").otherwise("One-time customers")
    return (
        _user_months(sessions)
        .select("month_date", kind.alias("customer_type"), "n", "c")
        .groupBy("month_date", "customer_type")
        .agg(F.sum("n").alias("purchase_sessions"), money(F.sum("c")).alias("revenue_proxy"))
        .orderBy("month_date", "customer_type")
    )


def days_to_second_hist(journey: DataFrame, bins: int = 30, limit: int = 60) -> DataFrame:
    """Histogram of days to the second purchase, up to a limit."""
    days = journey.where(F.col("days_to_second_purchase") <= limit)
    return histogram(
        materialise(value_counts(days, "days_to_second_purchase"), "day-counts"), "days_to_second_purchase", bins
    )
