"""Recency, frequency and monetary scores, and the segments they make."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrace.functions.rules import cents, days_between, mean2, mean_money, money, pct
from shoptrace.operators.ordering import first_rows, with_ntiles
from shoptrace.sources.tables import materialise

SCORES = 5

# Segment rules, first match wins. (name, recency, frequency, monetary) as inclusive score ranges.
SEGMENT_RULES = (
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal Customers", (3, 5), (4, 5), (3, 5)),
    ("Potential Loyalists", (4, 5), (2, 3), (1, 5)),
    ("New Customers", (5, 5), (1, 1), (1, 5)),
    ("Cannot Lose Them", (1, 2), (4, 5), (4, 5)),
    ("At Risk", (1, 2), (3, 5), (1, 5)),
    ("Hibernating", (1, 2), (1, 2), (1, 5)),
    ("Need Attention", (3, 3), (1, 2), (1, 5)),
)
OTHER_SEGMENT = "Regular Customers"

# The segments drawn on the segment map.
FOCUS_SEGMENTS = (
    "Champions",
    "Loyal Customers",
    "Potential Loyalists",
    "At Risk",
    "Cannot Lose Them",
    "Hibernating",
)


def rfm_base(purchases: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Frequency, spend and recency per user, over a written per-user table.

    Recency counts to the day after the last purchase of anyone (or after ``as_of``), so the least is 1.
    """
    total = F.sum(cents("price"))
    users = purchases.groupBy("user_id").agg(
        F.count_distinct("user_session").alias("frequency_orders_proxy"),
        F.count(F.lit(1)).alias("purchase_events"),
        money(total).alias("monetary_value"),
        mean_money(total, F.count(F.lit(1))).alias("avg_purchase_price"),
        F.max("event_date").alias("last_purchase_date"),
    )
    return _with_recency(users, as_of)


def rfm_base_from_state(merged: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``rfm_base`` from ``prepare.merged_sessions``, without the log."""
    users = merged.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("frequency_orders_proxy"),
        F.sum("events").alias("purchase_events"),
        money(F.sum("cents")).alias("monetary_value"),
        mean_money(F.sum("cents"), F.sum("events")).alias("avg_purchase_price"),
        F.max("last_date").alias("last_purchase_date"),
    )
    return _with_recency(users, as_of)


def _with_recency(users: DataFrame, as_of: Column | None) -> DataFrame:
    users = materialise(users, "rfm-users")
    if as_of is None:
        as_of = users.agg(F.max("last_purchase_date").alias("d")).scalar()
    return users.withColumn("recency_days", days_between("last_purchase_date", F.date_add(as_of, 1)))


def rfm_scores(base: DataFrame, k: int = SCORES) -> DataFrame:
    """NTILE(k) scores: late, frequent and high-spending users score high; ties broken by user id."""
    tiles = {
        "r_score": -F.col("recency_days"),
        "f_score": F.col("frequency_orders_proxy"),
        "m_score": F.col("monetary_value"),
    }
    return with_ntiles(base, tiles, "user_id", k)


def segment_of(rules: Sequence[tuple] = SEGMENT_RULES, other: str = OTHER_SEGMENT) -> Column:
    chain = None
    for name, *ranges in rules:
        match = F.lit(True)
        for score, (low, high) in zip(("r_score", "f_score", "m_score"), ranges):
            match = match & F.col(score).between(low, high)
        chain = F.when(match, name) if chain is None else chain.when(match, name)
    return chain.otherwise(other)


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Three-digit code and segment."""
    digits = [F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]
    return scores.withColumn("rfm_code", F.concat(*digits)).withColumn("segment", segment_of())


def rfm(purchases: DataFrame, k: int = SCORES) -> DataFrame:
    """The customer table: base, scores, code and segment."""
    return rfm_segments(rfm_scores(rfm_base(purchases), k))


def rfm_from_state(merged: DataFrame, k: int = SCORES) -> DataFrame:
    """The customer table from stored session states."""
    return rfm_segments(rfm_scores(rfm_base_from_state(merged), k))


def rfm_segment_summary(customers: DataFrame) -> DataFrame:
    """Customers, revenue, shares and averages per segment. The share windows see one row per segment."""
    grouped = customers.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(cents("monetary_value")).alias("c"),
        F.sum("recency_days").alias("days"),
        F.sum("frequency_orders_proxy").alias("orders"),
    )
    whole = Window.partitionBy()
    return grouped.select(
        "segment",
        "customers",
        pct("customers", F.sum("customers").over(whole)).alias("customer_share_pct"),
        money("c").alias("revenue_proxy"),
        pct("c", F.sum("c").over(whole)).alias("revenue_share_pct"),
        mean2("days", "customers").alias("avg_recency_days"),
        mean2("orders", "customers").alias("avg_frequency_orders"),
        mean_money("c", "customers").alias("avg_customer_value"),
    ).orderBy(F.desc("revenue_proxy"), "segment")


def rfm_score_grid(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy("r_score", "f_score")
        .agg(F.count(F.lit(1)).alias("customers"), money(F.sum(cents("monetary_value"))).alias("revenue_proxy"))
        .orderBy("r_score", "f_score")
    )


def rfm_heatmap(grid: DataFrame, k: int = SCORES) -> DataFrame:
    """Customers by recency score (rows) and frequency score (columns f1..fk), gaps 0."""
    columns = list(range(1, k + 1))
    wide = grid.groupBy("r_score").pivot("f_score", columns).agg(F.sum("customers"))
    return wide.select(
        "r_score", *[F.coalesce(F.col(f"`{f}`"), F.lit(0)).alias(f"f{f}") for f in columns]
    ).orderBy("r_score")


def rfm_focus_customers(
    customers: DataFrame, segments: Sequence[str] = FOCUS_SEGMENTS, k: int = 60_000
) -> DataFrame:
    """The k most valuable customers of the focus segments, as a distributed result."""
    focus = customers.where(F.col("segment").isin(*segments))
    return first_rows(focus, -F.col("monetary_value"), "user_id", k)
