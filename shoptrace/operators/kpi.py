"""Headline figures of the analyses as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fact(df: DataFrame, column: str, metric: str) -> DataFrame:
    """One row (metric, value); NULL when ``df`` has no row."""
    return df.agg(F.max(F.col(column).cast("double")).alias("value")).select(F.lit(metric).alias("metric"), "value")


def kpi_facts(
    opportunity: DataFrame,
    mix: DataFrame,
    conversion: DataFrame,
    segments: DataFrame,
    repeats: DataFrame,
    carts: DataFrame,
    focus: str = "electronics.smartphone",
    horizon: int = 30,
) -> DataFrame:
    """Size and revenue of the quadrant to fix, share and uplift of the focus category, segment shares, repeat and cart rates.

    Inputs are result tables of the other operators (a few rows each).
    """
    fix = opportunity.where(F.col("segment") == "High Traffic / Low Conversion")
    focus_row = mix.where(F.col("category_code") == focus)
    segment = lambda name: segments.where(F.col("segment") == name)
    facts = [
        _fact(fix, "categories", "fix_quadrant_categories"),
        _fact(fix, "total_revenue", "fix_quadrant_revenue"),
        _fact(focus_row, "revenue_share_pct", "focus_category_revenue_share_pct"),
        _fact(conversion, "uplift_pct", "focus_category_conversion_uplift_pct"),
        _fact(segment("Cannot Lose Them"), "revenue_share_pct", "cannot_lose_them_revenue_share_pct"),
        _fact(segment("Potential Loyalists"), "customer_share_pct", "potential_loyalists_customer_share_pct"),
        _fact(segment("Potential Loyalists"), "revenue_share_pct", "potential_loyalists_revenue_share_pct"),
        _fact(repeats, f"repeat_within_{horizon}d_pct", f"repeat_within_{horizon}d_pct"),
        _fact(carts, "cart_abandonment_rate_pct", "cart_abandonment_rate_pct"),
    ]
    return reduce(DataFrame.unionByName, facts)
