"""Funnel by category and month, revenue mix, and the category opportunity matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrace.functions.rules import UNKNOWN, cents, mean_money, money, pct, ratio
from shoptrace.operators.prepare import stage_reached

MIN_VIEWS = 10_000

# Quadrant labels by (traffic at or above its median, conversion at or above its median).
QUADRANTS = {
    (True, True): "High Traffic / High Conversion",
    (True, False): "High Traffic / Low Conversion",
    (False, True): "Low Traffic / High Conversion",
    (False, False): "Low Traffic / Low Conversion",
}


def _sold(column: str) -> Column:
    return F.when(F.col("reached_purchase") == 1, F.col(column))


def category_funnel(funnel: DataFrame) -> DataFrame:
    """Stage counts, conversions, buyers and revenue per category."""
    views, carts, buys = (F.sum(f"reached_{s}") for s in ("view", "cart", "purchase"))
    return (
        funnel.groupBy("category_code")
        .agg(
            views.alias("view_interactions"),
            carts.alias("cart_interactions"),
            buys.alias("purchase_interactions"),
            pct(carts, views).alias("cart_to_view_pct"),
            pct(buys, views).alias("purchase_to_view_pct"),
            pct(buys, carts).alias("purchase_to_cart_pct"),
            F.count_distinct(_sold("user_id")).alias("buyers"),
            money(F.sum(cents("revenue_proxy"))).alias("revenue_proxy"),
            mean_money(F.sum(cents(_sold("revenue_proxy"))), buys).alias("avg_purchase_value"),
        )
        .orderBy(F.desc("revenue_proxy"), "category_code")
    )


def revenue_mix(funnel: DataFrame, label: str) -> DataFrame:
    """Purchases, buyers, revenue and share of all revenue per label value (category or brand), Unknown included.

    The grand total is taken over the grouped rows, one per label.
    """
    revenue, sales = F.sum(cents("revenue_proxy")), F.count_if(F.col("reached_purchase") == 1)
    grouped = funnel.groupBy(label).agg(
        sales.alias("purchase_interactions"),
        F.count_distinct(_sold("user_id")).alias("buyers"),
        revenue.alias("_c"),
        F.coalesce(F.sum(cents(_sold("revenue_proxy"))), F.lit(0)).alias("_s"),
        mean_money(F.sum(cents(_sold("revenue_proxy"))), sales).alias("avg_purchase_value"),
    )
    total = F.sum("_s").over(Window.partitionBy())
    return grouped.select(
        label,
        "purchase_interactions",
        "buyers",
        money("_c").alias("revenue_proxy"),
        pct("_c", total).alias("revenue_share_pct"),
        "avg_purchase_value",
    ).orderBy(F.desc("revenue_proxy"), label)


def category_mix(funnel: DataFrame) -> DataFrame:
    return revenue_mix(funnel, "category_code")


def brand_mix(funnel: DataFrame) -> DataFrame:
    return revenue_mix(funnel, "brand")


def combined_share(mix: DataFrame, label: str, n: int = 2) -> DataFrame:
    """Revenue share of the n greatest known labels together (sum of their rounded shares)."""
    leaders = mix.where(F.col(label) != UNKNOWN).orderBy(F.desc("revenue_proxy"), label).limit(n)
    return leaders.agg(
        F.count(F.lit(1)).alias("labels"),
        money(F.sum(cents("revenue_proxy"))).alias("revenue_proxy"),
        money(F.sum(cents("revenue_share_pct"))).alias("combined_share_pct"),
    )


def category_monthly_funnel(events: DataFrame) -> DataFrame:
    """Stage counts per month and category; a pair active in two months counts in both."""
    pairs = events.groupBy("event_month", "user_session", "product_id", "category_code").agg(
        F.max(stage_reached()).alias("depth")
    )
    return _by_month(pairs)


def category_monthly_funnel_from_folds(folds: DataFrame) -> DataFrame:
    """The same from ``prepare.pair_months``; where these are stored bucketed by pair, only counts are shuffled."""
    return _by_month(folds.groupBy("event_month", "user_session", "product_id", "category_code").agg(F.max("depth").alias("depth")))


def _by_month(pairs: DataFrame) -> DataFrame:
    views, carts, buys = (F.count_if(F.col("depth") >= i) for i in (1, 2, 3))
    return (
        pairs.groupBy(F.col("event_month").alias("month_date"), "category_code")
        .agg(
            views.alias("view_interactions"),
            carts.alias("cart_interactions"),
            buys.alias("purchase_interactions"),
            pct(buys, views).alias("purchase_to_view_pct"),
        )
        .orderBy(F.asc_nulls_last("month_date"), F.desc("purchase_interactions"), "category_code")
    )


def _known_with_traffic(category_table: DataFrame, min_views: int) -> DataFrame:
    return category_table.where((F.col("category_code") != UNKNOWN) & (F.col("view_interactions") >= min_views))


def top_conversion_categories(category_table: DataFrame, min_views: int = MIN_VIEWS, k: int = 15) -> DataFrame:
    return (
        _known_with_traffic(category_table, min_views)
        .orderBy(F.desc_nulls_last("purchase_to_view_pct"), "category_code")
        .limit(k)
    )


def top_revenue(mix: DataFrame, label: str, k: int = 15) -> DataFrame:
    """Greatest known categories or brands by revenue."""
    return mix.where(F.col(label) != UNKNOWN).orderBy(F.desc("revenue_proxy"), label).limit(k)


def opportunity_cutoffs(category_table: DataFrame, min_views: int = MIN_VIEWS) -> DataFrame:
    """Median traffic and median conversion of known categories with enough views."""
    return _known_with_traffic(category_table, min_views).agg(
        F.median("view_interactions").alias("traffic_cut"),
        F.median("purchase_to_view_pct").alias("conversion_cut"),
    )


def opportunity_matrix(category_table: DataFrame, min_views: int = MIN_VIEWS) -> DataFrame:
    """Quadrant per category. ``category_table`` should be a written table: the cut-offs are a scalar read of it."""
    cuts = opportunity_cutoffs(category_table, min_views)
    cut = cuts.select(F.struct("traffic_cut", "conversion_cut").alias("cut")).scalar()
    busy = F.col("view_interactions") >= F.col("_cut.traffic_cut")
    converting = F.col("purchase_to_view_pct") >= F.col("_cut.conversion_cut")
    segment = F.when(busy.isNull() | converting.isNull(), "Other")
    for (traffic, conversion), name in QUADRANTS.items():
        segment = segment.when((busy == F.lit(traffic)) & (converting == F.lit(conversion)), name)
    return (
        _known_with_traffic(category_table, min_views)
        .withColumn("_cut", cut)
        .withColumn("segment", segment)
        .drop("_cut")
    )


def opportunity_summary(matrix: DataFrame) -> DataFrame:
    return (
        matrix.groupBy("segment")
        .agg(
            F.count("category_code").alias("categories"),
            F.sum("view_interactions").alias("total_views"),
            F.sum("purchase_interactions").alias("total_purchases"),
            money(F.sum(cents("revenue_proxy"))).alias("total_revenue"),
            (ratio(F.sum(cents("purchase_to_view_pct")), F.count("purchase_to_view_pct")) / F.lit(100.0)).alias(
                "avg_conversion_pct"
            ),
        )
        .orderBy(F.desc("total_revenue"), "segment")
    )


def opportunity_detailed(matrix: DataFrame) -> DataFrame:
    return matrix.orderBy("segment", F.desc("revenue_proxy"), "category_code")


def opportunity_top(matrix: DataFrame, k: int = 5) -> DataFrame:
    """The k categories with most revenue in each quadrant: what to fix, to scale, to defend."""
    best = Window.partitionBy("segment").orderBy(F.desc("revenue_proxy"), "category_code")
    return (
        matrix.withColumn("segment_rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("segment_rank") <= k)
        .orderBy("segment", "segment_rank")
    )


def opportunity_labels(matrix: DataFrame, k: int = 15) -> DataFrame:
    """The categories large enough to name on the chart."""
    return matrix.orderBy(F.desc("revenue_proxy"), "category_code").limit(k)
