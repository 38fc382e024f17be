"""Quantiles from mergeable sketches, where a bounded error in rank is good enough.

A sketch (KLL) per group is made in the one scan of the log, some 4 bytes times ``k`` per level of size, stored as binary, and merged with
others of the same column: months to a year, files to a log. Quantiles are values that occur (not interpolated). With fewer than
``k`` values in a group they are exact; else a quantile's rank is off by less than ``rank_error(k)`` in 99 of 100 cases. Which values a
sketch keeps is random, so two runs may differ within that error. The exact path (``ordering.quantile``) stays the default everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptrace.functions.rules import cents, mean_money, money

K = 2048


def rank_error(k: int = K) -> float:
    """Twice the published single-sided error of a KLL sketch: 2.296 / k ** 0.9021, at 99%."""
    return 2 * 2.296 / k**0.9021


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str | Column] = (), k: int = K) -> DataFrame:
    """Per group: ``n`` values that are not NULL and their ``sketch``. Groups without values have none."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """Sketches of smaller groups as those of larger ones."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return merged.where("n > 0")


def sketch_quantile(q: float, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))


def approx_revenue_distribution(purchases: DataFrame, k: int = K) -> DataFrame:
    """``revenue.revenue_distribution`` in a single aggregate, its three quantiles from a sketch. One row."""
    total = F.sum(cents("price"))
    summed = purchases.agg(
        F.count(F.lit(1)).alias("purchase_rows"),
        total.alias("c"),
        F.max(cents("price")).alias("most"),
        F.kll_sketch_agg_double(F.col("price").cast("double"), F.lit(k)).alias("sketch"),
    )
    found = {name: F.when(F.col("purchase_rows") > 0, sketch_quantile(q)) for name, q in (("median", 0.5), ("p90", 0.9), ("p99", 0.99))}
    return summed.select(
        "purchase_rows",
        money("c").alias("total_revenue_proxy"),
        mean_money("c", "purchase_rows").alias("avg_purchase_price"),
        *[x.alias(f"{name}_purchase_price") for name, x in found.items()],
        money("most").alias("max_purchase_price"),
    )


def approx_boxes(purchases: DataFrame, group: str, value: str = "price", k: int = K) -> DataFrame:
    """Rows, quartiles and the p95 of each group, from one scan; the sketches of the groups are not needed again."""
    shape = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    sketches = quantile_sketches(purchases, value, [group], k)
    return sketches.select(group, F.col("n").alias("n_rows"), *[sketch_quantile(q).alias(name) for name, q in shape.items()])
