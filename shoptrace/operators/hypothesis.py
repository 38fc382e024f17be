"""Rank-sum and two-proportion tests, conversion comparison and box statistics, from grouped counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptrace.functions.normal import two_sided_p
from shoptrace.functions.rules import UNKNOWN, cents, pct, ratio, round2, six_places
from shoptrace.operators.ordering import quantile, value_counts, with_cumulative
from shoptrace.operators.sampling import sample_n
from shoptrace.sources.tables import materialise


def uplift(a: Column, b: Column, base: str) -> Column:
    """Percent change towards the other group, with group ``base`` ('a' or 'b') as the basis."""
    if base not in ("a", "b"):
        raise ValueError("base is 'a' or 'b'")
    start, end = (a, b) if base == "a" else (b, a)
    return round2(ratio(end - start, start) * 100.0)


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


@dataclass(frozen=True)
class RankTest:
    """Rows of two groups whose values are compared; ``base`` is the group that the uplift is a share of."""

    a: Column
    b: Column
    base: str = "a"


def rank_tests(df: DataFrame, value: str, tests: Mapping[str, RankTest]) -> DataFrame:
    """Two-sided Mann-Whitney U per test: U of a, z with tie and continuity correction, p, medians, uplift. One row per test.

    The log is read once into one row per distinct value, with a count per group of every test. U of a is the sum over values of
    a * (b below + b here / 2), so ranks never need a sort of the rows. Counts are multiplied in decimals and stay exact.
    z and p are NULL when all values are equal or a group is empty.
    """
    groups = {f"{name}_{g}": c for name, t in tests.items() for g, c in (("a", t.a), ("b", t.b))}
    counts = materialise(
        df.where(reduce(Column.__or__, groups.values()) & F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("v"))
        .agg(*[F.count_if(c).alias(g) for g, c in groups.items()]),
        "rank-counts",
    )
    sums = with_cumulative(counts, "v", list(groups)).agg(*[c for name in tests for c in _rank_sums(name)])
    rows = sums.select(F.inline(F.array(*[_rank_row(name, t.base) for name, t in tests.items()])))
    return rows.withColumn("p_value", F.when(F.col("z") < 0, 1.0).otherwise(two_sided_p(F.col("z"))))


def _rank_sums(name: str) -> list[Column]:
    a, b = f"{name}_a", f"{name}_b"
    here_a, here_b = _exact(F.col(a)), _exact(F.col(b))
    tied = _exact(here_a + here_b)
    return [
        F.coalesce(F.sum(a), F.lit(0)).alias(a),
        F.coalesce(F.sum(b), F.lit(0)).alias(b),
        F.sum(_exact(here_a * _exact(_exact(F.col(f"{b}_before")) * 2 + here_b))).alias(f"{name}_twice_u"),
        F.sum(_exact(_exact(_exact(tied * tied) * tied) - tied)).alias(f"{name}_ties"),
        six_places(quantile(0.5, "v", a)).alias(f"{name}_median_a"),
        six_places(quantile(0.5, "v", b)).alias(f"{name}_median_b"),
    ]


def _rank_row(name: str, base: str) -> Column:
    n_a, n_b = F.col(f"{name}_a").cast("double"), F.col(f"{name}_b").cast("double")
    n = n_a + n_b
    u_a = F.col(f"{name}_twice_u").cast("double") / F.lit(2.0)
    mean = n_a * n_b / F.lit(2.0)
    tie_part = F.col(f"{name}_ties").cast("double") / F.nullif(n * (n - 1.0), F.lit(0.0))
    variance = n_a * n_b / F.lit(12.0) * (n + 1.0 - tie_part)
    z = (F.greatest(u_a, n_a * n_b - u_a) - mean - 0.5) / F.nullif(F.sqrt(variance), F.lit(0.0))
    low, high = F.col(f"{name}_median_a"), F.col(f"{name}_median_b")
    return F.struct(
        F.lit(name).alias("name"), F.col(f"{name}_a").alias("n_a"), F.col(f"{name}_b").alias("n_b"), low.alias("median_a"),
        high.alias("median_b"), uplift(low, high, base).alias("uplift_pct"), u_a.alias("statistic"), z.alias("z"),
    )


def mann_whitney(df: DataFrame, value: str, group: str, a, b, base: str = "a") -> DataFrame:
    """One ``rank_tests`` row: group ``a`` of a column against group ``b``."""
    return rank_tests(df, value, {"test": RankTest(F.col(group) == a, F.col(group) == b, base)}).drop("name")


def _months(month_a: str, month_b: str) -> RankTest:
    first, second = date.fromisoformat(month_a), date.fromisoformat(month_b)
    return RankTest(F.col("month_date") == first, F.col("month_date") == second, "a")


def _brands(brand_a: str, brand_b: str) -> RankTest:
    return RankTest(F.col("brand") == brand_a, F.col("brand") == brand_b, "b")


def mann_whitney_months(purchases: DataFrame, month_a: str = "2019-10-01", month_b: str = "2019-11-01") -> DataFrame:
    """Prices of two months; uplift of the second against the first."""
    return rank_tests(purchases, "price", {"month": _months(month_a, month_b)}).drop("name")


def mann_whitney_brands(purchases: DataFrame, brand_a: str = "apple", brand_b: str = "samsung") -> DataFrame:
    """Prices of two brands; uplift of the first against the second."""
    return rank_tests(purchases, "price", {"brand": _brands(brand_a, brand_b)}).drop("name")


def prop_ztest(df: DataFrame, success: str, trial: str, cond_a: Column, cond_b: Column) -> DataFrame:
    """Pooled two-proportion z-test from one conditional aggregate. Uplift is a against b. One row."""
    totals = df.agg(
        F.sum(F.when(cond_a, F.col(success))).alias("success_a"),
        F.sum(F.when(cond_a, F.col(trial))).alias("trials_a"),
        F.sum(F.when(cond_b, F.col(success))).alias("success_b"),
        F.sum(F.when(cond_b, F.col(trial))).alias("trials_b"),
    )
    s_a, t_a, s_b, t_b = (F.col(c).cast("double") for c in totals.columns)
    p_a, p_b = ratio(s_a, t_a), ratio(s_b, t_b)
    pooled = ratio(s_a + s_b, t_a + t_b)
    spread = F.sqrt(pooled * (1.0 - pooled) * (ratio(F.lit(1.0), t_a) + ratio(F.lit(1.0), t_b)))
    return totals.select(
        *totals.columns,
        pct(s_a, t_a).alias("conversion_a_pct"),
        pct(s_b, t_b).alias("conversion_b_pct"),
        round2((ratio(p_a, p_b) - 1.0) * 100.0).alias("uplift_pct"),
        ((p_a - p_b) / F.nullif(spread, F.lit(0.0))).alias("statistic"),
    ).withColumn("p_value", two_sided_p(F.col("statistic")))


def focus_and_rest(focus: str) -> tuple[Column, Column]:
    """Conditions for one category and for all other known ones."""
    category = F.col("category_code")
    return category == focus, (category != focus) & (category != UNKNOWN)


def conversion_ztest(funnel: DataFrame, focus: str = "electronics.smartphone") -> DataFrame:
    """Does the focus category convert views to purchases better than the rest of the known catalogue?"""
    return prop_ztest(funnel, "reached_purchase", "reached_view", *focus_and_rest(focus))


def conversion_comparison(funnel: DataFrame, focus: str = "electronics.smartphone") -> DataFrame:
    """Conversion of the focus category and of the rest, one row each, from one scan."""
    test = conversion_ztest(funnel, focus)
    rows = F.array(
        F.struct(F.lit(focus).alias("group_name"), F.col("conversion_a_pct").alias("conversion_pct")),
        F.struct(F.lit("rest_of_catalog").alias("group_name"), F.col("conversion_b_pct").alias("conversion_pct")),
    )
    return test.select(F.inline(rows))


def stat_tests_summary(
    purchases: DataFrame,
    funnel: DataFrame,
    month_a: str = "2019-10-01",
    month_b: str = "2019-11-01",
    brand_a: str = "apple",
    brand_b: str = "samsung",
    focus: str = "electronics.smartphone",
) -> DataFrame:
    """The three tests as one table: prices of two months, conversion of a category, prices of two brands.

    Both price tests come from the same pass over the purchases and the same cumulative counts.
    """
    ranks = rank_tests(purchases, "price", {"month": _months(month_a, month_b), "brand": _brands(brand_a, brand_b)})
    of_month = F.col("name") == "month"

    def either(month: str, brand: str) -> Column:
        return F.when(of_month, month).otherwise(brand)

    prices = ranks.select(
        F.concat(F.lit("purchase price by "), "name").alias("hypothesis"),
        either(month_a, brand_a).alias("group_a"), either(month_b, brand_b).alias("group_b"),
        F.col("median_a").alias("metric_a"), F.col("median_b").alias("metric_b"),
        "uplift_pct", F.lit("Mann-Whitney U").alias("test"), "statistic", "p_value",
    )
    conversion = conversion_ztest(funnel, focus).select(
        F.lit("conversion against the rest of the catalog").alias("hypothesis"),
        F.lit(focus).alias("group_a"), F.lit("rest_of_catalog").alias("group_b"),
        F.col("conversion_a_pct").alias("metric_a"), F.col("conversion_b_pct").alias("metric_b"),
        "uplift_pct", F.lit("Two-proportion z-test").alias("test"), "statistic", "p_value",
    )
    return prices.unionByName(conversion)


def box_statistics(df: DataFrame, value: str, group: str, axis_q: float = 0.95) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and the common axis limit (a quantile over all groups), per group.

    The log is read once into one row per (group, value); grouping sets over those rows add the rows of all groups together, and one run of
    cumulative counts serves the quartiles of both. Works on all rows; pass a sample to mimic a plotted sample.
    """
    each = value_counts(df.where(F.col(group).isNotNull()), value, [group])
    both = each.groupingSets([[F.col(group), F.col(value)], [F.col(value)]], group, value).agg(
        F.grouping(group).cast("int").alias("_all"), F.sum("n").alias("n")
    )
    # the rows of all groups have a name of their own, since cumulative counts run over named groups
    name = F.when(F.col("_all") == 1, "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("_name")
    counts = materialise(both.select(name, F.col(group).alias("_of"), value, "n"), "box-counts")
    boxes = materialise(
        with_cumulative(counts, value, ["n"], ["_name"]).groupBy("_name").agg(
            F.sum("n").alias("n_rows"),
            six_places(quantile(0.25, value)).alias("q1"),
            six_places(quantile(0.50, value)).alias("median"),
            six_places(quantile(0.75, value)).alias("q3"),
            six_places(quantile(axis_q, value)).alias("axis_limit"),
        ),
        "boxes",
    )
    axis = boxes.where("_name = ''").agg(F.max("axis_limit")).scalar()
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col(value)
    shape = ["n_rows", "q1", "median", "q3"]
    whiskers = (
        counts.where("_name <> ''").join(boxes.select("_name", *shape), "_name")
        .groupBy(F.col("_of").alias(group), *shape)
        .agg(
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
        )
    )
    return whiskers.withColumn("axis_limit", axis).orderBy(group)


def _sampled(df: DataFrame, value: str, group: str, sample: int | None) -> DataFrame:
    """Of a sample rows are drawn by (group, value), which is all that a box needs."""
    return df if sample is None else sample_n(df.select(group, value), sample, 0, F.concat_ws("|", group, cents(value)))


def price_box_by_month(purchases: DataFrame, sample: int | None = None) -> DataFrame:
    """``sample``: over so many rows drawn from all purchases, as for a plot; else over all rows."""
    return box_statistics(_sampled(purchases, "price", "month_date", sample), "price", "month_date")


def price_box_by_brand(
    purchases: DataFrame, brands: Sequence[str] = ("apple", "samsung", "xiaomi"), sample: int | None = None
) -> DataFrame:
    """``sample``: over so many rows drawn from the purchases of these brands."""
    chosen = purchases.where(F.col("brand").isin(*brands))
    return box_statistics(_sampled(chosen, "price", "brand", sample), "price", "brand")
