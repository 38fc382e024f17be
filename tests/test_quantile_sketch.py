from __future__ import annotations

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from shoptrace.operators import quantile_sketch as qs
from shoptrace.operators.revenue import revenue_distribution
from shoptrace.sources.tables import materialise


@pytest.fixture(scope="module")
def prices(spark):
    rng = random.Random(12)
    # a third of the rows have one price; the rest has a long tail
    values = [99.99 if i % 3 == 0 else round(rng.paretovariate(1.2) * 3, 2) for i in range(60_000)]
    rows = [(f"m{i % 7}", v) for i, v in enumerate(values)]
    return materialise(spark.createDataFrame(rows, "month string, price double").repartition(6)), sorted(values)


def off(ordered, found, q):
    """By how much of all ranks ``found`` misses the quantile."""
    n = len(ordered)
    return max(0.0, bisect_left(ordered, found) / n - q, q - bisect_right(ordered, found) / n)


@pytest.mark.parametrize("k", [128, qs.K])
def test_rank_error_of_whole_and_of_merged_sketches(spark, prices, k):
    df, ordered = prices
    shares = (0.01, 0.25, 0.5, 0.9, 0.99)
    monthly = materialise(qs.quantile_sketches(df, "price", ["month"], k))
    for sketches in (qs.quantile_sketches(df, "price", (), k), qs.merged_sketches(monthly, (), k)):
        row = sketches.select("n", *[qs.sketch_quantile(q).alias(str(q)) for q in shares]).first()
        assert row["n"] == len(ordered)
        assert max(off(ordered, row[str(q)], q) for q in shares) < 2 * qs.rank_error(k)
    assert max(len(r["sketch"]) for r in monthly.collect()) < 64 * k + 1024


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(100)] + [(3, None)], "g int, v double")
    got = {r["g"]: (r["n"], r["m"]) for r in qs.quantile_sketches(df, "v", ["g"]).select("g", "n", qs.sketch_quantile(0.5).alias("m")).collect()}
    assert got == {0: (50, 48.0), 1: (50, 49.0)}
    assert qs.merged_sketches(qs.quantile_sketches(df.where("false"), "v", ["g"])).count() == 0


def test_approximate_distribution_is_near_the_exact_one(prices):
    df, ordered = prices
    exact, near = revenue_distribution(df).first(), qs.approx_revenue_distribution(df).first()
    assert list(near.asDict()) == list(exact.asDict())
    for name in ("purchase_rows", "total_revenue_proxy", "avg_purchase_price", "max_purchase_price"):
        assert near[name] == exact[name]
    for name, q in (("median", 0.5), ("p90", 0.9), ("p99", 0.99)):
        assert off(ordered, near[f"{name}_purchase_price"], q) < 2 * qs.rank_error()
    none = qs.approx_revenue_distribution(df.where("false")).first()
    assert none["purchase_rows"] == 0 and none["median_purchase_price"] is None
