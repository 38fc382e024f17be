from __future__ import annotations

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from shoptrace.operators import hypothesis


def brute_force(a, b):
    """U of a by comparing all pairs, and the tie- and continuity-corrected z and p."""
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    pooled = a + b
    n = len(pooled)
    ties = sum(c**3 - c for c in (pooled.count(v) for v in set(pooled)))
    sigma = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / sigma
    return u, z, min(1.0, math.erfc(z / math.sqrt(2)))


@pytest.mark.parametrize("seed", range(4))
def test_mann_whitney_matches_pairwise_count(spark, seed):
    rng = random.Random(seed)
    draw = (lambda: rng.choice([5.0, 5.0, 7.5])) if seed % 2 else (lambda: round(rng.uniform(1, 300), 2))
    a, b = [draw() for _ in range(70)], [draw() + seed for _ in range(50)]
    frame = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b] + [("c", 1.0)], "g string, v double")
    row = hypothesis.mann_whitney(frame, "v", "g", "a", "b").first()
    u, z, p = brute_force(a, b)
    assert row["statistic"] == u and (row["n_a"], row["n_b"]) == (70, 50)
    assert row["z"] == pytest.approx(z) and row["p_value"] == pytest.approx(p)
    other = hypothesis.mann_whitney(frame, "v", "g", "b", "a").first()
    assert row["statistic"] + other["statistic"] == 70 * 50


def test_degenerate_groups(spark):
    equal = spark.createDataFrame([("a", 2.0)] * 5 + [("b", 2.0)] * 4, "g string, v double")
    row = hypothesis.mann_whitney(equal, "v", "g", "a", "b").first()
    assert row["statistic"] == 10.0 and row["z"] is None and row["p_value"] is None and row["uplift_pct"] == 0.0
    alone = spark.createDataFrame([("a", 2.0)] * 3, "g string, v double")
    row = hypothesis.mann_whitney(alone, "v", "g", "a", "b").first()
    assert row["n_b"] == 0 and row["z"] is None and row["median_b"] is None


def test_uplift_direction(spark):
    rows = spark.createDataFrame([("a", 100.0), ("b", 150.0)], "g string, v double")
    assert hypothesis.mann_whitney(rows, "v", "g", "a", "b", base="a").first()["uplift_pct"] == 50.0
    assert hypothesis.mann_whitney(rows, "v", "g", "a", "b", base="b").first()["uplift_pct"] == -33.33
    with pytest.raises(ValueError):
        hypothesis.mann_whitney(rows, "v", "g", "a", "b", base="x")


def funnel(spark):
    rows = [("phone", 1, 1)] * 30 + [("phone", 1, 0)] * 170 + [("tv", 1, 1)] * 20 + [("tv", 1, 0)] * 380 + [("Unknown", 1, 1)] * 50
    return spark.createDataFrame(rows, "category_code string, reached_view int, reached_purchase int")


def test_proportions(spark):
    row = hypothesis.conversion_ztest(funnel(spark), "phone").first()
    p, q, pooled = 30 / 200, 20 / 400, 50 / 600
    z = (p - q) / math.sqrt(pooled * (1 - pooled) * (1 / 200 + 1 / 400))
    assert row["statistic"] == pytest.approx(z)
    assert row["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert (row["conversion_a_pct"], row["conversion_b_pct"], row["uplift_pct"]) == (15.0, 5.0, 200.0)
    compared = {r["group_name"]: r["conversion_pct"] for r in hypothesis.conversion_comparison(funnel(spark), "phone").collect()}
    assert compared == {"phone": 15.0, "rest_of_catalog": 5.0}


def test_proportions_without_trials(spark):
    row = hypothesis.conversion_ztest(funnel(spark).where(F.lit(False)), "phone").first()
    assert row["statistic"] is None and row["conversion_a_pct"] is None


def test_boxes(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    rows = spark.createDataFrame([("x", v) for v in values] + [("y", 5.0)], "g string, v double")
    x, y = hypothesis.box_statistics(rows, "v", "g").orderBy("g").collect()
    assert (x["q1"], x["median"], x["q3"]) == (3.0, 5.0, 7.0)
    assert (x["whisker_low"], x["whisker_high"], x["n_rows"]) == (1.0, 8.0, 9)
    assert (y["q1"], y["whisker_low"], y["whisker_high"]) == (5.0, 5.0, 5.0)
    assert x["axis_limit"] == y["axis_limit"] == pytest.approx(8.0 + 0.55 * 92.0)


def test_months_are_dates(spark):
    rows = [(date(2019, 10, 1), 10.0), (date(2019, 11, 1), 5.0), (date(2019, 12, 1), 1.0)]
    buys = spark.createDataFrame(rows, "month_date date, price double")
    assert hypothesis.mann_whitney_months(buys).first()["uplift_pct"] == -50.0
