from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shoptrace.operators import audit, cart, funnel, hypothesis, prepare, retention, revenue, rfm, sampling
from shoptrace.plans.workbench import Settings, Workbench
from shoptrace.sources.tables import materialise

KINDS = ["view"] * 6 + ["cart"] * 3 + ["purchase"] * 3


def shop(make_raw, n=900, users=60, seed=1, hot=False):
    """A random two-month log; with ``hot`` a third of all rows belongs to one user, session, product, brand and price."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user, day = rng.randint(1, users), rng.randint(1, 61)
        stamp = f"2019-{10 if day <= 31 else 11}-{day if day <= 31 else day - 31:02d} 10:00:00 UTC"
        product = rng.randint(1, 12)
        row = (
            stamp, rng.choice(KINDS), str(product), ["electronics.smartphone", "tv", "", "shoes"][product % 4],
            ["apple", "samsung", "xiaomi", None][product % 4], f"{rng.randint(1, 120000) / 100:.2f}", str(user), f"{user}-{day}",
        )
        if hot and i % 3 == 0:
            row = ("2019-10-07 10:00:00 UTC", "purchase", "1", "tv", "apple", "99.99", "1", "1-7")
        rows.append((*row, "oct.csv" if day <= 31 else "nov.csv"))
    return materialise(make_raw(rows), "shop")


SMALL = Settings(min_views=1, min_pairs=1, horizons=(3, 20), sample_sessions=50, focus_customers=20)


@pytest.mark.parametrize("hot", [False, True])
def test_workbench_and_invariants(make_raw, hot):
    bench = Workbench(shop(make_raw, hot=hot), settings=SMALL)
    results = {name: df.toPandas() for name, df in {**bench.results(), **bench.headline()}.items()}
    assert len(results) == 24 + 7

    total = results["revenue_distribution_summary"].loc[0, "total_revenue_proxy"]
    for name in ("monthly_trend", "daily_trend", "category_mix_summary", "rfm_segment_summary", "retention_monthly_mix"):
        assert results[name]["revenue_proxy"].sum() == pytest.approx(total), name
    assert results["category_mix_summary"]["revenue_share_pct"].sum() == pytest.approx(100, abs=0.05)
    assert results["rfm_segment_summary"]["customer_share_pct"].sum() == pytest.approx(100, abs=0.05)

    customers = results["rfm_customer_segments"]
    for score in ("r_score", "f_score", "m_score"):
        sizes = customers.groupby(score).size()
        assert sizes.max() - sizes.min() <= 1 and len(sizes) == 5
    assert customers["recency_days"].min() == 1
    assert results["rfm_score_grid"]["customers"].sum() == len(customers)

    cohorts = results["cohort_retention_matrix"]
    assert (cohorts.loc[cohorts.month_number == 0, "retention_pct"] == 100).all()
    overview = results["cart_abandonment_overview"].loc[0]
    for name in ("cart_abandonment_monthly", "cart_abandonment_by_category", "cart_abandonment_by_price_band"):
        assert results[name]["cart_session_products"].sum() == overview["cart_session_products"]
    assert results["retention_repeat_summary"].loc[0, "total_customers"] == len(customers)
    assert len(results["kpi_facts"]) == 9

    charts = {name: df.toPandas() for name, df in bench.chart_data().items()}
    assert charts["price_histogram"]["n"].sum() == results["revenue_distribution_summary"].loc[0, "purchase_rows"]
    assert charts["session_revenue_histogram"]["n"].sum() == 50
    assert len(charts["rfm_focus_customers"]) == 20
    assert {name: len(df.toPandas()) for name, df in bench.audit().items()}["audit_overview"] == 2


def test_results_do_not_depend_on_layout(make_raw):
    raw = shop(make_raw, hot=True)
    one, other = Workbench(raw.coalesce(1), settings=SMALL), Workbench(raw.repartition(9), settings=SMALL)
    reports = [
        lambda b: funnel.category_mix(b.funnel),
        lambda b: b.customers,
        lambda b: retention.repeat_summary(b.journey, (3, 20)),
        lambda b: hypothesis.mann_whitney_months(b.purchases),
    ]
    for report in reports:
        assert sorted(map(str, report(one).collect())) == sorted(map(str, report(other).collect()))


def test_results_are_written(spark, make_raw, tmp_path):
    Workbench(shop(make_raw, 200), settings=SMALL).write_results(str(tmp_path), "csv")
    written = sorted(p.name for p in tmp_path.iterdir())
    assert len(written) == 24
    header = spark.read.option("header", True).csv(str(tmp_path / "monthly_trend"))
    assert header.columns == ["month_date", "purchase_events", "purchasing_users", "revenue_proxy", "avg_purchase_price"]


def test_workbench_from_a_stored_log(make_raw):
    bench = Workbench(typed=prepare.clean_events(shop(make_raw, 100)), settings=SMALL)
    assert revenue.monthly_trend(bench.purchases).count() == 2
    with pytest.raises(ValueError):
        bench.audit()
    with pytest.raises(ValueError):
        Workbench()


def test_every_report_accepts_an_empty_log(make_raw):
    raw = shop(make_raw, 5).where(F.lit(False))
    bench = Workbench(raw, settings=SMALL)
    for tables in (bench.results(), bench.chart_data(), bench.headline(), bench.audit()):
        for table in tables.values():
            table.collect()
    assert revenue.revenue_distribution(bench.purchases).first()["purchase_rows"] == 0
    assert cart.cart_overview(bench.cart_pairs).first()["cart_session_products"] == 0
    assert audit.kmv_distinct(raw, "user_id").first()["distinct_estimate"] == 0
    assert sampling.sample_n(raw, 5).count() == 0


def test_growth_and_combined_share(spark):
    trend = spark.createDataFrame([(date(2019, 10, 1), 200.0), (date(2019, 11, 1), 250.5)], "month_date date, revenue_proxy double")
    assert [r["growth_pct"] for r in revenue.monthly_growth(trend).orderBy("month_date").collect()] == [None, 25.25]
    mix = spark.createDataFrame(
        [("a", 5.0, 50.5), ("b", 3.0, 30.25), ("Unknown", 9.0, 15.0), ("c", 1.0, 4.25)],
        "brand string, revenue_proxy double, revenue_share_pct double",
    )
    assert funnel.combined_share(mix, "brand").first()["combined_share_pct"] == 80.75


def test_opportunity_quadrants(spark):
    rows = [("a", 100, 5, 9.0, 5.0), ("b", 100, 1, 9.0, 1.0), ("c", 10, 1, 8.0, 9.0), ("d", 10, 0, 7.0, 0.0),
            ("median", 55, 1, 1.0, 3.0), ("Unknown", 999, 9, 1.0, 9.0), ("small", 1, 0, 0.0, 99.0), ("none", 50, 0, 1.0, None)]
    table = spark.createDataFrame(
        rows, "category_code string, view_interactions long, purchase_interactions long, revenue_proxy double, purchase_to_view_pct double"
    )
    got = {r["category_code"]: r["segment"] for r in funnel.opportunity_matrix(table, 5).collect()}
    assert got == {
        "a": "High Traffic / High Conversion", "b": "High Traffic / Low Conversion", "c": "Low Traffic / High Conversion",
        "d": "Low Traffic / Low Conversion", "median": "High Traffic / High Conversion", "none": "Other",
    }
    assert [r["category_code"] for r in funnel.opportunity_labels(funnel.opportunity_matrix(table, 5), 2).collect()] == ["a", "b"]


def test_segments_by_precedence(spark):
    grid = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    frame = spark.createDataFrame(grid, "r_score int, f_score int, m_score int")
    got = {(r["r_score"], r["f_score"], r["m_score"]): r["segment"] for r in rfm.rfm_segments(frame).collect()}
    assert got[(5, 5, 5)] == "Champions" and got[(3, 4, 3)] == "Loyal Customers" and got[(4, 2, 1)] == "Potential Loyalists"
    assert got[(5, 1, 5)] == "New Customers" and got[(2, 4, 4)] == "Cannot Lose Them" and got[(1, 4, 3)] == "At Risk"
    assert got[(2, 2, 5)] == "Hibernating" and got[(3, 1, 1)] == "Need Attention"
    others = {k for k, v in got.items() if v == "Regular Customers"}
    assert others == {
        (r, f, m) for r, f, m in grid
        if (r >= 4 and f >= 4 and m <= 2) or (r == 4 and f == 1) or (r == 3 and f == 3) or (r == 3 and f >= 4 and m <= 2)
    }


def test_session_tables_of_one_busy_user(spark):
    buys = spark.range(5000).select(
        F.lit(1).cast("bigint").alias("user_id"),
        F.concat(F.lit("s"), F.col("id") % 900).alias("user_session"),
        F.date_add(F.lit("2019-10-01").cast("date"), ((F.col("id") % 900) % 60).cast("int")).alias("event_date"),
        F.lit(1.25).alias("price"),
    )
    sessions = materialise(prepare.purchase_sessions(buys))
    row = prepare.journey(sessions).first()
    assert (row["purchase_sessions"], row["days_to_second_purchase"], row["customer_revenue_proxy"]) == (900, 0, 6250.0)
    assert retention.monthly_repeat_mix(sessions).select(F.sum("purchase_sessions")).first()[0] == 900
    assert [r["active_customers"] for r in retention.cohort_activity(sessions).collect()] == [1, 1]


def test_cohort_cell_and_heatmap(spark):
    table = spark.createDataFrame(
        [(date(2019, 10, 1), 0, 100.0), (date(2019, 10, 1), 1, 26.3), (date(2019, 11, 1), 0, 100.0)],
        "cohort_month date, month_number long, retention_pct double",
    )
    assert retention.cohort_month(table, "2019-10-01").first()["retention_pct"] == 26.3
    assert retention.cohort_month(table, "2019-11-01").first()["retention_pct"] == 0.0
    heat = [tuple(r) for r in retention.cohort_heatmap(table).collect()]
    assert heat == [(date(2019, 10, 1), 100.0, 26.3), (date(2019, 11, 1), 100.0, 0.0)]


def test_unknown_is_left_out_of_cart_leaders(spark):
    table = spark.createDataFrame(
        [("Unknown", 90, 80), ("a", 50, 20), ("b", 40, 30), ("c", 2, 2)],
        "category_code string, cart_session_products long, abandoned_after_cart long",
    )
    assert [r["category_code"] for r in cart.cart_top_categories(table, 10, 5).collect()] == ["b", "a"]


def test_box_and_test_tables_have_stable_columns(make_raw):
    bench = Workbench(shop(make_raw, 300), settings=SMALL)
    assert hypothesis.stat_tests_summary(bench.purchases, bench.funnel).columns == [
        "hypothesis", "group_a", "group_b", "metric_a", "metric_b", "uplift_pct", "test", "statistic", "p_value",
    ]
    assert hypothesis.price_box_by_brand(bench.purchases).count() == 3


def test_kept_tables_are_read_again_and_own_tables_released(make_raw, tmp_path):
    raw = shop(make_raw, 200)
    nothing, folder = raw.where("false"), str(tmp_path / "kept")
    first = Workbench(raw, settings=SMALL, folder=folder)
    bought, profile = first.purchases.count(), first.audit()["audit_combined"].collect()
    assert {p.name for p in (tmp_path / "kept").iterdir()} == {"purchases", "audit-records", "audit-profile", "audit-top-prices"}
    # the second one is given an empty log: what it returns comes from the folder
    second = Workbench(nothing, settings=SMALL, folder=folder)
    assert second.purchases.count() == bought > 0 and second.audit()["audit_combined"].collect() == profile
    # a table whose writing did not end is written again
    (tmp_path / "kept" / "purchases" / "_SUCCESS").unlink()
    assert Workbench(nothing, settings=SMALL, folder=folder).purchases.count() == 0

    with Workbench(raw, settings=SMALL) as own:
        assert own.purchases.count() == bought
        (path,) = own._paths
    with pytest.raises(AnalysisException):
        raw.sparkSession.read.parquet(path)
    assert not own._paths and own.purchases.count() == bought  # computed anew when asked for again
