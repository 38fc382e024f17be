"""One callable per operator: (spark, folder of the driver's tables) -> DataFrame.

A table that a query reads more than once is written first, as in production use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import raw_events, raw_purchases
from shoptrace.functions import rules
from shoptrace.operators import audit, audit_store, cart, funnel, hypothesis, kpi, prepare, quantile_sketch, retention, revenue, rfm, sampling
from shoptrace.sources import events as source
from shoptrace.sources.tables import materialise, new_path, written_bucketed

# Parameters of the fixture runs (defaults are the published ones).
MIN_VIEWS = 1
MIN_PAIRS = 1
TOP_PRODUCTS = 15
HIGH_PRICE = 200
KMV_SIZE = 256
SAMPLE_SIZE = 1000
STRATUM_SIZE = 100
FOCUS = "ECONOMY.16"
BRANDS = ("Brand#2", "Brand#4")
BOX_BRANDS = ("Brand#2", "Brand#4", "Brand#17")
MONTHS = ("1998-10-01", "1998-11-01")
COHORT = "1995-12-01"
HEATMAP_MONTHS = range(84)
FOLD_BUCKETS = 8
HORIZONS = (90, 365)
DAYS_LIMIT = 730

Query = Callable[[SparkSession, str], DataFrame]


def _typed_events(spark, d):
    return prepare.clean_events(raw_events(spark, d))


def _typed_purchases(spark, d):
    return prepare.clean_events(raw_purchases(spark, d))


def _buys(spark, d):
    return prepare.purchases(_typed_purchases(spark, d))


def _funnel_events(spark, d):
    return prepare.funnel_events(_typed_events(spark, d))


def _funnel(spark, d):
    return prepare.session_product_funnel(_funnel_events(spark, d))


def _stored_funnel(spark, d):
    return materialise(_funnel(spark, d), "funnel")


def _bucketed_folds(spark, d, typed=_typed_events):
    """(session, product, month) folds stored in buckets by pair."""
    folds = prepare.pair_months(prepare.funnel_events(typed(spark, d)))
    return written_bucketed(folds, "pair-months", prepare.PAIR, FOLD_BUCKETS)[0]


def _carts(spark, d):
    return prepare.cart_pairs(prepare.funnel_events(_typed_events(spark, d), require_ts=True))


def _month_carts(spark, d):
    return prepare.cart_pairs(prepare.funnel_events(_typed_purchases(spark, d), require_ts=True))


def _sessions(spark, d):
    return prepare.purchase_sessions(_buys(spark, d))


def _journey(spark, d):
    return prepare.journey(materialise(_sessions(spark, d), "sessions"))


def _category_table(spark, d):
    return materialise(funnel.category_funnel(_funnel(spark, d)), "category-funnel")


def _matrix(spark, d):
    return funnel.opportunity_matrix(_category_table(spark, d), MIN_VIEWS)


def _customers(spark, d):
    return rfm.rfm(_buys(spark, d))


def _stored_customers(spark, d):
    return materialise(_customers(spark, d), "customers")


def _retention(spark, d):
    activity = materialise(retention.cohort_activity(_sessions(spark, d)), "cohort-activity")
    # Everyone is active in the month of their first purchase, so cohort sizes are the cells of month 0.
    sizes = activity.where(F.col("month_number") == 0).select("cohort_month", F.col("active_customers").alias("cohort_size"))
    return retention.cohort_retention(activity, sizes)


def _read_back(spark, d):
    """Raw events through the CSV sink and source: two deliveries, read by column name."""
    log = raw_events(spark, d)
    paths = []
    for part in ("part_a", "part_b"):
        path = new_path(spark, f"csv-{part}")
        source.write_result(log.where(F.col("src") == part).drop("src"), path)
        paths.append(path)
    # the file's path depends on the run; the delivery in it does not
    return source.read_events(spark, paths).withColumn("src", F.regexp_extract("src", "csv-(part_[ab])", 1))


def _incremental_audit(spark, d):
    """Two deliveries as CSV: the first is audited and stored, then both, of which the store makes only the second be read."""
    paths = []
    for part in ("part_a", "part_b"):
        paths.append(new_path(spark, f"csv-{part}"))
        source.write_result(raw_events(spark, d).where(F.col("src") == part).drop("src").coalesce(1), paths[-1])
    store = new_path(spark, "audit-store")
    audit_store.refresh(spark, paths[:1], store, HIGH_PRICE)
    return audit_store.incremental_audit(spark, paths, store, HIGH_PRICE)


def _faulty(spark, d):
    """The raw log as text, with prices and users that are no numbers."""
    return raw_events(spark, d).selectExpr(
        "* EXCEPT (price, user_id, product_id, category_id)",
        "cast(product_id AS string) AS product_id",
        "cast(category_id AS string) AS category_id",
        "CASE WHEN product_id % 7 = 3 THEN 'n/a' WHEN product_id % 7 = 4 THEN ' ' ELSE cast(price AS string) END AS price",
        "CASE WHEN user_id % 11 = 5 THEN concat('u', user_id) ELSE concat(user_id, ' ') END AS user_id",
    )


def _rejected(spark, d):
    rejects = prepare.split_events(_faulty(spark, d))[1]
    return rejects.select("event_time", "product_id", "price", "user_id", "src", "reject_reason")


def _sound(spark, d):
    return prepare.split_events(_faulty(spark, d))[0]


def _folded_sessions(spark, d):
    """Session states stored per half-year, the first half-years written again, then merged; yearly sessions lie in two of them."""
    path = new_path(spark, "session-states")
    half = F.concat(F.year("event_date"), F.when(F.month("event_date") <= 6, "a").otherwise("b")).alias("part")
    states = prepare.session_state(_buys(spark, d), half)
    source.write_parts(states, path, "part")
    source.write_parts(states.where("part < '1994'"), path, "part")
    return prepare.merged_sessions(spark.read.parquet(path))


def _profile(spark, d):
    return audit.profile(audit.file_records(raw_events(spark, d), HIGH_PRICE))


def _retail_raw(spark, d):
    log = raw_events(spark, d)
    first = log.where(F.col("src") == "part_a").drop("category_id")
    return source.union_logs([first, log.where(F.col("src") == "part_b")])


def _written_trend(spark, d):
    path = new_path(spark, "trend")
    trend = revenue.monthly_trend(_buys(spark, d))
    source.write_result(trend, path, "parquet")
    return spark.read.schema(trend.schema).parquet(path)


def _has_column(spark, d):
    log = raw_events(spark, d)
    return log.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(source.has_column(log, "country")).alias("has_country"),
        F.lit(source.has_column(log, "brand")).alias("has_brand"),
    )


def _kpi(spark, d):
    stored = _stored_funnel(spark, d)
    table = materialise(funnel.category_funnel(stored), "category-funnel")
    return kpi.kpi_facts(
        opportunity=materialise(funnel.opportunity_summary(funnel.opportunity_matrix(table, MIN_VIEWS)), "opportunity"),
        mix=funnel.category_mix(stored),
        conversion=hypothesis.conversion_ztest(stored, FOCUS),
        segments=materialise(rfm.rfm_segment_summary(_stored_customers(spark, d)), "segments"),
        repeats=retention.repeat_summary(_journey(spark, d), HORIZONS),
        carts=cart.cart_overview(_carts(spark, d)),
        focus=FOCUS,
        horizon=HORIZONS[1],
    )


def _nine(*names: str):
    """Test scores to nine decimals, so that the last bits of ``exp`` do not matter in comparison."""
    return lambda df: df.select(
        *[F.col(c).cast("decimal(28,9)").cast("double").alias(c) if c in names else F.col(c) for c in df.columns]
    )



QUERIES: dict[str, Query] = {
    # sources and preparation
    "read_events": _read_back,
    "retail_raw": _retail_raw,
    "retail_typed": _typed_events,
    "purchase_clean": _buys,
    "retail_events": _funnel_events,
    "funnel_session_product": _funnel,
    "cart_session_product": _carts,
    "funnel_session_product_stored": lambda s, d: prepare.funnel_from_facts(prepare.facts_from_folds(_bucketed_folds(s, d))),
    "cart_session_product_stored": lambda s, d: prepare.cart_pairs_from_facts(prepare.facts_from_folds(_bucketed_folds(s, d))),
    "customer_purchase_sessions": _sessions,
    "customer_journey": _journey,
    "rfm_customer": _customers,
    "customer_sessions_folded": lambda s, d: prepare.sessions_from_state(_folded_sessions(s, d)),
    "customer_journey_folded": lambda s, d: prepare.journey(
        materialise(prepare.sessions_from_state(_folded_sessions(s, d)), "sessions")
    ),
    "rfm_customer_folded": lambda s, d: rfm.rfm_from_state(_folded_sessions(s, d)),
    "rejected_events": _rejected,
    "sound_events": _sound,
    "has_column": _has_column,
    "write_result": _written_trend,
    # audit
    "audit_overview": lambda s, d: audit.audit_overview(raw_events(s, d)),
    "audit_event_mix": lambda s, d: audit.audit_event_mix(raw_events(s, d)),
    "audit_missing": lambda s, d: audit.audit_missing(raw_events(s, d)),
    "audit_price_checks": lambda s, d: audit.audit_price_checks(raw_events(s, d), high=HIGH_PRICE),
    "audit_rejects": lambda s, d: audit.audit_rejects(_faulty(s, d)),
    "audit_top_prices": lambda s, d: audit.audit_top_prices(raw_events(s, d)),
    "audit_top_prices_combined": lambda s, d: audit.audit_top_prices_combined(audit.audit_top_prices(raw_events(s, d))),
    "approx_distinct_kmv": lambda s, d: audit.kmv_distinct(raw_events(s, d), "price", KMV_SIZE),
    "approx_distinct_merge": lambda s, d: audit.approx_distinct_merge(raw_events(s, d)),
    "audit_combined": lambda s, d: audit.audit_combined(raw_events(s, d), HIGH_PRICE),
    "audit_incremental": _incremental_audit,
    "audit_profile": _profile,
    "audit_profile_event_mix": lambda s, d: audit.profile_event_mix(audit.file_records(raw_events(s, d))),
    "audit_profile_missing": lambda s, d: audit.profile_missing(_profile(s, d), "all"),
    "audit_combined_event_mix": lambda s, d: audit.audit_event_mix(raw_events(s, d), ()),
    "audit_combined_missing": lambda s, d: audit.audit_missing(raw_events(s, d), ()),
    # exploratory aggregates
    "revenue_distribution": lambda s, d: revenue.revenue_distribution(_buys(s, d)),
    "price_histogram": lambda s, d: revenue.price_histogram(_buys(s, d), 60),
    "price_histogram_p95": lambda s, d: revenue.price_histogram(_buys(s, d), 50, 0.95),
    "monthly_trend": lambda s, d: revenue.monthly_trend(_buys(s, d)),
    "monthly_growth": lambda s, d: revenue.monthly_growth(revenue.monthly_trend(_buys(s, d))),
    "daily_trend": lambda s, d: revenue.daily_trend(_buys(s, d)),
    "top_customers": lambda s, d: revenue.top_customers(_buys(s, d)),
    "top_products": lambda s, d: revenue.top_products(_buys(s, d), TOP_PRODUCTS),
    "basket_summary": lambda s, d: revenue.basket_summary(_buys(s, d)),
    "basket_distribution": lambda s, d: revenue.basket_distribution(_buys(s, d)),
    "session_revenue_sample": lambda s, d: revenue.session_revenue_sample(_buys(s, d), SAMPLE_SIZE),
    "session_revenue_histogram": lambda s, d: revenue.session_revenue_histogram(
        revenue.session_revenue_sample(_buys(s, d), SAMPLE_SIZE)
    ),
    # funnel and mix
    "category_funnel": lambda s, d: funnel.category_funnel(_funnel(s, d)),
    "category_mix": lambda s, d: funnel.category_mix(_stored_funnel(s, d)),
    "brand_mix": lambda s, d: funnel.brand_mix(_stored_funnel(s, d)),
    "brand_combined_share": lambda s, d: funnel.combined_share(funnel.brand_mix(_stored_funnel(s, d)), "brand"),
    "category_monthly_funnel": lambda s, d: funnel.category_monthly_funnel(
        prepare.funnel_events(_typed_purchases(s, d))
    ),
    "category_monthly_funnel_stored": lambda s, d: funnel.category_monthly_funnel_from_folds(
        _bucketed_folds(s, d, _typed_purchases)
    ),
    "top_conversion_categories": lambda s, d: funnel.top_conversion_categories(
        funnel.category_funnel(_funnel(s, d)), MIN_VIEWS
    ),
    "top_revenue_categories": lambda s, d: funnel.top_revenue(funnel.category_mix(_stored_funnel(s, d)), "category_code"),
    "top_revenue_brands": lambda s, d: funnel.top_revenue(funnel.brand_mix(_stored_funnel(s, d)), "brand"),
    # opportunity matrix
    "opportunity_matrix": _matrix,
    "opportunity_cutoffs": lambda s, d: funnel.opportunity_cutoffs(funnel.category_funnel(_funnel(s, d)), MIN_VIEWS),
    "opportunity_summary": lambda s, d: funnel.opportunity_summary(_matrix(s, d)),
    "opportunity_detailed": lambda s, d: funnel.opportunity_detailed(_matrix(s, d)),
    "opportunity_top5": lambda s, d: funnel.opportunity_top(_matrix(s, d)),
    "opportunity_labels": lambda s, d: funnel.opportunity_labels(_matrix(s, d)),
    # RFM
    "rfm_base": lambda s, d: rfm.rfm_base(_buys(s, d)),
    "rfm_scores": lambda s, d: rfm.rfm_scores(rfm.rfm_base(_buys(s, d))),
    "rfm_segment_summary": lambda s, d: rfm.rfm_segment_summary(_stored_customers(s, d)),
    "rfm_score_grid": lambda s, d: rfm.rfm_score_grid(_stored_customers(s, d)),
    "rfm_heatmap": lambda s, d: rfm.rfm_heatmap(rfm.rfm_score_grid(_stored_customers(s, d))),
    "rfm_focus_customers": lambda s, d: rfm.rfm_focus_customers(_stored_customers(s, d), k=SAMPLE_SIZE),
    # statistics
    "mwu_month": lambda s, d: _nine("z", "p_value")(hypothesis.mann_whitney_months(_buys(s, d), *MONTHS)),
    "mwu_brand": lambda s, d: _nine("z", "p_value")(hypothesis.mann_whitney_brands(_buys(s, d), *BRANDS)),
    "ztest_conversion": lambda s, d: _nine("statistic", "p_value")(hypothesis.conversion_ztest(_funnel(s, d), FOCUS)),
    "stat_tests_summary": lambda s, d: _nine("statistic", "p_value")(
        hypothesis.stat_tests_summary(_buys(s, d), _funnel(s, d), *MONTHS, *BRANDS, FOCUS)
    ),
    "conversion_comparison": lambda s, d: hypothesis.conversion_comparison(_funnel(s, d), FOCUS),
    "price_box_by_month": lambda s, d: hypothesis.price_box_by_month(_buys(s, d)),
    "price_quartiles_sketched": lambda s, d: quantile_sketch.approx_boxes(_buys(s, d), "month_date"),
    "price_box_by_brand": lambda s, d: hypothesis.price_box_by_brand(_buys(s, d), BOX_BRANDS),
    "price_box_sampled_by_month": lambda s, d: hypothesis.price_box_by_month(_buys(s, d), SAMPLE_SIZE),
    "price_box_sampled_by_brand": lambda s, d: hypothesis.price_box_by_brand(_buys(s, d), BOX_BRANDS, SAMPLE_SIZE),
    "sample_rows": lambda s, d: sampling.sample_n(
        _buys(s, d).select("month_date", "price"), SAMPLE_SIZE, 7, F.concat_ws("|", "month_date", rules.cents("price"))
    ),
    "stratified_sample": lambda s, d: sampling.sample_per_group(
        _buys(s, d).select("brand", "price"), ["brand"], STRATUM_SIZE, 7, F.concat_ws("|", "brand", rules.cents("price"))
    ),
    # retention and cohorts
    "cohort_activity": lambda s, d: retention.cohort_activity(_sessions(s, d)),
    "cohort_sizes": lambda s, d: retention.cohort_sizes(_journey(s, d)),
    "cohort_retention": _retention,
    "cohort_heatmap": lambda s, d: retention.cohort_heatmap(_retention(s, d), HEATMAP_MONTHS),
    "repeat_summary": lambda s, d: retention.repeat_summary(_journey(s, d), HORIZONS),
    "monthly_repeat_mix": lambda s, d: retention.monthly_repeat_mix(_sessions(s, d)),
    "days_to_second_hist": lambda s, d: retention.days_to_second_hist(_journey(s, d), limit=DAYS_LIMIT),
    "cohort_month1": lambda s, d: retention.cohort_month(_retention(s, d), COHORT),
    # cart abandonment and headline figures
    "cart_overview": lambda s, d: cart.cart_overview(_carts(s, d)),
    "cart_monthly": lambda s, d: cart.cart_monthly(_month_carts(s, d)),
    "cart_by_category": lambda s, d: cart.cart_by_category(_carts(s, d)),
    "cart_by_price_band": lambda s, d: cart.cart_by_price_band(_carts(s, d)),
    "cart_top_categories": lambda s, d: cart.cart_top_categories(cart.cart_by_category(_carts(s, d)), MIN_PAIRS),
    "cart_extremes": lambda s, d: cart.cart_extremes(
        cart.cart_by_price_band(_month_carts(s, d)), cart.cart_monthly(_month_carts(s, d))
    ),
    "kpi_facts": _kpi,
}
