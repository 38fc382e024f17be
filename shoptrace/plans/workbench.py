"""All analyses over one event log, sharing the tables they have in common.

Each shared table is computed once, on first use, and written; every report reads the written table. The log itself is scanned
for the audit's records, for the dearest rows, for the folds per (session, product, month), and for the purchases.

Without ``folder`` the tables lie in the shared folder and belong to the workbench: ``release`` (or leaving a ``with`` block) deletes
them, after which nothing built on them can be read. With ``folder`` they are kept there under their names, and a workbench that is
opened on the folder again reads those that are complete instead of the log. Such a folder belongs to one log and one ``Settings``: whoever
changes either takes another folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from shoptrace.operators import audit, cart, funnel, hypothesis, kpi, prepare, retention, revenue, rfm
from shoptrace.sources.events import write_result
from shoptrace.sources.tables import complete, release, written


@dataclass(frozen=True)
class Settings:
    """The constants of the analysis."""

    min_views: int = funnel.MIN_VIEWS
    min_pairs: int = cart.MIN_PAIRS
    bands: tuple[int, ...] = prepare.PRICE_BANDS
    high_price: float = audit.HIGH_PRICE
    top_k: int = 15
    focus: str = "electronics.smartphone"
    brands: tuple[str, str] = ("apple", "samsung")
    box_brands: tuple[str, ...] = ("apple", "samsung", "xiaomi")
    months: tuple[str, str] = ("2019-10-01", "2019-11-01")
    horizons: tuple[int, ...] = (7, 30)
    days_limit: int = 60
    sample_sessions: int = 200_000
    focus_customers: int = 60_000
    #: Rows drawn for the price boxes by month and by brand; None for all rows.
    box_samples: tuple[int | None, int | None] = (None, None)


class Workbench:
    """``Workbench(raw).results()`` is every result table by name; ``typed`` skips cleaning for a stored cleaned log."""

    def __init__(
        self, raw: DataFrame | None = None, typed: DataFrame | None = None, settings: Settings = Settings(), folder: str | None = None
    ):
        if raw is None and typed is None:
            raise ValueError("give a raw or a typed event log")
        self.raw = raw
        self.typed = typed if typed is not None else prepare.clean_events(raw)
        self.settings = settings
        self.folder = folder
        self._paths: list[str] = []

    def _kept(self, table: Callable[[], DataFrame], name: str) -> DataFrame:
        """The written form of a shared table: what ``folder`` has of it, or computed and written now."""
        if self.folder is None:
            reader, path = written(table(), name)
            self._paths.append(path)
            return reader
        path = f"{self.folder}/{name}"
        if not complete(self.spark, path):
            table().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @property
    def spark(self) -> SparkSession:
        return self.typed.sparkSession

    def release(self) -> None:
        """Delete the tables this workbench has written to the shared folder. A kept ``folder`` stays."""
        while self._paths:
            release(self.spark, self._paths.pop())
        for name in [n for n, x in vars(type(self)).items() if isinstance(x, cached_property)]:
            self.__dict__.pop(name, None)

    def __enter__(self) -> Workbench:
        return self

    def __exit__(self, *failure) -> None:
        self.release()

    # shared tables

    @cached_property
    def purchases(self) -> DataFrame:
        return self._kept(lambda: prepare.purchases(self.typed), "purchases")

    @cached_property
    def facts(self) -> DataFrame:
        """Funnel and cart facts per (session, product)."""
        return self._kept(lambda: prepare.facts_from_folds(self.pair_months), "facts")

    @cached_property
    def pair_months(self) -> DataFrame:
        """Folds per (session, product, month): the one wide shuffle of the log."""
        return self._kept(lambda: prepare.pair_months(prepare.funnel_events(self.typed)), "pair-months")

    @cached_property
    def funnel(self) -> DataFrame:
        return prepare.funnel_from_facts(self.facts)

    @cached_property
    def cart_pairs(self) -> DataFrame:
        return prepare.cart_pairs_from_facts(self.facts, self.settings.bands)

    @cached_property
    def sessions(self) -> DataFrame:
        return self._kept(lambda: prepare.purchase_sessions(self.purchases), "sessions")

    @cached_property
    def journey(self) -> DataFrame:
        return self._kept(lambda: prepare.journey(self.sessions), "journey")

    @cached_property
    def customers(self) -> DataFrame:
        return self._kept(lambda: rfm.rfm(self.purchases), "customers")

    # small results other reports build on

    @cached_property
    def category_table(self) -> DataFrame:
        return self._kept(lambda: funnel.category_funnel(self.funnel), "category-funnel")

    @cached_property
    def category_mix(self) -> DataFrame:
        return self._kept(lambda: funnel.category_mix(self.funnel), "category-mix")

    @cached_property
    def brand_mix(self) -> DataFrame:
        return self._kept(lambda: funnel.brand_mix(self.funnel), "brand-mix")

    @cached_property
    def matrix(self) -> DataFrame:
        return self._kept(lambda: funnel.opportunity_matrix(self.category_table, self.settings.min_views), "matrix")

    @cached_property
    def segment_summary(self) -> DataFrame:
        return self._kept(lambda: rfm.rfm_segment_summary(self.customers), "segments")

    @cached_property
    def opportunity(self) -> DataFrame:
        return self._kept(lambda: funnel.opportunity_summary(self.matrix), "opportunity")

    @cached_property
    def audit_records(self) -> DataFrame:
        """One small row per file and event type, from one pass over the raw log."""
        if self.raw is None:
            raise ValueError("the audit reads the raw log")
        return self._kept(lambda: audit.file_records(self.raw, self.settings.high_price), "audit-records")

    @cached_property
    def audit_profile(self) -> DataFrame:
        return self._kept(lambda: audit.profile(self.audit_records), "audit-profile")

    @cached_property
    def audit_top_prices(self) -> DataFrame:
        return self._kept(lambda: audit.audit_top_prices(self.raw), "audit-top-prices")

    @cached_property
    def retention(self) -> DataFrame:
        activity = self._kept(lambda: retention.cohort_activity(self.sessions), "cohort-activity")
        return self._kept(lambda: retention.cohort_retention(activity, retention.cohort_sizes(self.journey)), "retention")

    # result sets

    def results(self) -> dict[str, DataFrame]:
        """The tables of the analysis, by the name of their result file."""
        s = self.settings
        return {
            "revenue_distribution_summary": revenue.revenue_distribution(self.purchases),
            "monthly_trend": revenue.monthly_trend(self.purchases),
            "daily_trend": revenue.daily_trend(self.purchases),
            "top_customers": revenue.top_customers(self.purchases, s.top_k),
            "top_products": revenue.top_products(self.purchases, s.top_k),
            "basket_size_summary": revenue.basket_summary(self.purchases),
            "basket_size_distribution": revenue.basket_distribution(self.purchases),
            "category_funnel_summary": self.category_table,
            "category_mix_summary": self.category_mix,
            "brand_mix_summary": self.brand_mix,
            "category_monthly_funnel": funnel.category_monthly_funnel_from_folds(self.pair_months),
            "category_opportunity_summary": self.opportunity,
            "category_opportunity_detailed": funnel.opportunity_detailed(self.matrix),
            "rfm_customer_segments": self.customers,
            "rfm_segment_summary": self.segment_summary,
            "rfm_score_grid": rfm.rfm_score_grid(self.customers),
            "statistical_tests_summary": hypothesis.stat_tests_summary(
                self.purchases, self.funnel, *s.months, *s.brands, s.focus
            ),
            "cohort_retention_matrix": self.retention,
            "retention_repeat_summary": retention.repeat_summary(self.journey, s.horizons),
            "retention_monthly_mix": retention.monthly_repeat_mix(self.sessions),
            "cart_abandonment_overview": cart.cart_overview(self.cart_pairs),
            "cart_abandonment_monthly": cart.cart_monthly(self.cart_pairs),
            "cart_abandonment_by_category": cart.cart_by_category(self.cart_pairs),
            "cart_abandonment_by_price_band": cart.cart_by_price_band(self.cart_pairs),
        }

    def chart_data(self) -> dict[str, DataFrame]:
        """The data behind the charts."""
        s = self.settings
        sample = revenue.session_revenue_sample(self.purchases, s.sample_sessions)
        return {
            "price_histogram": revenue.price_histogram(self.purchases, 60),
            "price_histogram_p95": revenue.price_histogram(self.purchases, 50, 0.95),
            "session_revenue_histogram": revenue.session_revenue_histogram(sample),
            "top_conversion_categories": funnel.top_conversion_categories(self.category_table, s.min_views, s.top_k),
            "top_revenue_categories": funnel.top_revenue(self.category_mix, "category_code", s.top_k),
            "top_revenue_brands": funnel.top_revenue(self.brand_mix, "brand", s.top_k),
            "opportunity_labels": funnel.opportunity_labels(self.matrix, s.top_k),
            "rfm_heatmap": rfm.rfm_heatmap(rfm.rfm_score_grid(self.customers)),
            "rfm_focus_customers": rfm.rfm_focus_customers(self.customers, k=s.focus_customers),
            "conversion_comparison": hypothesis.conversion_comparison(self.funnel, s.focus),
            "price_box_by_month": hypothesis.price_box_by_month(self.purchases, s.box_samples[0]),
            "price_box_by_brand": hypothesis.price_box_by_brand(self.purchases, s.box_brands, s.box_samples[1]),
            "cohort_heatmap": retention.cohort_heatmap(self.retention),
            "days_to_second_hist": retention.days_to_second_hist(self.journey, limit=s.days_limit),
            "cart_top_categories": cart.cart_top_categories(cart.cart_by_category(self.cart_pairs), s.min_pairs),
        }

    def headline(self) -> dict[str, DataFrame]:
        """Single figures: growth, cut-offs, combined share, extremes, and the long table of headline facts."""
        s = self.settings
        return {
            "monthly_growth": revenue.monthly_growth(revenue.monthly_trend(self.purchases)),
            "opportunity_cutoffs": funnel.opportunity_cutoffs(self.category_table, s.min_views),
            "opportunity_top5": funnel.opportunity_top(self.matrix),
            "brand_combined_share": funnel.combined_share(self.brand_mix, "brand"),
            "cart_extremes": cart.cart_extremes(
                cart.cart_by_price_band(self.cart_pairs), cart.cart_monthly(self.cart_pairs)
            ),
            "cohort_month1": retention.cohort_month(self.retention, s.months[0]),
            "kpi_facts": kpi.kpi_facts(
                self.opportunity,
                self.category_mix,
                hypothesis.conversion_ztest(self.funnel, s.focus),
                self.segment_summary,
                retention.repeat_summary(self.journey, s.horizons),
                cart.cart_overview(self.cart_pairs),
                s.focus,
                s.horizons[-1],
            ),
        }

    def audit(self) -> dict[str, DataFrame]:
        """The data-quality profile per file and of the whole log; needs the raw log with ``src``."""
        profiled = self.audit_profile
        of_files = profiled.where("scope = 'file'")
        checks = ("src", *audit.CHECKS)
        return {
            "audit_overview": of_files.select("src", "row_count", "min_event_time", "max_event_time", *audit.DISTINCT.values()),
            "audit_event_mix": audit.profile_event_mix(self.audit_records),
            "audit_missing": audit.profile_missing(profiled),
            "audit_price_checks": of_files.select(*checks),
            "audit_top_prices": self.audit_top_prices,
            "audit_combined": audit.combined(self.audit_records),
            "audit_combined_event_mix": audit.profile_event_mix(self.audit_records, ()),
            "audit_combined_missing": audit.profile_missing(profiled, "all"),
            "audit_top_prices_combined": audit.audit_top_prices_combined(self.audit_top_prices),
            "approx_distinct_merge": audit.merged_estimates(self.audit_records),
        }

    def write_results(self, folder: str, fmt: str = "csv") -> None:
        """Store every result table under its name."""
        for name, table in self.results().items():
            write_result(table, f"{folder}/{name}", fmt)
