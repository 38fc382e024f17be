"""From raw events to the tables the analyses read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrace.functions.rules import (
    UNKNOWN,
    blank_to_null,
    cents,
    days_between,
    is_blank,
    money,
    month_of,
    strip,
)
from shoptrace.sources.events import CORRUPT, has_column

STAGES = ("view", "cart", "purchase")
PRICE_BANDS = (50, 150, 300, 600, 1000)


# Columns of a raw log that are not text.
TYPES = {"event_time": "timestamp_ntz", "product_id": "bigint", "category_id": "bigint", "price": "double", "user_id": "bigint"}


def clean_events(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Typed events, no row dropped. Casts are strict: malformed values raise, NULL stays NULL.

    Without ``strict`` a value that is blank or malformed becomes NULL; ``split_events`` tells malformed ones apart.
    """
    typed = {c: F.col(c).cast(kind) if strict else _tried(c) for c, kind in TYPES.items()}
    return raw.select(
        typed["event_time"].alias("event_ts"),
        "event_time",
        F.lower(F.trim("event_type")).alias("event_type"),
        typed["product_id"].alias("product_id"),
        typed["category_id"].alias("category_id"),
        blank_to_null("category_code").alias("category_code"),
        blank_to_null("brand").alias("brand"),
        typed["price"].alias("price"),
        typed["user_id"].alias("user_id"),
        blank_to_null("user_session").alias("user_session"),
    )


def _tried(name: str) -> Column:
    return strip(name).try_cast(TYPES[name])


def is_malformed(name: str) -> Column:
    """Text that is there but is no value of the column's type."""
    return ~is_blank(name) & _tried(name).isNull()


def reject_reason(raw: DataFrame) -> Column:
    """The columns of a row that are malformed, in their order and comma-separated; NULL for a sound row.

    A line that does not fit the header (``read_events(..., keep_corrupt=True)``) has the reason ``line``.
    """
    reasons = [F.when(is_malformed(c), c) for c in TYPES]
    if has_column(raw, CORRUPT):
        reasons.insert(0, F.when(F.col(CORRUPT).isNotNull(), "line"))
    return F.nullif(F.concat_ws(",", *reasons), F.lit(""))


def split_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed events of the sound rows, and the rows kept aside with their ``reject_reason``. Together they are all rows of ``raw``."""
    judged = raw.withColumn("reject_reason", reject_reason(raw))
    sound = judged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return clean_events(sound, strict=False), judged.where(F.col("reject_reason").isNotNull())


def _label(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(UNKNOWN)).alias(name)


def purchases(typed: DataFrame) -> DataFrame:
    """Valid purchase events. On a stored typed table all conditions reach the scan."""
    day = F.col("event_ts").cast("date")
    return typed.where(
        (F.col("event_type") == "purchase")
        & F.col("event_ts").isNotNull()
        & F.col("user_id").isNotNull()
        & F.col("user_session").isNotNull()
        & (F.col("price") > 0)
    ).select(
        "event_ts",
        month_of(day).alias("month_date"),
        day.alias("event_date"),
        "product_id",
        "category_id",
        _label("category_code"),
        _label("brand"),
        "price",
        "user_id",
        "user_session",
    )


def funnel_events(typed: DataFrame, types: Sequence[str] = STAGES, require_ts: bool = False) -> DataFrame:
    """Events of known type with product and session."""
    keep = F.col("product_id").isNotNull() & F.col("user_session").isNotNull() & F.col("event_type").isin(*types)
    if require_ts:
        keep = keep & F.col("event_ts").isNotNull()
    return typed.where(keep).select(
        "event_ts",
        month_of("event_ts").alias("event_month"),
        "event_type",
        "product_id",
        _label("category_code"),
        _label("brand"),
        "price",
        "user_id",
        "user_session",
    )


def stage_reached(stages: Sequence[str] = STAGES) -> Column:
    """Number of the stage an event proves (1 = first), 0 if none. The last stage counts only with a positive price."""
    depth = F.when((F.col("event_type") == stages[-1]) & (F.col("price") > 0), len(stages))
    for number in range(len(stages) - 1, 0, -1):
        depth = depth.when(F.col("event_type") == stages[number - 1], number)
    return depth.otherwise(0)


def funnel(events: DataFrame, keys: Sequence[str], stages: Sequence[str] = STAGES) -> DataFrame:
    """Cumulative 0/1 stage flags per key: reaching a stage implies all earlier ones, whatever the order in time.

    One ``max`` of the stage number carries all flags through the shuffle.
    """
    deepest = events.groupBy(*keys).agg(F.max(stage_reached(stages)).alias("_depth"))
    return deepest.select(
        *keys,
        *[(F.col("_depth") >= i).cast("int").alias(f"reached_{stage}") for i, stage in enumerate(stages, start=1)],
    )


def session_product_facts(events: DataFrame) -> DataFrame:
    """One row per (session, product) with what both the funnel and the cart table need: the log is read once for both.

    ``events`` comes from ``funnel_events`` without the time condition. Columns named ``timed_*`` and ``first_month`` see only
    events with a time. Labels are grouping keys at first, so the log is folded by hashing; the least labels are then taken over
    the merged rows, one for most pairs.
    """
    return facts_from_folds(_folded(events))


def pair_months(events: DataFrame) -> DataFrame:
    """The same fold per month as well: at most one row per (session, product, labels, month), for pair facts and the monthly funnel.

    A pair with a large part of the log shrinks to a few rows in the scan tasks, so the folds can be stored bucketed by pair
    (``tables.written_bucketed``), which the log itself could not without one huge bucket.
    """
    return _folded(events, "event_month")


PAIR = ("user_session", "product_id")


def _folded(events: DataFrame, *also: str) -> DataFrame:
    timed = F.col("event_ts").isNotNull()
    paid = (F.col("event_type") == "purchase") & (F.col("price") > 0)
    return events.groupBy(*PAIR, "category_code", "brand", *also).agg(
        F.min("user_id").alias("user_id"),
        F.max(stage_reached()).alias("depth"),
        F.coalesce(F.sum(F.when(paid, cents("price"))), F.lit(0)).alias("revenue_cents"),
        F.min("event_month").alias("first_month"),
        F.max(F.when(timed, 1).otherwise(0)).alias("timed"),
        F.max(F.when(timed & (F.col("event_type") == "cart"), 1).otherwise(0)).alias("timed_cart"),
        F.max(F.when(timed & paid, 1).otherwise(0)).alias("timed_purchase"),
        F.max(F.when(timed & (F.col("price") > 0), F.col("price"))).alias("timed_price"),
    )


def facts_from_folds(folds: DataFrame) -> DataFrame:
    """``session_product_facts`` from its folds or from ``pair_months``."""
    labelled = folds
    at_all = F.col("timed") == 1
    return labelled.groupBy("user_session", "product_id").agg(
        F.min("category_code").alias("category_code"),
        F.min("brand").alias("brand"),
        F.min("user_id").alias("user_id"),
        F.max("depth").alias("depth"),
        F.sum("revenue_cents").alias("revenue_cents"),
        F.min(F.when(at_all, F.col("category_code"))).alias("timed_category_code"),
        F.min(F.when(at_all, F.col("brand"))).alias("timed_brand"),
        F.min("first_month").alias("first_month"),
        F.max("timed_cart").alias("timed_cart"),
        F.max("timed_purchase").alias("timed_purchase"),
        F.max("timed_price").alias("timed_price"),
    )


def funnel_from_facts(facts: DataFrame) -> DataFrame:
    depth = F.col("depth")
    return facts.select(
        "user_session",
        "product_id",
        "category_code",
        "brand",
        "user_id",
        (depth >= 1).cast("int").alias("reached_view"),
        (depth >= 2).cast("int").alias("reached_cart"),
        (depth >= 3).cast("int").alias("reached_purchase"),
        money("revenue_cents").alias("revenue_proxy"),
    )


def session_product_funnel(events: DataFrame) -> DataFrame:
    """Funnel flags and revenue per (session, product)."""
    return funnel_from_facts(session_product_facts(events))


def band_labels(bands: Sequence[int] = PRICE_BANDS) -> list[str]:
    middle = [f"{low}-{high - 1}" for low, high in zip(bands, bands[1:])]
    return [f"Under {bands[0]}", *middle, f"{bands[-1]}+"]


def _band(price: Column, values: Sequence, bands: Sequence[int], null_value) -> Column:
    chain = F.when(price < bands[0], values[0])
    for bound, value in zip(bands[1:], values[1:]):
        chain = chain.when(price < bound, value)
    if null_value is not None:
        chain = chain.when(price.isNull(), null_value)
    return chain.otherwise(values[-1])


def cart_pairs_from_facts(
    facts: DataFrame, bands: Sequence[int] = PRICE_BANDS, null_band: str | None = None
) -> DataFrame:
    price = F.col("timed_price")
    labels = band_labels(bands)
    numbers = list(range(1, len(labels) + 1))
    return facts.where(F.col("timed_cart") == 1).select(
        "user_session",
        "product_id",
        F.col("timed_category_code").alias("category_code"),
        F.col("timed_brand").alias("brand"),
        "first_month",
        F.col("timed_cart").alias("saw_cart_event"),
        F.col("timed_purchase").alias("saw_purchase_event"),
        price.alias("product_price"),
        _band(price, labels, bands, null_band).alias("price_band"),
        _band(price, numbers, bands, None if null_band is None else len(labels) + 1).alias("band_order"),
        (F.col("timed_purchase") == 0).cast("int").alias("cart_abandoned"),
    )


def cart_pairs(events: DataFrame, bands: Sequence[int] = PRICE_BANDS, null_band: str | None = None) -> DataFrame:
    """(session, product) pairs with an explicit cart event, priced, banded, and flagged when never bought.

    A pair without a positive price falls into the last band; ``null_band`` names a band of its own instead.
    """
    return cart_pairs_from_facts(session_product_facts(events), bands, null_band)


def purchase_sessions(purchase_events: DataFrame) -> DataFrame:
    """First date and value per (user, session)."""
    return (
        purchase_events.groupBy("user_id", "user_session")
        .agg(F.min("event_date").alias("session_date"), F.sum(cents("price")).alias("_cents"))
        .select("user_id", "user_session", "session_date", money("_cents").alias("session_value"))
    )


def session_state(purchase_events: DataFrame, *by: Column | str) -> DataFrame:
    """What a part of the log adds to each (user, session): first and last date, events, cents. States of several parts merge."""
    return purchase_events.groupBy(*by, "user_id", "user_session").agg(
        F.min("event_date").alias("first_date"),
        F.max("event_date").alias("last_date"),
        F.count(F.lit(1)).alias("events"),
        F.sum(cents("price")).alias("cents"),
    )


def merged_sessions(states: DataFrame) -> DataFrame:
    """One state per (user, session) from states of any parts; a session may have events in several."""
    return states.groupBy("user_id", "user_session").agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum("events").alias("events"),
        F.sum("cents").alias("cents"),
    )


def sessions_from_state(merged: DataFrame) -> DataFrame:
    """``purchase_sessions`` without the log."""
    return merged.select("user_id", "user_session", F.col("first_date").alias("session_date"), money("cents").alias("session_value"))


def journey(sessions: DataFrame, observed_until: Column | None = None) -> DataFrame:
    """First, second and last purchase, cohort, repeat flag and observed days per user.

    Sessions are first merged per (user, day), so the window over one user, however busy, sees at most one row per calendar
    day. The second session is on the first day if that day has two, else on the next day with any. Without
    ``observed_until`` the greatest session date is read from ``sessions``, which then should be a written table.
    """
    if observed_until is None:
        observed_until = sessions.agg(F.max("session_date").alias("d")).scalar()
    days = sessions.groupBy("user_id", "session_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("session_value")).alias("c")
    )
    by_day = Window.partitionBy("user_id").orderBy("session_date")
    linked = days.select(
        "*",
        F.lead("session_date").over(by_day).alias("next_date"),
        F.row_number().over(by_day).alias("day_number"),
    )
    users = linked.groupBy("user_id").agg(
        F.min("session_date").alias("first_purchase_date"),
        F.max("session_date").alias("last_purchase_date"),
        F.sum("n").alias("purchase_sessions"),
        F.sum("c").alias("c"),
        F.min("next_date").alias("next_date"),
        F.max(F.when(F.col("day_number") == 1, F.col("n"))).alias("first_day_sessions"),
    )
    first = F.col("first_purchase_date")
    second = F.when(F.col("first_day_sessions") > 1, first).otherwise(F.col("next_date"))
    return users.select(
        "user_id",
        first,
        month_of(first).alias("cohort_month"),
        "last_purchase_date",
        "purchase_sessions",
        money("c").alias("customer_revenue_proxy"),
        second.alias("second_purchase_date"),
        days_between(first, second).alias("days_to_second_purchase"),
        (F.col("purchase_sessions") > 1).cast("int").alias("is_repeat_customer"),
        days_between(first, observed_until).alias("days_observed_since_first_purchase"),
    )
