"""Data-quality profile of a raw (all-text) log, per source file or combined.

Every function over the log takes ``by``: ``("src",)`` profiles each file, ``()`` the whole log. All of it is partial aggregation: a
file holding most of the rows is folded inside the scan tasks. ``file_records`` makes one pass for all of the profile but the top
prices; the ``profile`` functions, ``combined`` and ``merged_estimates`` then work on these few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptrace.functions.rules import is_blank, pct, strip
from shoptrace.operators.ordering import hash_text
from shoptrace.operators.prepare import TYPES, is_malformed
from shoptrace.sources.events import CORRUPT, has_column
from shoptrace.sources.tables import materialise

PER_FILE = ("src",)
MISSING = "<missing>"
KMV_SIZE = 4096
HIGH_PRICE = 10_000
#: Sketches of distinct values keep 2**14 hashes: exact below that, then a standard error of 0.8%.
SKETCH_LG = 14


def _filled(name: str) -> Column:
    """Stripped text; blank is NULL."""
    return F.when(~is_blank(name), strip(name))


def _price(strict: bool = True) -> Column:
    return _filled("price").cast("double") if strict else _filled("price").try_cast("double")


def kmv_hashes(
    raw: DataFrame, columns: Sequence[str], by: Sequence[str] = PER_FILE, k: int = KMV_SIZE, slack: float = 1.5
) -> DataFrame:
    """The k smallest distinct hashes of each column per group: a sketch that merges by union and another cut to k.

    A rough count of distinct values, a few bytes per group and task, first bounds the hashes worth looking at; only about
    k of each group are then shuffled. A group left with too few has its bound widened. Columns: by, column_name, h.
    """
    each = raw.select(
        *by, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _filled(c).alias("v")) for c in columns])).alias("e")
    ).select(*by, "e.column_name", "e.v")
    each = each.where(F.col("v").isNotNull())
    keys = [*by, "column_name"]
    rough = materialise(each.groupBy(*keys).agg(F.approx_count_distinct("v").alias("rough")), "rough-counts")
    place = F.conv(F.substring("h", 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    while True:
        share = F.lit(k * slack + 64) / F.greatest(F.col("rough"), F.lit(1))
        near = each.join(rough, keys).select(*keys, hash_text(F.col("v")).alias("h"), share.alias("share"))
        near = materialise(near.where(place < F.col("share")).groupBy(*keys, "h").agg(F.max("share").alias("share")), "near")
        found = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("share").alias("share"))
        groups = rough.withColumn("bound", share).join(found.select(*keys, "n"), keys, "left")
        if groups.where((F.coalesce("n", F.lit(0)) < k) & (F.col("bound") < 1)).limit(1).count() == 0:
            return _smallest(near, keys, k)
        slack *= 4


def _smallest(hashes: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    return hashes.withColumn("_rank", rank).where(F.col("_rank") <= k).select(*keys, "h")


def kmv_merge(hashes: DataFrame, k: int = KMV_SIZE) -> DataFrame:
    """Sketches of several groups as one sketch per column."""
    return _smallest(hashes.select("column_name", "h").distinct(), ["column_name"], k)


def kmv_estimate(hashes: DataFrame, by: Sequence[str] = (), k: int = KMV_SIZE) -> DataFrame:
    """Distinct estimate per sketch: exact below k. Columns: by, column_name, hashes_kept, distinct_estimate."""
    summary = hashes.groupBy(*by, "column_name").agg(F.count(F.lit(1)).alias("hashes_kept"), F.max("h").alias("kth"))
    kth = F.conv("kth", 16, 10).cast("decimal(20,0)").cast("double")
    estimate = F.floor(F.lit(float(k - 1)) / F.nullif(kth / F.lit(float((1 << 64) - 1)), F.lit(0.0)))
    return summary.select(
        *by,
        "column_name",
        "hashes_kept",
        F.when(F.col("hashes_kept") < k, F.col("hashes_kept"))
        .otherwise(F.coalesce(estimate, F.col("hashes_kept")))
        .alias("distinct_estimate"),
    )


DISTINCT = {"user_id": "distinct_users", "user_session": "distinct_sessions"}
CHECKS = ("zero_price", "negative_price", "high_price")


def _counters(high: float, strict: bool = True) -> list[Column]:
    price = _price(strict)
    checks = (price == 0, price < 0, price > high)
    return [F.count(F.lit(1)).alias("row_count"), *[F.count_if(c).alias(name) for name, c in zip(CHECKS, checks, strict=True)]]


def _times() -> list[Column]:
    """Beside a sketch these text extremes are kept in an object aggregate; alone they would make Spark sort the log."""
    return [F.min(_filled("event_time")).alias("min_event_time"), F.max(_filled("event_time")).alias("max_event_time")]


def _sketches(columns: Sequence[str]) -> list[Column]:
    return [F.theta_sketch_agg(_filled(c), SKETCH_LG).alias(f"{c}_sketch") for c in columns]


def _estimates(columns: Sequence[str]) -> list[Column]:
    return [F.theta_sketch_estimate(f"{c}_sketch").alias(DISTINCT[c]) for c in columns]


def _folds(columns: Sequence[str]) -> list[Column]:
    """How records merge: counts add, extremes fold, sketches unite."""
    out = []
    for name in columns:
        if name.endswith("_sketch"):
            out.append(F.theta_union_agg(name, SKETCH_LG).alias(name))
        elif name in ("min_event_time", "max_event_time"):
            out.append((F.min if name.startswith("min") else F.max)(name).alias(name))
        else:
            out.append(F.coalesce(F.sum(name), F.lit(0)).alias(name))
    return out


def file_records(raw: DataFrame, high: float = HIGH_PRICE, strict: bool = True) -> DataFrame:
    """All that the profile of a log needs, one small row per file and event type, from one pass over the log.

    Rows, event time extremes, blanks per column (``missing_<column>``), price checks, and a mergeable sketch each of users and
    sessions. The functions below read such records, written or not, of any number of files.
    A price that is no number raises; without ``strict`` it passes no check (``audit_rejects`` counts it).
    """
    blanks = [F.count_if(is_blank(c)).alias(f"missing_{c}") for c in raw.columns if c not in PER_FILE]
    return raw.groupBy("src", strip("event_type").alias("event_type")).agg(*_counters(high, strict), *_times(), *blanks, *_sketches(list(DISTINCT)))


def folded(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records merged per ``by``."""
    return records.groupBy(*by).agg(*_folds([c for c in records.columns if c not in ("src", "event_type", *by)]))


def profile(records: DataFrame) -> DataFrame:
    """One row per file and one for the whole log (``scope`` 'file' or 'all', src NULL), by grouping sets over the files' rows.

    An empty log has no rows here.
    """
    files = folded(records, ["src"])
    measures = [c for c in files.columns if c != "src"]
    both = files.groupingSets([[F.col("src")], []], "src").agg(
        F.when(F.grouping("src") == 1, "all").otherwise("file").alias("scope"), F.count(F.lit(1)).alias("files"), *_folds(measures)
    )
    kept = [c for c in measures if not c.endswith("_sketch")]
    return both.select("scope", "src", "files", *kept, *_estimates(list(DISTINCT)))


def profile_event_mix(records: DataFrame, by: Sequence[str] = PER_FILE) -> DataFrame:
    counts = records.groupBy(*by, "event_type").agg(F.sum("row_count").alias("events")).where("events > 0")
    return _shares(counts, by)


def profile_missing(profiled: DataFrame, scope: str = "file") -> DataFrame:
    """``audit_missing`` from the rows of ``profile`` of one scope."""
    names = [c.removeprefix("missing_") for c in profiled.columns if c.startswith("missing_")]
    wide = profiled.where(F.col("scope") == scope).select("src", F.col("row_count").alias("_rows"), *[F.col(f"missing_{c}").alias(c) for c in names])
    return _blanks(wide if scope == "file" else wide.drop("src"), PER_FILE if scope == "file" else (), names)


def audit_overview(raw: DataFrame, by: Sequence[str] = PER_FILE) -> DataFrame:
    """Rows, least and greatest event time (as text), approximate distinct users and sessions; one pass over the log."""
    folds = raw.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *_times(), *_sketches(list(DISTINCT)))
    return folds.select(*by, "row_count", "min_event_time", "max_event_time", *_estimates(list(DISTINCT)))


def audit_event_mix(raw: DataFrame, by: Sequence[str] = PER_FILE) -> DataFrame:
    """Events and share per event type; types are stripped, not lower-cased."""
    return _shares(raw.groupBy(*by, strip("event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("events")), by)


def _shares(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*by)  # sees one row per event type
    return counts.withColumn("share_pct", pct("events", F.sum("events").over(whole))).orderBy(
        *by, F.desc("events"), "event_type"
    )


def audit_missing(raw: DataFrame, by: Sequence[str] = PER_FILE) -> DataFrame:
    """Blank or NULL values per column, most first; columns without any are kept with 0."""
    names = [c for c in raw.columns if c not in PER_FILE]
    wide = raw.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(is_blank(c)).alias(c) for c in names]
    )
    return _blanks(wide, by, names)


def _blanks(wide: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return (
        wide.unpivot([*by, "_rows"], names, "column_name", "missing")
        .select(*by, "column_name", "missing", pct("missing", "_rows").alias("missing_pct"))
        .orderBy(*by, F.desc("missing"), "column_name")
    )


def audit_rejects(raw: DataFrame, by: Sequence[str] = PER_FILE) -> DataFrame:
    """Malformed values per column (``prepare.is_malformed``) and whole lines (``line``), most first, and their share of the rows."""
    reasons = {c: is_malformed(c) for c in TYPES}
    if has_column(raw, CORRUPT):
        reasons["line"] = F.col(CORRUPT).isNotNull()
    wide = raw.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(bad).alias(c) for c, bad in reasons.items()])
    return _blanks(wide, by, list(reasons)).withColumnsRenamed({"missing": "malformed", "missing_pct": "malformed_pct"})


def audit_price_checks(raw: DataFrame, by: Sequence[str] = PER_FILE, high: float = HIGH_PRICE, strict: bool = True) -> DataFrame:
    """Zero, negative and suspiciously high prices. A price that is no number raises; without ``strict`` it is none of these."""
    price = _price(strict)
    return raw.groupBy(*by).agg(
        F.count_if(price == 0).alias("zero_price"),
        F.count_if(price < 0).alias("negative_price"),
        F.count_if(price > high).alias("high_price"),
    )


def audit_top_prices(raw: DataFrame, per_file: int = 5) -> DataFrame:
    """The dearest rows of each file.

    The top rows of a file lie within its ``per_file`` greatest distinct prices, so those are found first from two narrow
    columns, and only rows at or above the last of them are ranked: the log itself is neither sorted nor, as long as the
    written cut-offs (one row per file) are small enough for Spark to broadcast, shuffled.
    """
    prices = raw.select("src", _price().alias("price")).where(F.col("price").isNotNull()).distinct()
    by_price = Window.partitionBy("src").orderBy(F.desc("price"))
    cutoffs = materialise(
        prices.withColumn("nth", F.row_number().over(by_price))
        .where(F.col("nth") <= per_file)
        .groupBy("src")
        .agg(F.min("price").alias("cutoff")),
        "price-cutoffs",
    )
    rows = (
        raw.withColumn("price", _price())
        .join(cutoffs, "src")
        .where(F.col("price") >= F.col("cutoff"))
        .select(
            "src",
            "price",
            strip("product_id").alias("product_id"),
            F.coalesce(_filled("brand"), F.lit(MISSING)).alias("brand"),
            F.coalesce(_filled("category_code"), F.lit(MISSING)).alias("category_code"),
        )
    )
    dearest = Window.partitionBy("src").orderBy(
        F.desc("price"), F.desc("product_id"), F.desc("brand"), F.desc("category_code")
    )
    return (
        rows.withColumn("price_rank", F.row_number().over(dearest))
        .where(F.col("price_rank") <= per_file)
        .select("src", F.col("price_rank").cast("bigint").alias("price_rank"), "price", "product_id", "brand", "category_code")
    )


def audit_top_prices_combined(top_prices: DataFrame, k: int = 10) -> DataFrame:
    """The dearest k of the per-file lists (not of all rows)."""
    return (
        top_prices.select("price", "src", "product_id", "brand", "category_code")
        .orderBy(*[F.desc(c) for c in ("price", "src", "product_id", "brand", "category_code")])
        .limit(k)
    )


def kmv_distinct(df: DataFrame, column: str, k: int = KMV_SIZE) -> DataFrame:
    """Distinct estimate from the k smallest hash values; exact below k. Columns: hashes_kept, distinct_estimate."""
    found = kmv_estimate(kmv_hashes(df, [column], (), k), (), k)
    zero = lambda name: F.coalesce(F.max(name), F.lit(0)).alias(name)
    return found.agg(zero("hashes_kept"), zero("distinct_estimate"))


def distinct_sketches(raw: DataFrame, columns: Sequence[str], by: Sequence[str] = PER_FILE) -> DataFrame:
    """One sketch per group and column (``<column>_sketch``), to be stored and merged later without the rows."""
    return raw.groupBy(*by).agg(*_sketches(columns))


def approx_distinct_merge(raw: DataFrame, columns: Sequence[str] = ("user_id", "user_session")) -> DataFrame:
    """One sketch per file, merged over files: a distinct estimate per column that never revisits the rows."""
    return merged_estimates(distinct_sketches(raw, columns), columns)


def merged_estimates(sketches: DataFrame, columns: Sequence[str] = ("user_id", "user_session")) -> DataFrame:
    """Distinct estimate per column over stored sketches."""
    merged = sketches.agg(*_folds([f"{c}_sketch" for c in columns]))
    each = [F.struct(F.lit(c).alias("column_name"), F.theta_sketch_estimate(f"{c}_sketch").alias("distinct_estimate")) for c in columns]
    return merged.select(F.inline(F.array(*each)))


def audit_combined(raw: DataFrame, high: float = HIGH_PRICE, strict: bool = True) -> DataFrame:
    """Per-file records folded into one: counts add, extremes fold, sketches merge; one pass over the log."""
    return combined(raw.groupBy("src").agg(*_counters(high, strict), *_times(), *_sketches(list(DISTINCT))))


def combined(records: DataFrame) -> DataFrame:
    """One row from records of any number of files."""
    files = folded(records, ["src"])
    measures = [c for c in files.columns if c != "src"]
    out = files.agg(F.count(F.lit(1)).alias("files"), *_folds(measures))
    return out.select("files", "row_count", *CHECKS, "min_event_time", "max_event_time", *_estimates(list(DISTINCT)))
