"""Column rules every operator shares.

Money is carried as whole cents in BIGINT: sums are exact, do not depend on the order of rows, stay in the fixed-width
aggregation buffers of generated code, and overflow raises (ANSI) instead of wrapping. Prices have two decimals; a finer one is refused.
Rounding is half-up through ``floor``, which gives the same double in every engine, unlike ``round`` on doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

# Characters Python's str.strip() removes, found by rule (all lie below U+3001).
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(price: Column | str) -> Column:
    """Price as whole cents; a price with a fraction of a cent raises, since its sum would be wrong."""
    amount = as_col(price).cast("double")
    whole = F.floor(amount * 100 + 0.5)
    # a double holds a price to about 16 digits
    finer = F.abs(amount * 100 - whole) > F.greatest(F.lit(1e-6), F.abs(whole) * 1e-12)
    fault = F.raise_error(F.concat(F.lit("price with a fraction of a cent: "), amount.cast("string")))
    return F.when(finer, fault.cast("bigint")).otherwise(whole.cast("bigint"))


def money(whole_cents: Column | str) -> Column:
    """Cents back to a double amount."""
    return as_col(whole_cents).cast("double") / F.lit(100.0)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in double; NULL where b is zero, also under ANSI."""
    return as_col(a).cast("double") / F.nullif(as_col(b).cast("double"), F.lit(0.0))


def round2(x: Column | str) -> Column:
    return F.floor(as_col(x) * 100 + 0.5) / F.lit(100.0)


def pct(a: Column | str, b: Column | str) -> Column:
    """100 a / b, two decimals."""
    return round2(100.0 * as_col(a).cast("double") / F.nullif(as_col(b).cast("double"), F.lit(0.0)))


def mean_money(sum_cents: Column | str, n: Column | str) -> Column:
    """Mean amount, two decimals, from a sum of cents."""
    return F.floor(ratio(sum_cents, n) + 0.5) / F.lit(100.0)


def mean2(total: Column | str, n: Column | str) -> Column:
    """Mean of whole numbers, two decimals."""
    return round2(ratio(total, n))


def six_places(x: Column | str) -> Column:
    """A double with the noise past the sixth decimal removed (interpolated quantiles)."""
    return as_col(x).cast("decimal(18,6)").cast("double")


def quantile2(x: Column | str) -> Column:
    """An interpolated quantile, two decimals, rounded half-up in decimal."""
    return F.round(as_col(x).cast("decimal(18,6)"), 2).cast("double")


def blank_to_null(text: Column | str) -> Column:
    """Trim spaces; an empty rest is NULL."""
    return F.nullif(F.trim(as_col(text)), F.lit(""))


def strip(text: Column | str) -> Column:
    """Trim all whitespace, NULL becomes empty. Text that begins and ends in printable ASCII skips the costly trim."""
    t = as_col(text).cast("string")
    clean = F.ascii(t).between(33, 126) & F.ascii(F.substring(t, -1, 1)).between(33, 126)
    return F.coalesce(F.when(clean, t).otherwise(F.btrim(t, F.lit(WHITESPACE))), F.lit(""))


def is_blank(text: Column | str) -> Column:
    """NULL, empty or only whitespace; one look at the first character settles almost every row."""
    t = as_col(text).cast("string")
    return F.when(F.ascii(t).between(33, 126), False).otherwise(F.coalesce(F.btrim(t, F.lit(WHITESPACE)), F.lit("")) == "")


def month_of(day: Column | str) -> Column:
    """First day of the month; independent of the session time zone."""
    return F.trunc(as_col(day).cast("date"), "MM")


def months_between(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed from start to end."""
    start, end = as_col(start), as_col(end)
    return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("bigint")


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.date_diff(as_col(end), as_col(start)).cast("bigint")
