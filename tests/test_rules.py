from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from shoptrace.functions import rules
from shoptrace.functions.normal import two_sided_p


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cents_and_money_are_exact(spark):
    for text, whole in (("0.29", 29), ("1.15", 115), ("19.99", 1999), ("2574.07", 257407), ("-6.55", -655), ("0", 0)):
        assert one(spark, rules.cents(F.lit(text).cast("double"))) == whole
        assert one(spark, rules.money(F.lit(whole))) == float(text)


def test_rounding_is_half_up(spark):
    assert one(spark, rules.mean_money(F.lit(5), F.lit(2))) == 0.03
    assert one(spark, rules.pct(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, rules.pct(F.lit(2), F.lit(3))) == 66.67
    assert one(spark, rules.quantile2(F.lit(174.025))) == 174.03


def test_division_by_zero_is_null(spark):
    assert one(spark, rules.pct(F.lit(1), F.lit(0))) is None
    assert one(spark, rules.mean_money(F.lit(1), F.lit(0))) is None
    assert one(spark, rules.ratio(F.lit(0), F.lit(0))) is None


def test_blank_and_strip(spark):
    assert one(spark, rules.blank_to_null(F.lit("   "))) is None
    assert one(spark, rules.blank_to_null(F.lit(" a "))) == "a"
    for text in ("\t x \n", " x　", "\x1cx", "x\u2003", "\u00e9 ", "\u2003", "plain", "", " \t\r\n", None):
        assert one(spark, rules.strip(F.lit(text).cast("string"))) == (text or "").strip()
        assert one(spark, rules.is_blank(F.lit(text).cast("string"))) == (not (text or "").strip())


def test_month_arithmetic(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, rules.months_between(day("2019-10-31"), day("2019-11-01"))) == 1
    assert one(spark, rules.months_between(day("2019-12-01"), day("2021-01-31"))) == 13
    assert one(spark, rules.month_of(day("2020-02-29"))) == date(2020, 2, 1)
    assert one(spark, rules.days_between(day("2020-02-28"), day("2020-03-01"))) == 2


@pytest.mark.parametrize("z", [0.0, 1e-9, 0.5, -1.0, 1.96, 3.0, 3.53, 3.54, 5.0, -8.0, 20.0, 37.0, 60.0])
def test_normal_tail(spark, z):
    expected = math.erfc(abs(z) / math.sqrt(2))
    assert one(spark, two_sided_p(F.lit(z))) == pytest.approx(expected, rel=1e-10, abs=1e-300)


def test_normal_tail_of_null(spark):
    assert one(spark, two_sided_p(F.lit(None).cast("double"))) is None
