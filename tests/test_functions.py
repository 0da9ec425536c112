import math

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import numbers, periods, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("cell, number", [
    ("$1,249.99", 1249.99), ("€ 12", 12.0), ("1e3", 1000.0), ("-.5", -0.5), ("7.", 7.0), ("£1 000", 1000.0),
    ("12d", None), ("nan", None), ("inf", None), ("1_000", None), ("", None), ("abc", None), ("1.2.3", None),
])
def test_numbers_are_read_or_refused(spark, cell, number):
    assert one(spark, text.to_number(F.lit(cell))) == number


@pytest.mark.parametrize("cell, day", [
    ("2026-01-15", "2026-01-15"), ("2026/1/5", "2026-01-05"), ("2026-01-15 10:30", "2026-01-15"),
    ("2026", None), ("2026-01", None), ("2026-02-30", None), ("2026-01-15 junk", None), ("epoch", None),
])
def test_dates_are_read_or_refused(spark, cell, day):
    assert one(spark, text.to_date(F.lit(cell)).cast("string")) == day


@pytest.mark.parametrize("cell, flag", [("Yes", True), ("t", True), ("0", False), ("NO", False), ("maybe", None)])
def test_booleans(spark, cell, flag):
    assert one(spark, text.to_boolean(F.lit(cell))) is flag


def test_trim_takes_every_space_separator_but_no_tab(spark):
    assert one(spark, text.trim_spaces(F.lit(" 　 a b  "))) == "a b"
    assert one(spark, text.trim_spaces(F.lit("\ta "))) == "\ta"


def test_shape_bits(spark):
    rows = [("  ",), (" N/A",), ("5",), ("2026-01-01",), ("yes",), ("word",), (None,)]
    found = [r["s"] for r in text.with_shape(spark.createDataFrame(rows, "v string"), "v", "s").collect()]
    assert found[0] == text.BLANK | text.TOKEN | text.PADDED
    assert found[1] == text.TOKEN | text.PADDED
    assert found[2] == text.NUMBER | text.REAL
    assert found[3] == text.DATE | text.REAL
    assert found[4] == text.BOOLEAN | text.REAL
    assert found[5] == text.REAL


# Published 90% points of Student's t.
@pytest.mark.parametrize("degrees, value", [(1, 3.077684), (2, 1.885618), (3, 1.637744), (4, 1.533206), (6, 1.439756), (18, 1.330391), (21, 1.323188)])
def test_student_quantile(degrees, value):
    assert numbers.student_quantile(0.9, degrees) == pytest.approx(value, abs=1e-6)


def test_normal_quantile():
    assert numbers.normal_quantile(0.9) == pytest.approx(1.281552, abs=1e-6)


def test_ratio_and_finite(spark):
    assert one(spark, numbers.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.finite(F.lit(math.inf))) is None
    assert one(spark, numbers.finite(F.lit(math.nan))) is None
    assert one(spark, numbers.finite(F.lit(2))) == 2.0
    assert one(spark, numbers.percent_text(F.lit(0.125))) == "12%"


@pytest.mark.parametrize("grain, start", [
    ("day", "2026-05-14"), ("week", "2026-05-11"), ("month", "2026-05-01"), ("quarter", "2026-04-01"), ("year", "2026-01-01"),
])
def test_truncation(spark, grain, start):
    when = F.lit("2026-05-14 23:59:59").cast("timestamp_ntz")
    assert str(one(spark, periods.truncate(when, grain)))[:10] == start


def test_unknown_grain():
    with pytest.raises(ValueError):
        periods.truncate(None, "hour")


@pytest.mark.parametrize("last, gap_days, steps, expected", [
    ("2026-05-31", 30.5, 1, "2026-06-30"), ("2026-01-31", 31, 1, "2026-02-28"), ("2026-06-01", 30, 4, "2026-10-01"),
    ("2026-01-01", 91, 2, "2026-07-01"), ("2024-02-29", 365, 1, "2025-02-28"), ("2026-01-05", 7, 3, "2026-01-26"),
])
def test_steps_follow_the_calendar(spark, last, gap_days, steps, expected):
    column = periods.step_ahead(F.lit(last).cast("timestamp_ntz"), F.lit(gap_days * 86400.0), F.lit(steps))
    assert str(one(spark, column)) == expected
