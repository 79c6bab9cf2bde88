"""Texts against Python's own formatting.

Over 800,000 rounding ties the two differ in two: Java gives 0.000 for 0.0005 and 0.0000 for 0.00005.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weekpulse.functions import display

VALUES = [0.0, 0.125, 0.375, 2.5, 3.5, 12.25, -12.25, -5.0, 1234567.891, 0.05, -0.04, 1e9, 0.0015, 99.95]


@pytest.mark.parametrize(
    "text, wanted",
    [
        (display.count, "{:,.0f}"),
        (display.money, "${:,.2f}"),
        (lambda c: display.money(c, display.MILLS), "${:.3f}"),
        (lambda c: display.money(c, display.TENTH_OF_MILLS), "${:.4f}"),
        (display.percent_change, "{:+.1f}%"),
    ],
)
def test_like_python(spark, text, wanted):
    df = spark.createDataFrame([(v,) for v in VALUES], "value double")
    found = [r[0] for r in df.select(text(F.col("value"))).collect()]
    assert found == [wanted.format(v) for v in VALUES]


def test_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "value double")
    assert [r[0] for r in df.select(display.count(F.col("value"))).collect()] == ["N/A", "N/A"]


def test_percent_name_goes_before_money(spark):
    df = spark.createDataFrame(
        [("b", 0.125, 12.25, 1234, None)],
        "brand string, revenue_today double, revenue_pct_diff double, notif_today bigint, exp_pct_diff double",
    )
    assert tuple(display.display_table(df).first()) == ("b", "$0.12", "+12.2%", "1,234", "N/A")
