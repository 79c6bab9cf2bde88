"""The five percent changes. They differ in zero handling, sign guard and rounding on purpose.

All subtract before converting to double, so that decimal sums lose nothing in the difference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference(now: Column, before: Column) -> Column:
    return now - before


def rounded(now: Column, before: Column) -> Column:
    """One decimal, half up; NULL unless the base is positive."""
    return F.when(before > 0, F.round(_change(now, before), 1))


def zero_filled(now: Column, before: Column) -> Column:
    """0 where the base is zero; negative bases count."""
    ratio = F.try_divide(difference(now, before).cast("double"), before.cast("double"))
    return F.coalesce(ratio * 100, F.lit(0.0))


def positive_base(now: Column, before: Column) -> Column:
    """0 unless the base is positive."""
    return F.when(before > 0, _change(now, before)).otherwise(F.lit(0.0))


def nonzero_base(now: Column, before: Column) -> Column:
    """NULL where the base is zero or either side is missing."""
    return F.try_divide(difference(now, before).cast("double"), before.cast("double")) * 100


def plain_ratio(now: Column, before: Column) -> Column:
    """(now / before - 1) in percent; NULL where the base is zero."""
    return (F.try_divide(now.cast("double"), before.cast("double")) - 1) * 100


def _change(now: Column, before: Column) -> Column:
    # Only ever evaluated behind a guard on `before`: ANSI mode rejects x / 0.
    return difference(now, before).cast("double") / before.cast("double") * 100
