"""Which hours of a kept brand x feature x hour cube still hold at a later time of the same day.

Both periods of the cube are by hour of the day, so hours can be taken from it side by side: those before
the first unsettled hour of either period stay, and only the hours from there on are read again, be they
new, still filling, or no longer in the period.
"""

from __future__ import annotations

from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpulse.functions.clock import moment
from weekpulse.operators.measures import ALL, SIDES
from weekpulse.spec import ReportSpec


class Hours(NamedTuple):
    """The first hour of the day that is read again, by side."""

    today: int
    last_week: int


def same_days(before: ReportSpec, now: ReportSpec) -> bool:
    return before.at(now.as_of) == now and before.today.start == now.today.start


def unsettled_from(before: ReportSpec, now: ReportSpec, unsettled_hours: int) -> Hours:
    """No later than the end of either report's period. An empty period has no hours to keep."""

    def first(old, new) -> int:
        if old.empty or new.empty:
            return 0
        return max(min(old.end, new.end).hour - unsettled_hours, 0)

    if unsettled_hours < 0:
        raise ValueError("unsettled_hours must not be negative")
    return Hours(*(first(old, new) for old, new in zip(before.periods, now.periods)))


def kept_hours(cube: DataFrame, hours: Hours) -> DataFrame:
    def kept(name: str, side: str) -> Column:
        return F.when(F.col("hour_of_day") < getattr(hours, side), F.col(name))

    sums = [kept(f"{m}_{s}", s).alias(f"{m}_{s}") for m in ALL for s in SIDES]
    counts = [F.coalesce(kept(f"rows_{s}", s), F.lit(0)).alias(f"rows_{s}") for s in SIDES]
    rows = cube.where(F.col("hour_of_day") < max(hours))
    return rows.select("brand", "feature", "hour_of_day", *sums, *counts)


def since(fact: DataFrame, spec: ReportSpec, hours: Hours) -> DataFrame:
    """Rows of both days from their first unsettled hours on; literals, so that the filter reaches the scan."""
    today, last_week = (p.start + timedelta(hours=h) for p, h in zip(spec.periods, hours))
    hour = F.col("date_hour")
    return fact.where(
        (hour >= moment(today)) | (hour >= moment(last_week)) & (hour < moment(spec.last_week.start + timedelta(days=1)))
    )
