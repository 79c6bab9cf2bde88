"""Sums of both periods for many report times, from one scan.

Times lie a fixed step apart, so the reports whose periods hold an hour are a range of numbers that follows
from the hour by division: no join of rows and times. Rows are first summed by hour, so that it is these
sums, and not rows, that go to several reports.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpulse.functions.clock import moment
from weekpulse.operators.measures import ALL, FACT_COLUMN, SIDES
from weekpulse.operators.rows import selected
from weekpulse.spec import ReportSpec, check_read_for

DAY_MICROS = 86_400_000_000


def report_times(spec: ReportSpec, step: timedelta, count: int) -> list[datetime]:
    return [spec.as_of + k * step for k in range(count)]


def period_sums_at(fact: DataFrame, spec: ReportSpec, step: timedelta, count: int, keys: tuple[str, ...]) -> DataFrame:
    """What `period_sums` gives at `spec.as_of` and the `count` - 1 times after it, with each one's `as_of`."""
    if step < timedelta(seconds=1) or step % timedelta(seconds=1) or count < 1:
        raise ValueError("give whole seconds between the times, and at least one time")
    times = report_times(spec, step, count)
    for at in times:
        check_read_for(fact, spec.at(at))
    hour = F.col("date_hour")
    rows = selected(fact, spec).where(
        (hour >= moment(spec.last_week.start)) & (hour <= moment(times[-1]))
    )
    sums = [F.sum(FACT_COLUMN[m]).alias(m) for m in ALL]
    by_hour = rows.groupBy(*keys, "date_hour").agg(*sums, F.count("*").alias("rows"))
    ranges = {"today": timedelta(0), "last_week": timedelta(days=spec.lookback_days)}
    lag = {"today": timedelta(0), "last_week": timedelta(hours=spec.lag_hours)}
    held = None
    for number, side in enumerate(SIDES):
        own = by_hour.select("*", F.explode(_numbers(spec, step, count, ranges[side], lag[side])).alias("number"))
        own = own.withColumn("is_today", F.lit(number == 0))
        held = own if held is None else held.union(own)
    sides = {"today": F.col("is_today"), "last_week": ~F.col("is_today")}
    columns = [F.sum(F.when(sides[s], F.col(m))).alias(f"{m}_{s}") for m in ALL for s in SIDES]
    counts = [F.coalesce(F.sum(F.when(sides[s], F.col("rows"))), F.lit(0)).alias(f"rows_{s}") for s in SIDES]
    seconds = int(step.total_seconds())
    as_of = F.expr(f"timestamp_ntz'{spec.as_of}' + number * interval '1' second * {seconds}L")
    found = held.groupBy("number", *keys).agg(*columns, *counts)
    return found.select(as_of.alias("as_of"), *(c for c in found.columns if c != "number"))


def _numbers(spec: ReportSpec, step: timedelta, count: int, back: timedelta, lag: timedelta) -> Column:
    """The numbers of the reports of whose period this hour is.

    The period of time t goes from the midnight before t - `back` to t - `back` - `lag`. So t is no earlier
    than the hour plus both, and before the midnight that follows the hour plus `back`.
    """
    first_day, micros = spec.as_of.date(), step // timedelta(microseconds=1)
    day = F.datediff(F.to_date("date_hour"), F.lit(first_day)).cast("long") * DAY_MICROS + _micros(back)
    within = F.expr(
        "(hour(date_hour) * 3600 + minute(date_hour) * 60) * 1000000L + cast(extract(SECOND FROM date_hour) * 1000000 AS bigint)"
    )
    start = (spec.as_of - datetime.combine(first_day, datetime.min.time())) // timedelta(microseconds=1)
    low = _ceiling(day + within + _micros(lag) - start, micros)
    high = _ceiling(day + DAY_MICROS - start, micros) - 1
    low, high = F.greatest(low, F.lit(0).cast("long")), F.least(high, F.lit(count - 1).cast("long"))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _micros(time: timedelta) -> int:
    return time // timedelta(microseconds=1)


def _ceiling(value: Column, by: int) -> Column:
    """Of exact whole numbers, also negative ones."""
    return F.call_function("div", value + F.pmod(-value, F.lit(by).cast("long")), F.lit(by).cast("long"))
