"""Results by hour of the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpulse.functions.clock import hour_in_zone, shift_hour
from weekpulse.operators.measures import ALL, both_sides
from weekpulse.spec import ReportSpec

SERIES = {"today": "Today", "last_week": "Last Week"}


def new_devices(sums: DataFrame) -> DataFrame:
    """Here a missing sum shows: rows of the other period count as 0, NULL values as nothing."""

    def side(here: str, other: str) -> Column:
        zero = F.when(F.col(f"rows_{other}") > 0, F.lit(0))
        name = f"new_devices_{here}"
        return F.coalesce(F.col(name), zero).cast("bigint").alias(name)

    columns = [side("today", "last_week"), side("last_week", "today")]
    return sums.select("hour_of_day", *columns).orderBy("hour_of_day")


def series(sums: DataFrame, spec: ReportSpec, zone: str | None = None) -> DataFrame:
    """Two lines per metric. Hours without a value are left out; only today's line is cut."""
    cut = F.lit(spec.today_cut_hour) if zone is None else hour_in_zone(spec.as_of, zone)
    points = [
        F.struct(
            F.lit(m).alias("metric"),
            F.lit(label).alias("series"),
            F.col("hour_of_day"),
            F.col(f"{m}_{side}").cast("double").alias("value"),
        )
        for m in ALL
        for side, label in SERIES.items()
    ]
    lines = sums.select(F.inline(F.array(*points)))
    uncut = (F.col("series") != SERIES["today"]) | (F.col("hour_of_day") <= cut)
    return lines.filter((F.col("value") > 0) & uncut).orderBy("metric", "series", "hour_of_day")


def shifted(sums: DataFrame, by: int) -> DataFrame:
    return sums.select(
        shift_hour(F.col("hour_of_day"), by).alias("hour_shifted"), *both_sides(["revenue"])
    ).orderBy("hour_shifted")
