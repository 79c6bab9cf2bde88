"""Sums of both periods at any grain, from one scan and one shuffle.

Selecting the rows of both periods and summing each side by condition gives exactly the rows of a
full outer join of the two periods: a key has a row in either period if and only if it passes the
filter. Sums stay NULL when nothing was added, and the row counts stay beside them, so that finer
sums can be added up to any coarser grain without losing what was missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpulse.functions.clock import hour_of_day, moment
from weekpulse.operators.measures import ALL, FACT_COLUMN, SIDES
from weekpulse.operators.rows import in_either_period
from weekpulse.spec import ReportSpec

CUBE_KEYS = ("brand", "feature", "hour_of_day")


def period_sums(fact: DataFrame, spec: ReportSpec, keys: tuple[str, ...]) -> DataFrame:
    """A hot key costs nothing extra: each task sends at most one partial sum per key."""
    rows = in_either_period(fact, spec).select(
        "*",
        hour_of_day(F.col("date_hour")).alias("hour_of_day"),
        # The row is in one of the two periods, so one comparison tells which.
        (F.col("date_hour") >= moment(spec.today.start)).alias("is_today"),
    )
    side = {"today": F.col("is_today"), "last_week": ~F.col("is_today")}
    sums = [
        F.sum(F.when(side[s], F.col(FACT_COLUMN[m]))).alias(f"{m}_{s}") for m in ALL for s in SIDES
    ]
    counts = [F.count_if(side[s]).alias(f"rows_{s}") for s in SIDES]
    return rows.groupBy(*keys).agg(*sums, *counts)


def add_up(sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return sums.groupBy(*keys).agg(*summed())


def add_up_sets(sums: DataFrame, sets: list[tuple[str, ...]], keys: tuple[str, ...]) -> DataFrame:
    """Several coarser grains at once; `grain_id` has a bit set for each key summed over."""
    grouped = sums.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id().cast("int").alias("grain_id"), *summed())


def summed() -> list:
    names = [f"{m}_{s}" for m in ALL for s in SIDES] + [f"rows_{s}" for s in SIDES]
    return [F.sum(n).alias(n) for n in names]
