"""Both periods summed apart and put side by side by a full outer join.

Same rows as `period_sums`, at the price of a second scan; both sides are already partitioned on
the join keys by their aggregation, so the join itself shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpulse.functions.clock import hour_of_day
from weekpulse.operators.measures import ALL, FACT_COLUMN
from weekpulse.operators.rows import in_period
from weekpulse.spec import Period, ReportSpec


def joined_period_sums(fact: DataFrame, spec: ReportSpec, keys: tuple[str, ...]) -> DataFrame:
    now = _one_period(fact, spec, spec.today, keys, "today")
    before = _one_period(fact, spec, spec.last_week, keys, "last_week")
    return now.join(before, list(keys), "full_outer")


def _one_period(
    fact: DataFrame, spec: ReportSpec, period: Period, keys: tuple[str, ...], side: str
) -> DataFrame:
    rows = in_period(fact, spec, period).withColumn("hour_of_day", hour_of_day(F.col("date_hour")))
    return rows.groupBy(*keys).agg(*[F.sum(FACT_COLUMN[m]).alias(f"{m}_{side}") for m in ALL])
