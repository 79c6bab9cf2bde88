"""Which fact rows a report reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpulse.functions.clock import moment
from weekpulse.spec import Period, ReportSpec


def one_of(column: str, values: Sequence[str]) -> Column:
    """NULL keys never pass, with or without a list."""
    return F.col(column).isin(list(values)) if values else F.col(column).isNotNull()


def within(column: str, period: Period) -> Column:
    return (F.col(column) >= moment(period.start)) & (F.col(column) <= moment(period.end))


def selected(fact: DataFrame, spec: ReportSpec) -> DataFrame:
    """Brand, feature and source selection; no source predicate keeps rows without a source."""
    rows = fact.filter(one_of("brand", spec.selected_brands) & one_of("feature", spec.selected_features))
    if spec.selected_source is not None:
        rows = rows.filter(F.col("source") == spec.selected_source)
    return rows


def in_period(fact: DataFrame, spec: ReportSpec, period: Period) -> DataFrame:
    return selected(fact, spec).filter(within("date_hour", period))


def in_either_period(fact: DataFrame, spec: ReportSpec) -> DataFrame:
    """Both periods in one scan. They never overlap, so a row belongs to exactly one."""
    return selected(fact, spec).filter(
        within("date_hour", spec.today) | within("date_hour", spec.last_week)
    )
