"""What a report is asked for: one pinned time, the selection and the comparison rules."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL_SOURCES = "All"
READ_FOR = "read_for"


class Period(NamedTuple):
    """A time range closed on both ends; empty when it ends before it starts."""

    start: datetime
    end: datetime

    @property
    def empty(self) -> bool:
        return self.end < self.start


@dataclass(frozen=True)
class ReportSpec:
    """Every result of a report is computed for the same `as_of`.

    `as_of` is a wall-clock time on the clock of the fact table's `date_hour`.
    An empty selection means all known values; with none known, all but NULL.
    """

    as_of: datetime
    brands: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    source: str | None = None
    known_brands: tuple[str, ...] = ()
    known_features: tuple[str, ...] = ()
    lookback_days: int = 7
    lag_hours: int = 2
    cut_hour: int | None = None

    def __post_init__(self) -> None:
        if self.as_of.tzinfo is not None:
            raise ValueError("as_of must be a wall-clock time without a zone")
        if self.lookback_days < 1:
            raise ValueError("lookback_days must be at least 1")
        if self.lag_hours < 0:
            raise ValueError("lag_hours must not be negative")
        if self.cut_hour is not None and not 0 <= self.cut_hour <= 23:
            raise ValueError("cut_hour must be an hour of the day")
        for name in ("brands", "features", "known_brands", "known_features"):
            value = getattr(self, name)
            if isinstance(value, str):
                raise ValueError(f"{name} must be a list of values")
            object.__setattr__(self, name, tuple(value))

    @property
    def today(self) -> Period:
        return Period(_midnight(self.as_of), self.as_of)

    @property
    def last_week(self) -> Period:
        """The lag shortens this side only: its newest hours were already complete."""
        then = self.as_of - timedelta(days=self.lookback_days)
        return Period(_midnight(then), then - timedelta(hours=self.lag_hours))

    @property
    def periods(self) -> tuple[Period, Period]:
        return self.today, self.last_week

    @property
    def selected_brands(self) -> tuple[str, ...]:
        return self.brands or self.known_brands

    @property
    def selected_features(self) -> tuple[str, ...]:
        return self.features or self.known_features

    @property
    def selected_source(self) -> str | None:
        return None if self.source in (None, "", ALL_SOURCES) else self.source

    @property
    def today_cut_hour(self) -> int:
        return self.as_of.hour if self.cut_hour is None else self.cut_hour

    def at(self, as_of: datetime) -> ReportSpec:
        return replace(self, as_of=as_of)


def read_for(fact: DataFrame, spec: ReportSpec) -> DataFrame:
    """Notes with the rows which periods they were read for."""
    periods = [f"{p.start.isoformat()}/{p.end.isoformat()}" for p in spec.periods if not p.empty]
    return fact.withColumn("date_hour", F.col("date_hour").alias("date_hour", metadata={READ_FOR: periods}))


def check_read_for(fact: DataFrame, spec: ReportSpec) -> None:
    """Rows read for other periods would give a report without them, and no error."""
    if "date_hour" not in fact.columns or READ_FOR not in fact.schema["date_hour"].metadata:
        return
    read = [[datetime.fromisoformat(x) for x in p.split("/")] for p in fact.schema["date_hour"].metadata[READ_FOR]]
    for period in spec.periods:
        if not period.empty and not any(start <= period.start and period.end <= end for start, end in read):
            raise ValueError(f"rows were not read for {period.start} to {period.end}")


def _midnight(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)
