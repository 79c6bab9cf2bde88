"""Times and hours of the day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value: datetime) -> Column:
    """A timestamp without zone; folded to a literal, so that filters on it reach the scan."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def start_of_hour(time: Column) -> Column:
    """Stays without a zone, unlike `date_trunc`, so the session's zone plays no part."""
    midnight = F.to_date(time).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(hours=F.hour(time))


def hour_of_day(time: Column) -> Column:
    return F.hour(time)


def shift_hour(hour: Column, by: int) -> Column:
    return F.pmod(hour + F.lit(by), F.lit(24)).cast("int")


def hour_in_zone(utc: datetime, zone: str) -> Column:
    """The hour of a UTC wall-clock time in `zone`, with its daylight saving rules."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), moment(utc)))
