"""Small fact tables with known answers."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from weekpulse.sources.fact import FACT_SCHEMA
from weekpulse.spec import ReportSpec

AS_OF = datetime(2024, 1, 15, 14, 30)
TODAY = datetime(2024, 1, 15, 9)
LAST_WEEK = datetime(2024, 1, 8, 9)
SPEC = ReportSpec(as_of=AS_OF)


def row(
    at: datetime,
    brand: str | None = "a",
    feature: str | None = "f",
    source: str | None = "FOTA",
    revenue: str | None = "0",
    notif: int | None = 0,
    exp: int | None = 0,
    install: int | None = 0,
    devices: int | None = 0,
) -> tuple:
    money = None if revenue is None else Decimal(revenue)
    return (brand, feature, source, at, money, notif, exp, install, devices)


def fact(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), FACT_SCHEMA)
