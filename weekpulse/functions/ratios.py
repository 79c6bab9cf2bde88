"""Unit values of a period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def per_unit(amount: Column, units: Column) -> Column:
    return F.when(units > 0, amount.cast("double") / units.cast("double")).otherwise(F.lit(0.0))


def cost_per_install(revenue: Column, installs: Column) -> Column:
    return per_unit(revenue, installs)


def revenue_per_user(revenue: Column, experiences: Column) -> Column:
    return per_unit(revenue, experiences)
