"""The measures of the fact table and how their columns are named in results."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result prefix -> fact column.
FACT_COLUMN = {
    "revenue": "revenue",
    "notif": "notification_shown",
    "exp": "experience_shown",
    "install": "install_success",
    "new_devices": "new_devices",
}
ALL = tuple(FACT_COLUMN)
MAIN = ("revenue", "notif", "exp", "install")
SIDES = ("today", "last_week")


def result_type(metric: str) -> str:
    return "double" if metric == "revenue" else "bigint"


def filled(metric: str, side: str) -> Column:
    """A sum with nothing in it is 0. Still exact: revenue turns double in `output` only."""
    return F.coalesce(F.col(f"{metric}_{side}"), F.lit(0))


def output(value: Column, metric: str, name: str) -> Column:
    return value.cast(result_type(metric)).alias(name)


def both_sides(metrics: Iterable[str]) -> list[Column]:
    return [output(filled(m, side), m, f"{m}_{side}") for m in metrics for side in SIDES]


def compared(metrics: Iterable[str], percent: Callable[[Column, Column], Column]) -> list[Column]:
    """Today, last week, difference and percent change of each metric."""
    columns = []
    for m in metrics:
        now, before = filled(m, "today"), filled(m, "last_week")
        columns += [
            output(now, m, f"{m}_today"),
            output(before, m, f"{m}_last_week"),
            output(now - before, m, f"{m}_diff"),
            percent(now, before).alias(f"{m}_pct_diff"),
        ]
    return columns
