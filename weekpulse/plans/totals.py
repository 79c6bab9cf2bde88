"""Totals, breakdowns and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpulse.functions import display, percent
from weekpulse.functions.ratios import cost_per_install, revenue_per_user
from weekpulse.operators.measures import ALL, SIDES, filled, output

BAR_COLUMNS = ["revenue_today", "revenue_last_week"]


def new_devices(sums: DataFrame) -> DataFrame:
    now, before = filled("new_devices", "today"), filled("new_devices", "last_week")
    return sums.select(
        now.alias("new_devices_today"),
        before.alias("new_devices_last_week"),
        percent.difference(now, before).alias("new_devices_diff"),
        percent.positive_base(now, before).alias("new_devices_pct_diff"),
    )


def breakdown(sums: DataFrame, key: str) -> DataFrame:
    wanted = [("revenue", "today"), ("revenue", "last_week")]
    wanted += [(m, "today") for m in ("notif", "exp", "install")]
    return sums.select(key, *[output(filled(m, s), m, f"{m}_{s}") for m, s in wanted])


def revenue_bars(by_key: DataFrame, key: str) -> DataFrame:
    """Wide to long: one row per key and period."""
    return by_key.unpivot(key, BAR_COLUMNS, "variable", "value")


def percent_rules(sums: DataFrame) -> DataFrame:
    """Revenue under each percent rule, side by side."""
    now, before = filled("revenue", "today"), filled("revenue", "last_week")
    return sums.select(
        "brand",
        "feature",
        percent.rounded(now, before).alias("pct_sql"),
        percent.zero_filled(now, before).alias("pct_zero_filled"),
        percent.positive_base(now, before).alias("pct_guarded"),
        percent.nonzero_base(now, before).alias("pct_nonzero"),
        percent.plain_ratio(now, before).alias("pct_ratio"),
    )


def kpis(sums: DataFrame) -> DataFrame:
    """Totals of all measures with unit values and percent changes, in one row."""
    columns = []
    for m in ALL:
        now, before = filled(m, "today"), filled(m, "last_week")
        columns += [
            output(now, m, f"{m}_today"),
            output(before, m, f"{m}_last_week"),
            percent.positive_base(now, before).alias(f"{m}_delta_pct"),
        ]
    for name, unit_value, units in (
        ("ecpi", cost_per_install, "install"),
        ("rpu", revenue_per_user, "exp"),
    ):
        now, before = (unit_value(filled("revenue", s), filled(units, s)) for s in SIDES)
        columns += [
            now.alias(f"{name}_today"),
            before.alias(f"{name}_last_week"),
            percent.positive_base(now, before).alias(f"{name}_delta_pct"),
        ]
    return sums.select(*columns)


def kpis_as_text(kpi_row: DataFrame) -> DataFrame:
    """One row per key figure, in the order they are shown."""
    shown = [
        ("Revenue", "revenue", display.money(F.col("revenue_today"))),
        ("Notifications", "notif", display.count(F.col("notif_today"))),
        ("Experiences", "exp", display.count(F.col("exp_today"))),
        ("Installs", "install", display.count(F.col("install_today"))),
        ("New Devices", "new_devices", display.count(F.col("new_devices_today"))),
        ("eCPI", "ecpi", display.money(F.col("ecpi_today"), display.MILLS)),
        ("RPU", "rpu", display.money(F.col("rpu_today"), display.TENTH_OF_MILLS)),
    ]
    lines = [
        F.struct(
            F.lit(label).alias("kpi"),
            value.alias("value_text"),
            display.percent_change(F.col(f"{name}_delta_pct")).alias("delta_text"),
        )
        for label, name, value in shown
    ]
    return kpi_row.select(F.inline(F.array(*lines)))
