"""What stands out: swings, the peak hour and the top feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpulse.functions import percent
from weekpulse.functions.display import COUNT, MONEY, formatted
from weekpulse.operators.measures import filled
from weekpulse.operators.period_sums import add_up_sets

# The thresholds in percent and the wording of the messages.
REVENUE_SWING = 20
NEW_DEVICES_SWING = 10
REVENUE_MESSAGE = "%s Revenue %s vs last week - %s"
REVENUE_UP = ("🔥", "Great performance!")
REVENUE_DOWN = ("⚠️", "Needs attention")
PEAK_MESSAGE = "📊 Peak hour today: %s:00 (%s notifications)"
NEW_DEVICES_MESSAGE = "%s New Devices %s - %s today"
NEW_DEVICES_UP = "📈"
NEW_DEVICES_DOWN = "📉"
TOP_MESSAGE = "⭐ Top feature: %s ($%s)"
TENTH = "0.0"


def peak_hour(sums: DataFrame) -> DataFrame:
    """The hour with most notifications today; the earliest of equals. No rows, no peak."""
    best = sums.agg(F.max(_peak_order()).alias("best"))
    return best.filter(F.col("best").isNotNull()).select(
        _peak_hour("best").alias("hour_of_day"), F.col("best.notif").alias("notif_today")
    )


def top_feature(sums: DataFrame) -> DataFrame:
    """The feature with most revenue today; the alphabetically first of equals."""
    revenue = filled("revenue", "today")
    ranked = sums.select("feature", revenue.alias("revenue_today"))
    best = ranked.orderBy(F.desc("revenue_today"), F.asc("feature")).limit(1)
    return best.select("feature", F.col("revenue_today").cast("double"))


def insights(sums: DataFrame) -> DataFrame:
    """All insights from sums by feature and hour: totals, hours and features in one pass."""
    keys = ("feature", "hour_of_day")
    grains = add_up_sets(sums, [("feature",), ("hour_of_day",), ()], keys)
    # A bit of grain_id is set for a key summed over: the feature is the higher one.
    by_feature, by_hour, total = (F.col("grain_id") == n for n in (1, 2, 3))
    picked = grains.agg(
        F.max(F.when(total, F.struct(*_totals()))).alias("total"),
        F.max(F.when(by_hour, _peak_order())).alias("peak"),
        F.min(F.when(by_feature, _top_order())).alias("top"),
    ).select("*", *_changes())
    lines = F.array(_revenue_line(), _peak_line(), _new_devices_line(), _top_line())
    # Each line is NULL when it has nothing to say.
    return picked.select(F.inline(F.filter(lines, lambda line: line.isNotNull())))


def _totals() -> list[Column]:
    return [
        filled(m, s).alias(f"{m}_{s}")
        for m in ("revenue", "new_devices")
        for s in ("today", "last_week")
    ]


def _peak_order() -> Column:
    return F.struct(
        filled("notif", "today").alias("notif"), (-F.col("hour_of_day")).alias("minus_hour")
    )


def _peak_hour(best: str) -> Column:
    return -F.col(f"{best}.minus_hour")


def _top_order() -> Column:
    return F.struct((-filled("revenue", "today")).alias("minus_revenue"), F.col("feature"))


def _changes() -> list[Column]:
    return [
        percent.positive_base(F.col(f"total.{m}_today"), F.col(f"total.{m}_last_week")).alias(
            f"{m}_change"
        )
        for m in ("revenue", "new_devices")
    ]


def _line(rank: int, kind: str, value: Column, change: Column, message: Column) -> Column:
    return F.struct(
        F.lit(rank).alias("rank"),
        F.lit(kind).alias("kind"),
        value.cast("double").alias("value"),
        change.cast("double").alias("change_pct"),
        message.alias("message"),
    )


def _signed(change: Column) -> Column:
    sign = F.when(change > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, formatted(change, TENTH), F.lit("%"))


def _up_down(change: Column, up: str, down: str) -> Column:
    return F.when(change > 0, F.lit(up)).otherwise(F.lit(down))


def _revenue_line() -> Column:
    change = F.col("revenue_change")
    mark, verdict = (_up_down(change, *pair) for pair in zip(REVENUE_UP, REVENUE_DOWN))
    message = F.format_string(REVENUE_MESSAGE, mark, _signed(change), verdict)
    line = _line(1, "revenue_swing", F.col("total.revenue_today"), change, message)
    return F.when(F.abs(change) > REVENUE_SWING, line)


def _peak_line() -> Column:
    value = F.col("peak.notif")
    message = F.format_string(PEAK_MESSAGE, _peak_hour("peak"), formatted(value, COUNT))
    line = _line(2, "peak_hour", value, F.lit(None), message)
    return F.when(F.col("peak").isNotNull(), line)


def _new_devices_line() -> Column:
    value, change = F.col("total.new_devices_today"), F.col("new_devices_change")
    mark = _up_down(change, NEW_DEVICES_UP, NEW_DEVICES_DOWN)
    message = F.format_string(NEW_DEVICES_MESSAGE, mark, _signed(change), formatted(value, COUNT))
    line = _line(3, "new_devices_swing", value, change, message)
    return F.when((value > 0) & (F.abs(change) > NEW_DEVICES_SWING), line)


def _top_line() -> Column:
    value = -F.col("top.minus_revenue")
    message = F.format_string(TOP_MESSAGE, F.col("top.feature"), formatted(value, MONEY))
    line = _line(4, "top_feature", value, F.lit(None), message)
    return F.when(F.col("top").isNotNull(), line)
