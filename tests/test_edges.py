"""Hand-made rows with literal expected results."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from tests.facts import AS_OF, LAST_WEEK, SPEC, TODAY, fact, row
from weekpulse import Report, ReportSpec

SECOND = timedelta(seconds=1)


def summary_row(spark, *rows, spec=SPEC):
    (found,) = Report(fact(spark, *rows), spec).summary().collect()
    return found


@pytest.mark.parametrize(
    "at, today, last_week",
    [
        (datetime(2024, 1, 15), 1, 0),
        (datetime(2024, 1, 15) - SECOND, 0, 0),
        (AS_OF, 1, 0),
        (AS_OF + SECOND, 0, 0),
        (datetime(2024, 1, 8), 0, 1),
        (datetime(2024, 1, 8) - SECOND, 0, 0),
        (datetime(2024, 1, 8, 12, 30), 0, 1),
        (datetime(2024, 1, 8, 12, 30) + SECOND, 0, 0),
    ],
)
def test_period_edges(spark, at, today, last_week):
    for sums in (Report.summary, Report.summary_by_join):
        report = Report(fact(spark, row(at, notif=1)), SPEC)
        found = [(r.notif_today, r.notif_last_week) for r in sums(report).collect()]
        assert found == ([(today, last_week)] if today + last_week else [])


def test_before_two_last_week_is_empty(spark):
    spec = replace(SPEC, as_of=datetime(2024, 1, 15, 1, 30))
    at = datetime(2024, 1, 15, 1)
    rows = [row(at, notif=3), row(datetime(2024, 1, 8), notif=4), row(datetime(2024, 1, 8, 1), notif=4)]
    found = summary_row(spark, *rows, spec=spec)
    assert (found.notif_today, found.notif_last_week, found.notif_pct_diff) == (3, 0, None)
    assert spec.last_week.empty


def test_at_two_last_week_is_its_midnight(spark):
    spec = replace(SPEC, as_of=datetime(2024, 1, 15, 2))
    found = summary_row(spark, row(datetime(2024, 1, 8), notif=4), spec=spec)
    assert found.notif_last_week == 4


def test_without_lag_the_same_part_of_the_day(spark):
    spec = replace(SPEC, lag_hours=0)
    found = summary_row(spark, row(datetime(2024, 1, 8, 14), notif=4), spec=spec)
    assert found.notif_last_week == 4


def test_keys_of_one_side(spark):
    rows = [row(TODAY, brand="now", revenue="2.50"), row(LAST_WEEK, brand="then", revenue="4.00")]
    found = {r.brand: r for r in Report(fact(spark, *rows), SPEC).summary().collect()}
    assert (found["now"].revenue_today, found["now"].revenue_last_week) == (2.5, 0.0)
    assert (found["now"].revenue_diff, found["now"].revenue_pct_diff) == (2.5, None)
    assert (found["then"].revenue_today, found["then"].revenue_last_week) == (0.0, 4.0)
    assert (found["then"].revenue_diff, found["then"].revenue_pct_diff) == (-4.0, -100.0)


@pytest.mark.parametrize(
    "now, before, wanted",
    [
        ("3", "-2", (None, -250.0, 0.0, -250.0, -250.0)),
        ("0", "0", (None, 0.0, 0.0, None, None)),
        ("5", "0", (None, 0.0, 0.0, None, None)),
        ("3", "2", (50.0, 50.0, 50.0, 50.0, 50.0)),
        ("1", "8", (-87.5, -87.5, -87.5, -87.5, -87.5)),
    ],
)
def test_percent_rules(spark, now, before, wanted):
    report = Report(fact(spark, row(TODAY, revenue=now), row(LAST_WEEK, revenue=before)), SPEC)
    (found,) = report.percent_rules().collect()
    assert tuple(found)[2:] == wanted


@pytest.mark.parametrize(
    "now, wanted", [("112.25", 12.3), ("97.75", -2.3), ("101.05", 1.1), ("133.35", 33.4)]
)
def test_summary_percent_rounds_half_up(spark, now, wanted):
    found = summary_row(spark, row(TODAY, revenue=now), row(LAST_WEEK, revenue="100"))
    assert found.revenue_pct_diff == wanted


def test_whole_numbers_divide_truly(spark):
    found = summary_row(spark, row(TODAY, notif=4), row(LAST_WEEK, notif=3))
    assert found.notif_pct_diff == 33.3


def test_missing_measures(spark):
    nothing = dict(revenue=None, notif=None, exp=None, install=None, devices=None)
    report = Report(fact(spark, row(TODAY, **nothing)), SPEC)
    (found,) = report.summary().collect()
    assert (found.revenue_today, found.notif_today, found.exp_last_week) == (0.0, 0, 0)
    assert tuple(report.new_devices_totals().collect()[0]) == (0, 0, 0, 0.0)
    # A row of one period only: its own missing sum shows, the other is 0.
    assert [tuple(r) for r in report.new_devices_hourly().collect()] == [(9, None, 0)]


def test_missing_new_devices_by_hour(spark):
    rows = [
        row(TODAY.replace(hour=3), devices=None),
        row(LAST_WEEK.replace(hour=3), devices=None),
        row(LAST_WEEK.replace(hour=4), devices=None),
        row(LAST_WEEK.replace(hour=5), devices=7),
        row(TODAY.replace(hour=6), devices=None),
        row(TODAY.replace(hour=6), devices=2),
    ]
    wanted = [(3, 0, 0), (4, 0, None), (5, 0, 7), (6, 2, 0)]
    for report in (Report(fact(spark, *rows), SPEC), Report(fact(spark, *rows), SPEC).cache()):
        assert [tuple(r) for r in report.new_devices_hourly().collect()] == wanted
        report.close()


SELECTABLE = [
    row(TODAY, brand="Abc", source="FOTA", notif=1),
    row(TODAY, brand="abc", source="pre-install", notif=10),
    row(TODAY, brand=None, notif=100),
    row(TODAY, brand="other", source=None, notif=1000),
    row(TODAY, brand="abc", feature=None, notif=10000),
]


@pytest.mark.parametrize(
    "changes, wanted",
    [
        ({}, {"Abc": 1, "abc": 10, "other": 1000}),
        ({"brands": ("abc",)}, {"abc": 10}),
        ({"known_brands": ("Abc", "other")}, {"Abc": 1, "other": 1000}),
        ({"known_brands": ("Abc", "other"), "brands": ("Abc",)}, {"Abc": 1}),
        ({"features": ("g",)}, {}),
        ({"source": "FOTA"}, {"Abc": 1}),
        ({"source": "All"}, {"Abc": 1, "abc": 10, "other": 1000}),
        ({"source": ""}, {"Abc": 1, "abc": 10, "other": 1000}),
        ({"brands": ("a'b",)}, {}),
    ],
)
def test_selection(spark, changes, wanted):
    report = Report(fact(spark, *SELECTABLE), replace(SPEC, **changes))
    assert {r.brand: r.notif_today for r in report.summary().collect()} == wanted


def test_ties_go_to_the_earliest_hour_and_first_feature(spark):
    rows = [
        row(TODAY.replace(hour=8), feature="b", notif=5, revenue="3"),
        row(TODAY.replace(hour=7), feature="a", notif=5, revenue="3"),
        row(TODAY.replace(hour=6), feature="c", notif=4, revenue="2"),
    ]
    report = Report(fact(spark, *rows), SPEC)
    assert [tuple(r) for r in report.peak_hour().collect()] == [(7, 5)]
    assert [tuple(r) for r in report.top_feature().collect()] == [("a", 3.0)]
    assert [(r.kind, r.value) for r in report.insights().collect()] == [("peak_hour", 5.0), ("top_feature", 3.0)]


def test_empty_input(spark):
    spec = replace(SPEC, known_brands=("a", "b"), known_features=("f",))
    report = Report(fact(spark), spec)
    zeros = report.kpi_totals().collect()
    assert len(zeros) == 1 and set(zeros[0]) == {0}
    assert tuple(report.new_devices_totals().collect()[0]) == (0, 0, 0, 0.0)
    assert tuple(report.data_summary().collect()[0]) == (0, 0, 0)
    for empty in (
        report.summary(), report.summary_by_join(), report.hourly(), report.hourly_by_join(),
        report.combined(), report.hourly_combined(), report.by_brand(), report.by_feature_long(),
        report.hourly_series(), report.new_devices_hourly(), report.peak_hour(), report.top_feature(),
        report.insights(), report.dimension_values(), report.summary_with_totals(), report.display(),
    ):
        assert empty.count() == 0
    assert [tuple(r)[:4] for r in report.grid().orderBy("brand").collect()] == [
        ("a", "f", 0.0, 0.0), ("b", "f", 0.0, 0.0)
    ]
    assert len(report.kpi_display().collect()) == 7
    assert [tuple(r) for r in report.multi_grain().collect()] == [(None, None, "total", *(0.0, 0.0), *[0] * 6)]


def test_insights_wording(spark):
    rows = [
        row(TODAY, revenue="1250.00", notif=1234, devices=100, feature="alpha"),
        row(LAST_WEEK, revenue="1000.00", devices=200, feature="beta"),
    ]
    found = [tuple(r) for r in Report(fact(spark, *rows), SPEC).insights().collect()]
    assert found == [
        (1, "revenue_swing", 1250.0, 25.0, "🔥 Revenue +25.0% vs last week - Great performance!"),
        (2, "peak_hour", 1234.0, None, "📊 Peak hour today: 9:00 (1,234 notifications)"),
        (3, "new_devices_swing", 100.0, -50.0, "📉 New Devices -50.0% - 100 today"),
        (4, "top_feature", 1250.0, None, "⭐ Top feature: alpha ($1,250.00)"),
    ]


@pytest.mark.parametrize("now, shown", [("120", False), ("120.01", True), ("80", False), ("79.99", True)])
def test_revenue_swing_needs_more_than_twenty(spark, now, shown):
    rows = [row(TODAY, revenue=now), row(LAST_WEEK, revenue="100")]
    found = Report(fact(spark, *rows), SPEC).insights().collect()
    assert ("revenue_swing" in [r.kind for r in found]) == shown
    if now == "79.99":
        assert found[0].message == "⚠️ Revenue -20.0% vs last week - Needs attention"


@pytest.mark.parametrize("now, before, shown", [(110, 100, False), (111, 100, True), (0, 100, False), (5, 0, False)])
def test_new_device_swing(spark, now, before, shown):
    rows = [row(TODAY, devices=now), row(LAST_WEEK, devices=before)]
    kinds = [r.kind for r in Report(fact(spark, *rows), SPEC).insights().collect()]
    assert ("new_devices_swing" in kinds) == shown


def test_series_cut(spark):
    rows = [
        row(TODAY.replace(hour=2), notif=1),
        row(TODAY.replace(hour=10), notif=2),
        row(LAST_WEEK.replace(hour=11), notif=3),
        row(TODAY.replace(hour=12), notif=0),
        row(TODAY.replace(hour=1), notif=-4),
    ]

    def lines(zone=None, **changes):
        report = Report(fact(spark, *rows), replace(SPEC, **changes))
        return [(r.metric, r.series, r.hour_of_day, r.value) for r in report.hourly_series(zone).collect()]

    last = ("notif", "Last Week", 11, 3.0)
    full = [last, ("notif", "Today", 2, 1.0), ("notif", "Today", 10, 2.0)]
    assert lines() == full
    assert lines(cut_hour=9) == full[:2]
    assert lines(cut_hour=1) == [last]
    assert lines(zone="Asia/Jerusalem") == full
    # 22:30 UTC is past midnight in the zone: only its first hour is left of today.
    late = datetime(2024, 1, 15, 22, 30)
    assert lines(zone="Asia/Jerusalem", as_of=late) == [last]
    assert lines(zone="UTC", as_of=late) == full


def test_shifted_hours_wrap(spark):
    rows = [row(TODAY.replace(hour=h), revenue="1") for h in (0, 9, 14)]
    report = Report(fact(spark, *rows), replace(SPEC, as_of=datetime(2024, 1, 15, 23)))
    assert [r.hour_shifted for r in report.hourly_shifted(12).collect()] == [2, 12, 21]
    assert [r.hour_shifted for r in report.hourly_shifted(-1).collect()] == [8, 13, 23]


def test_combining(spark):
    rows = [row(TODAY, brand="a", notif=3), row(LAST_WEEK, brand="b", notif=2), row(TODAY, brand="c", exp=1)]
    report = Report(fact(spark, *rows), replace(SPEC, brands=("a", "b", "never seen")))
    (found,) = report.combined().collect()
    assert (found.feature, found.brand) == ("f", "Combined (3 brands)")
    assert (found.notif_today, found.notif_last_week, found.notif_pct_diff) == (3, 2, 50.0)
    assert (found.exp_today, found.exp_pct_diff) == (0, 0.0)
    alone = Report(fact(spark, *rows), replace(SPEC, brands=("a",)))
    assert alone.combined().collect() == alone.summary().collect()
    several = Report(fact(spark, *rows), replace(SPEC, brands=("a", "b"))).hourly_combined()
    assert alone.hourly_combined().dtypes == several.dtypes
    assert [tuple(r)[:3] for r in alone.hourly_combined().collect()] == [("f", 9, "a")]
    with_totals = report.combined_with_totals().collect()
    assert [(r.feature, r.notif_today, r.new_devices_today) for r in with_totals] == [("f", 3, 0)]
    with pytest.raises(ValueError):
        Report(fact(spark, *rows), SPEC).combined()


@pytest.mark.parametrize(
    "changes",
    [
        {"lag_hours": -1},
        {"lookback_days": 0},
        {"cut_hour": 24},
        {"brands": "one"},
        {"as_of": datetime.fromisoformat("2024-01-15T14:30:00+00:00")},
    ],
)
def test_bad_specs(changes):
    with pytest.raises(ValueError):
        ReportSpec(**{"as_of": AS_OF, **changes})


def test_grid_needs_lists(spark):
    with pytest.raises(ValueError):
        Report(fact(spark), SPEC).grid()
