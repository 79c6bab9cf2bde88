"""Kept reports: how long, and what refreshing does."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from tests.facts import SPEC, TODAY, fact, row
from tests.plans import planned
from weekpulse import Report
from weekpulse.plans.cache import ReportCache


def test_cached_cube_is_read_and_dropped(spark):
    report = Report(fact(spark, row(TODAY, notif=2)), SPEC).cache()
    assert report.cache() is report
    assert "InMemoryTableScan" in planned(report.by_brand())
    assert report.by_brand().first().notif_today == 2
    report.close()
    assert "InMemoryTableScan" not in planned(report.by_brand())


def test_refresh_moves_on(spark):
    rows = fact(spark, row(TODAY, notif=2), row(TODAY.replace(hour=15), notif=3))
    report = Report(rows, SPEC).cache()
    later = report.refresh(rows, SPEC.as_of + timedelta(hours=1))
    assert report.kpi_totals().first().notif_today == 2
    assert later.kpi_totals().first().notif_today == 5
    assert "InMemoryTableScan" in planned(later.by_brand())
    assert later.refresh(fact(spark), SPEC.as_of).kpi_totals().first().notif_today == 0
    spark.catalog.clearCache()


def test_reports_are_kept_for_their_time(spark):
    loads, now = [], [0.0]

    def load(spec):
        loads.append(spec)
        return fact(spark, row(TODAY, notif=len(loads)))

    cache = ReportCache(load, ttl_seconds=300, clock=lambda: now[0])
    first = cache.get(SPEC)
    now[0] = 299.0
    # Still the kept report, although asked for a later time; another selection is its own.
    assert cache.get(SPEC.at(SPEC.as_of + timedelta(minutes=4))) is first
    other = cache.get(replace(SPEC, source="FOTA"))
    assert other is not first and len(loads) == 2
    now[0] = 300.0
    again = cache.get(SPEC)
    assert again is not first and len(loads) == 3
    assert cache.get(replace(SPEC, source="FOTA")) is other
    cache.refresh()
    assert cache.get(SPEC) is not again
    cache.refresh()
