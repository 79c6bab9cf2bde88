"""Refreshed cubes and many report times against reports built anew, on random rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.plans import ran
from weekpulse import Report, ReportSpec
from weekpulse.operators.refreshed import unsettled_from
from weekpulse.sources.fact import FACT_SCHEMA

DAY = datetime(2024, 1, 15)


def random_facts(spark, seed, n=400):
    rng = random.Random(seed)
    some = lambda *values: rng.choice([*values, None])
    rows = []
    for _ in range(n):
        at = DAY - timedelta(days=rng.choice([0, 0, 7, 7, 1, 8])) + timedelta(minutes=rng.choice([0, 0, 30, 59]), hours=rng.randrange(24))
        rows.append((some("a", "b", "c"), some("x", "y"), some("FOTA"), at, some(Decimal("1.25"), Decimal("-3")), some(5, 2), some(1), some(0, 7), some(2)))
    return spark.createDataFrame(rows, FACT_SCHEMA).cache()


def cube(report):
    return sorted(map(str, report.cache().sums("brand", "feature", "hour_of_day").collect()))


@pytest.mark.parametrize("hours", [0, 2])
def test_a_refreshed_cube_equals_a_rebuilt_one(spark, hours):
    fact = random_facts(spark, 11 + hours)
    spec = ReportSpec(as_of=DAY + timedelta(hours=5, minutes=10))
    report = Report(fact.where(F.col("date_hour") <= F.lit(spec.as_of)), spec).cache()
    # Forwards within the day, backwards, before the lag is over, on, and to another day.
    for at in (9.5, 9.75, 14.5, 12.25, 1.5, 3, 23.99, 26):
        as_of = DAY + timedelta(hours=at)
        rows = fact.where((F.col("date_hour") <= F.lit(as_of)))
        report = report.refresh(rows, as_of, unsettled_hours=hours)
        assert cube(report) == cube(Report(rows, spec.at(as_of)))
    report.close()
    fact.unpersist()


def test_rows_that_came_late_to_unsettled_hours_count(spark):
    fact = random_facts(spark, 5)
    spec = ReportSpec(as_of=DAY + timedelta(hours=10))
    early = fact.where((F.col("date_hour") < F.lit(DAY + timedelta(hours=9))) | (F.col("install_success") == 0))
    now = spec.as_of + timedelta(hours=1)
    settled = early.where("date_hour < '2024-01-08 07:00' or date_hour >= '2024-01-14 23:00' or date_hour >= '2024-01-08 23:00'")
    assert settled.count() < fact.count()
    report = Report(early, spec).cache().refresh(fact, now, unsettled_hours=24)
    assert cube(report) == cube(Report(fact, spec.at(now)))
    report.close()
    fact.unpersist()


def test_only_unsettled_hours_are_read_again(spark, tmp_path):
    random_facts(spark, 3).write.parquet(f"{tmp_path}/fact")
    fact = spark.read.schema(FACT_SCHEMA).parquet(f"{tmp_path}/fact")
    before, now = ReportSpec(as_of=DAY + timedelta(hours=10)), ReportSpec(as_of=DAY + timedelta(hours=12))
    hours = unsettled_from(before, now, 1)
    assert hours == (9, 7)
    from weekpulse.operators.period_sums import period_sums
    from weekpulse.operators.refreshed import since

    plan = ran(period_sums(since(fact, now, hours), now, ("brand",)))
    assert "2024-01-15T09:00" in plan or "2024-01-15 09:00" in plan
    with pytest.raises(ValueError, match="negative"):
        unsettled_from(before, now, -1)


@pytest.mark.parametrize("step", [timedelta(hours=24), timedelta(hours=1), timedelta(minutes=7, seconds=13)])
def test_many_times_equal_single_reports(spark, step):
    fact = random_facts(spark, 17)
    spec = ReportSpec(as_of=DAY - timedelta(hours=1, minutes=30), source="FOTA")
    count = min(30, int(timedelta(days=9) / step))
    found = Report(fact, spec).summaries(step, count).collect()
    wanted = []
    for k in range(0, count, 5):
        at = spec.as_of + k * step
        single = Report(fact, spec.at(at)).summary().collect()
        assert [tuple(r)[1:] for r in found if r.as_of == at] == [tuple(r) for r in single]
        wanted += single
    assert wanted
    fact.unpersist()


def test_many_times_read_the_rows_once_and_join_nothing(spark, tmp_path):
    random_facts(spark, 3).write.parquet(f"{tmp_path}/fact")
    fact = spark.read.schema(FACT_SCHEMA).parquet(f"{tmp_path}/fact")
    plan = ran(Report(fact, ReportSpec(as_of=DAY)).summaries(timedelta(hours=1), 24))
    assert "Join" not in plan and "ReusedExchange" in plan
    with pytest.raises(ValueError, match="whole seconds"):
        Report(fact, ReportSpec(as_of=DAY)).summaries(timedelta(milliseconds=5), 2)
