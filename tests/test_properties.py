"""Results that must agree with each other, and the plans they come from."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.comparing import DATA, assert_same
from tests.plans import hash_exchanges, planned, ran, scans
from weekpulse import Report
from weekpulse.operators.measures import ALL, MAIN, SIDES
from weekpulse.queries import QUERIES, SPEC
from weekpulse.sources.events import event_feed

FOLDER = f"{DATA}/sf0.01"
SUMS = [f"{m}_{s}" for m in MAIN for s in SIDES]
NOT_FROM_CUBE = {
    "wow_summary_foj",
    "hourly_cube_foj",
    "export_roundtrip",
    "hourly_rollup_stream",
    "wow_with_totals",
    "wow_combined_with_totals",
    "rejected_events",
    "multi_grain_empty",
    "wow_summary_by_day",
    "wow_summary_from_rollup",
    "wow_summary_replayed",
    "wow_summary_live",
    "wow_summary_refreshed",
    "wow_summaries_month",
    "wow_selected_clustered",
    "wow_summary_bucketed",
}
RESULTS = {
    "summary": Report.summary,
    "combined": Report.combined,
    "kpi_totals": Report.kpi_totals,
    "kpi_display": Report.kpi_display,
    "by_brand": Report.by_brand,
    "by_feature": Report.by_feature,
    "by_brand_long": Report.by_brand_long,
    "by_feature_long": Report.by_feature_long,
    "multi_grain": Report.multi_grain,
    "grid": Report.grid,
    "percent_rules": Report.percent_rules,
    "display": Report.display,
    "new_devices_totals": Report.new_devices_totals,
    "summary_with_totals": Report.summary_with_totals,
    "data_summary": Report.data_summary,
    "dimension_values": Report.dimension_values,
    "hourly": Report.hourly,
    "hourly_combined": Report.hourly_combined,
    "new_devices_hourly": Report.new_devices_hourly,
    "hourly_series": Report.hourly_series,
    "peak_hour": Report.peak_hour,
    "top_feature": Report.top_feature,
    "insights": Report.insights,
}


@pytest.fixture(scope="module")
def report(spark):
    return Report(event_feed(spark, FOLDER, SPEC), SPEC)


@pytest.fixture(scope="module")
def cached(spark):
    report = Report(event_feed(spark, FOLDER, SPEC), SPEC).cache()
    yield report
    report.close()


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_cached_cube_gives_the_same(report, cached, name):
    assert_same(RESULTS[name](cached).toPandas(), RESULTS[name](report).toPandas())


def test_conditional_sums_equal_the_join(report):
    assert_same(report.summary().toPandas(), report.summary_by_join().toPandas())
    assert_same(report.hourly().toPandas(), report.hourly_by_join().toPandas())


def test_totals_agree_at_every_grain(cached):
    def total(df, columns):
        exact = [F.sum(F.col(c).cast("decimal(28,2)")).alias(c) for c in columns]
        return df.agg(*exact).first()

    kpis = total(cached.kpi_totals(), SUMS)
    assert total(cached.summary(), SUMS) == kpis
    assert total(cached.combined(), SUMS) == kpis
    assert total(cached.hourly_combined(), SUMS) == kpis
    everything = [f"{m}_{s}" for m in ALL for s in SIDES]
    assert total(cached.hourly(), everything) == total(cached.kpi_totals(), everything)
    for df in (cached.by_brand(), cached.by_feature()):
        wanted = ["revenue_today", "revenue_last_week", "notif_today"]
        assert total(df, wanted) == total(cached.kpi_totals(), wanted)
    long = cached.by_brand_long().groupBy("variable").agg(F.sum(F.col("value").cast("decimal(28,2)")))
    assert dict(long.collect()) == {c: kpis[c] for c in ("revenue_today", "revenue_last_week")}


def test_grouping_sets_equal_separate_groups(cached):
    grains = cached.multi_grain()
    by = {g: grains.filter(F.col("grain") == g) for g in ("brand_feature", "brand", "feature", "total")}
    shared = ["revenue_today", "revenue_last_week", "notif_today", "exp_today", "install_today"]
    assert_same(by["brand"].select("brand", *shared).toPandas(), cached.by_brand().toPandas())
    assert_same(by["feature"].select("feature", *shared).toPandas(), cached.by_feature().toPandas())
    assert_same(by["total"].select(*SUMS).toPandas(), cached.kpi_totals().select(*SUMS).toPandas())
    keyed = ["brand", "feature", *SUMS]
    assert_same(by["brand_feature"].select(*keyed).toPandas(), cached.summary().select(*keyed).toPandas())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NOT_FROM_CUBE))
def test_one_scan_and_pushed_periods(spark, name):
    plan = ran(QUERIES[name](spark, FOLDER))
    spark.catalog.clearCache()
    assert scans(plan, "events.parquet") == 1
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(ts," in plan or name in ("wow_early_hours", "grid_early")
    assert "PushedFilters: []" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_summary_shuffles_once_before_its_sort(report):
    plan = planned(report.summary())
    assert hash_exchanges(plan) == 1
    assert plan.count("Exchange") == 3  # with the broadcast of the small customer table and the sort


def test_join_form_scans_twice_and_joins_without_a_shuffle(report):
    plan = planned(report.summary_by_join())
    assert scans(plan, "events.parquet") == 2
    assert hash_exchanges(plan) == 2


def test_only_needed_columns_are_read(report):
    plan = planned(report.new_devices_totals())
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in plan


def test_totals_beside_rows_take_one_scan(spark):
    report = Report(event_feed(spark, FOLDER, SPEC), SPEC).cache()
    plan = ran(report.summary_with_totals())
    assert "InMemoryTableScan" in plan and scans(plan, "events.parquet") <= 1
    report.close()
