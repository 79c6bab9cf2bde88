"""The registered queries: every operator on the event feed of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpulse.operators.measures import FACT_COLUMN
from weekpulse.plans.report import Report
from weekpulse.sources.events import (
    EVENTS,
    event_feed,
    events_to_fact,
    read_customers,
    read_events,
    rejected_events,
)
from weekpulse.sources.export import export, read_export
from weekpulse.sources.fact import DAY, read_fact, write_fact
from weekpulse.sources.layout import write_buckets, write_clustered
from weekpulse.sources.shared import new_folder
from weekpulse.spec import ReportSpec
from weekpulse.streaming.live import live_summary, start_live
from weekpulse.streaming.rollup import compact_rollup, hour_totals, read_rollup, start_rollup

Query = Callable[[SparkSession, str], DataFrame]

SPEC = ReportSpec(
    as_of=datetime(2024, 1, 15, 14, 30),
    known_brands=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    known_features=tuple(f"feature_{n}" for n in range(7)),
)
EARLY = replace(SPEC, as_of=datetime(2024, 1, 15, 1, 30))
SELECTED = replace(SPEC, brands=("BUILDING", "MACHINERY"), features=("feature_1", "feature_3"))
BY_SOURCE = replace(SPEC, source="FOTA")
# Inside the data's hours; after which the zone's hour is 0; with revenue far from last week's.
CUT = replace(SPEC, cut_hour=9)
LATE = replace(SPEC, as_of=datetime(2024, 1, 15, 22, 30))
SWING = replace(SPEC, as_of=datetime(2024, 1, 15, 8, 30))
KNOWN_SUBSET = replace(SPEC, known_brands=SPEC.known_brands[:3], known_features=SPEC.known_features[2:5])
WITHOUT_ROWS = replace(SPEC, as_of=datetime(2025, 6, 1, 12))
MORNING = replace(SPEC, as_of=datetime(2024, 1, 15, 5, 30))
# Reports every six hours of a month.
MONTH = replace(SPEC, as_of=datetime(2024, 1, 1, 2, 30))
STEP, N_TIMES = timedelta(hours=6), 116
ZONE = "Asia/Jerusalem"
BUCKETS = 8
HOURS_AHEAD = 3


def on_report(result: Callable[[Report], DataFrame], spec: ReportSpec = SPEC) -> Query:
    return lambda spark, folder: result(Report(event_feed(spark, folder, spec), spec))


def export_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    summary = Report(event_feed(spark, folder, SPEC), SPEC).summary()
    path = export(summary, new_folder(spark, "export"), SPEC.as_of, "summary")
    return read_export(spark, path, summary.schema)


def with_totals(result: Callable[[Report], DataFrame]) -> Query:
    """Rows and scalars need different sums; from the cached cube both come out of one scan.

    The result, a row for each key, is written, so that the cube need not be kept for its readers.
    """

    def query(spark: SparkSession, folder: str) -> DataFrame:
        report = Report(event_feed(spark, folder, SPEC), SPEC).cache()
        try:
            rows = result(report)
            path = new_folder(spark, "totals")
            rows.write.parquet(path)
        finally:
            report.close()
        return spark.read.schema(rows.schema).parquet(path)

    return query


def wow_summary_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """Reports kept in the morning and refreshed twice, each time from the hours after the settled ones."""
    report = Report(event_feed(spark, folder, MORNING), MORNING).cache()
    for spec in (SWING, SPEC):
        report = report.refresh(event_feed(spark, folder, spec), spec.as_of, unsettled_hours=1)
    return report.summary()


def wow_summary_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """All events as a fact table by day, of which the report reads two days."""
    path = new_folder(spark, "fact")
    write_fact(event_feed(spark, folder), path)
    return Report(read_fact(spark, path=path, spec=SPEC, day_column=DAY), SPEC).summary()


def wow_selected_clustered(spark: SparkSession, folder: str) -> DataFrame:
    """All events as a fact table clustered by brand, feature and hour, of which a selection is read."""
    path = new_folder(spark, "clustered")
    write_clustered(event_feed(spark, folder), path)
    return Report(read_fact(spark, path=path, spec=SELECTED, day_column=DAY), SELECTED).summary()


def wow_summary_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """All events as a bucketed table of hourly sums, whose two periods are joined without a shuffle."""
    table = f"fact_{uuid.uuid4().hex}"
    write_buckets(event_feed(spark, folder), table, BUCKETS, new_folder(spark, "buckets"))
    return Report(read_fact(spark, table=table, spec=SPEC, day_column=DAY), SPEC).summary_by_join()


def streamed(
    spark: SparkSession, events: DataFrame, folder: str, place: str, checkpoint: str = "checkpoint", **told: str
) -> None:
    start_rollup(
        events,
        table=f"{place}/table",
        checkpoint=f"{place}/{checkpoint}",
        # The customers as they are when the batch runs.
        to_fact=lambda batch: events_to_fact(batch, read_customers(spark, folder)),
        once=True,
        **told,
    ).awaitTermination()


def hourly_rollup_stream(spark: SparkSession, folder: str) -> DataFrame:
    """All events streamed into a rollup table, and the table's hourly sums."""
    # A glob, since the stream source takes a plain path to be a folder.
    events = spark.readStream.schema(EVENTS).parquet(f"{folder}/{{events}}.parquet")
    place = new_folder(spark, "rollup")
    streamed(spark, events, folder, place)
    totals = hour_totals(read_rollup(spark, f"{place}/table"), ("brand", "feature", "date_hour"))
    return totals.withColumn("revenue", F.col("revenue").cast("double")).select(
        "brand", "feature", "date_hour", *FACT_COLUMN.values()
    )


def wow_summary_from_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The report on a rollup of several micro-batches, the older ones compacted."""
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    by_day = F.dayofmonth("ts") % 4
    read_events(spark, folder).repartition(4, by_day).write.parquet(inbox)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(inbox)
    streamed(spark, events, folder, place)
    compact_rollup(spark, f"{place}/table")
    return Report(read_rollup(spark, f"{place}/table", SPEC), SPEC).summary()


def wow_summary_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """All events delivered twice, the second time to a new run after a compaction: counted once."""
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    read_events(spark, folder).repartitionByRange(2, "ts").write.parquet(inbox)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(inbox)
    for checkpoint in ("first", "second"):
        streamed(spark, events, folder, place, checkpoint, event_id="event_id", event_time="ts")
        compact_rollup(spark, f"{place}/table")
    return Report(read_rollup(spark, f"{place}/table", SPEC), SPEC).summary()


def wow_summary_live(spark: SparkSession, folder: str) -> DataFrame:
    """The summary at the newest hour of all events, as a stream keeps it in state."""
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "live")
    read_events(spark, folder).repartitionByRange(3, "ts").write.parquet(inbox)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(inbox)
    fact = events_to_fact(events, read_customers(spark, folder))
    start_live(fact, SPEC, f"{place}/table", f"{place}/checkpoint", once=True).awaitTermination()
    return live_summary(spark, f"{place}/table")


QUERIES: dict[str, Query] = {
    "wow_summary": on_report(Report.summary),
    "wow_summary_foj": on_report(Report.summary_by_join),
    "wow_selected": on_report(Report.summary, SELECTED),
    "wow_by_source": on_report(Report.summary, BY_SOURCE),
    "wow_early_hours": on_report(Report.summary, EARLY),
    "new_devices_totals": on_report(Report.new_devices_totals),
    "new_devices_hourly": on_report(Report.new_devices_hourly),
    "hourly_cube": on_report(Report.hourly),
    "hourly_cube_foj": on_report(Report.hourly_by_join),
    "wow_combined": on_report(Report.combined),
    "hourly_combined": on_report(Report.hourly_combined),
    "kpi_totals": on_report(Report.kpi_totals),
    "kpi_display": on_report(Report.kpi_display),
    "by_brand": on_report(Report.by_brand),
    "by_feature": on_report(Report.by_feature),
    "by_brand_long": on_report(Report.by_brand_long),
    "by_feature_long": on_report(Report.by_feature_long),
    "hourly_series": on_report(Report.hourly_series),
    "hourly_series_tz": on_report(lambda report: report.hourly_series(zone=ZONE)),
    "hourly_shifted": on_report(lambda report: report.hourly_shifted(HOURS_AHEAD)),
    "peak_hour": on_report(Report.peak_hour),
    "top_feature": on_report(Report.top_feature),
    "insights": on_report(Report.insights),
    "data_summary": on_report(Report.data_summary),
    "dimension_values": on_report(Report.dimension_values),
    "multi_grain": on_report(Report.multi_grain),
    "grid_wow": on_report(Report.grid),
    "wow_with_totals": with_totals(Report.summary_with_totals),
    "wow_combined_with_totals": with_totals(Report.combined_with_totals),
    "pct_rules": on_report(Report.percent_rules),
    "display_table": on_report(Report.display),
    "export_roundtrip": export_roundtrip,
    "hourly_rollup_stream": hourly_rollup_stream,
    # Where each operator changes something.
    "hourly_series_cut": on_report(Report.hourly_series, CUT),
    "hourly_series_tz_wrap": on_report(lambda report: report.hourly_series(zone=ZONE), LATE),
    "hourly_shifted_wrap": on_report(lambda report: report.hourly_shifted(HOURS_AHEAD), LATE),
    "grid_early": on_report(Report.grid, EARLY),
    "insights_swing": on_report(Report.insights, SWING),
    "wow_known_subset": on_report(Report.summary, KNOWN_SUBSET),
    "multi_grain_empty": on_report(Report.multi_grain, WITHOUT_ROWS),
    "rejected_events": lambda spark, folder: rejected_events(read_events(spark, folder)),
    "wow_summary_by_day": wow_summary_by_day,
    "wow_selected_clustered": wow_selected_clustered,
    "wow_summary_bucketed": wow_summary_bucketed,
    "wow_summary_from_rollup": wow_summary_from_rollup,
    "wow_summary_replayed": wow_summary_replayed,
    "wow_summary_live": wow_summary_live,
    "wow_summary_refreshed": wow_summary_refreshed,
    # One scan for all times, so the events are read whole.
    "wow_summaries_month": lambda spark, folder: Report(event_feed(spark, folder), MONTH).summaries(STEP, N_TIMES),
}
