"""The report that the stream keeps against reports on all rows so far."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.comparing import DATA
from weekpulse import Report, ReportSpec
from weekpulse.queries import SPEC
from weekpulse.sources.events import event_feed
from weekpulse.sources.fact import FACT_SCHEMA
from weekpulse.sources.shared import folders, new_folder
from weekpulse.streaming.live import live_sums, live_summary, read_live, start_live

FOLDER = f"{DATA}/sf0.01"


class Feed:
    def __init__(self, spark, spec):
        self.spark, self.spec, self.place = spark, spec, new_folder(spark, "live")
        self.inbox = f"{self.place}/inbox"

    def add(self, rows):
        rows.coalesce(1).write.mode("append").parquet(self.inbox)
        stream = self.spark.readStream.schema(FACT_SCHEMA).parquet(self.inbox)
        start_live(stream, self.spec, f"{self.place}/table", f"{self.place}/checkpoint", once=True).awaitTermination()

    def check(self):
        so_far = self.spark.read.schema(FACT_SCHEMA).parquet(self.inbox)
        newest = so_far.agg(F.max("date_hour")).first()[0]
        wanted = Report(so_far, self.spec.at(newest)).summary().collect()
        assert live_summary(self.spark, f"{self.place}/table").collect() == wanted
        return wanted, newest


def test_each_batch_gives_the_summary_of_all_rows_so_far(spark):
    feed = Feed(spark, SPEC)
    fact = event_feed(spark, FOLDER).cache()
    ends = ["2024-01-01", "2024-01-09 05:00:00", "2024-01-15 14:30:00", "2024-01-15 20:00:00", "2024-01-30"]
    sizes = []
    for after, upto in zip(ends, ends[1:]):
        feed.add(fact.where(f"date_hour > timestamp_ntz'{after}' and date_hour <= timestamp_ntz'{upto}'"))
        wanted, newest = feed.check()
        sizes.append(len(wanted))
        assert {r.as_of for r in read_live(spark, f"{feed.place}/table").select("as_of").collect()} == {newest}
    assert max(sizes) == 35
    # Only batches of the newest time are left.
    assert len(folders(spark, f"{feed.place}/table")) <= 2
    fact.unpersist()


def facts(spark, rows):
    return spark.createDataFrame([(b, f, None, at, r, n, 0, 0, n) for b, f, at, r, n in rows], FACT_SCHEMA)


def test_late_rows_nulls_and_keys_that_leave(spark):
    from decimal import Decimal

    now, week = datetime(2024, 1, 15, 14), datetime(2024, 1, 8, 11)
    feed = Feed(spark, ReportSpec(as_of=now))
    assert live_summary(spark, f"{feed.place}/table").count() == 0
    feed.add(facts(spark, [("a", "x", now, Decimal("1.25"), 2**60), (None, "x", now, None, 1), ("b", "x", week, None, None)]))
    feed.check()
    # The time does not move: rows of a known hour, of last week, and of a week before that.
    feed.add(facts(spark, [("a", "x", now, Decimal("0.01"), 3), ("a", "x", week, None, 7), ("c", "x", datetime(2024, 1, 1), None, 1)]))
    wanted, _ = feed.check()
    assert [(r.brand, r.notif_today, r.notif_last_week) for r in wanted] == [("a", 2**60 + 3, 7), ("b", 0, 0)]
    # Two days on, nothing of before is in either period.
    feed.add(facts(spark, [("d", "x", datetime(2024, 1, 17, 3), Decimal(5), 1)]))
    wanted, _ = feed.check()
    assert [r.brand for r in wanted] == ["d"]


def test_the_hot_brand_has_several_lanes_and_the_clock_is_utc(spark):
    stream = spark.readStream.schema(FACT_SCHEMA).parquet(f"{FOLDER}/{{events}}.parquet")
    plan = live_sums(stream, SPEC)._jdf.queryExecution().analyzed().toString()
    assert "pmod(xxhash64" in plan and "EventTimeWatermark" in plan
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
    try:
        with pytest.raises(ValueError, match="UTC"):
            live_sums(event_feed(spark, FOLDER), SPEC)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
