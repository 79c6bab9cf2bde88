"""The streamed rollup against the batch answer."""

from __future__ import annotations

import os
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.comparing import DATA, assert_same, duck
from tests.facts import LAST_WEEK, TODAY, fact, row
from tests.plans import ran
from weekpulse import Report
from weekpulse.oracle import ORACLE
from weekpulse.queries import SPEC
from weekpulse.sources.events import CUSTOMERS, EVENTS, event_feed, events_to_fact, read_customers
from weekpulse.sources.fact import FACT_COLUMNS, FACT_SCHEMA
from weekpulse.sources.shared import new_folder
from weekpulse.streaming import rollup
from weekpulse.streaming.rollup import (
    HOUR_KEYS,
    compact_rollup,
    hour_totals,
    read_rollup,
    start_rollup,
    windowed_totals,
)

FOLDER = f"{DATA}/sf0.01"


def add_file(spark, inbox, keep):
    events = spark.read.schema(EVENTS).parquet(f"{FOLDER}/events.parquet")
    events.filter(keep).coalesce(1).write.mode("append").parquet(inbox)


def run(spark, inbox, place, **options):
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(inbox)
    customers = read_customers(spark, FOLDER)
    query = start_rollup(
        events,
        table=f"{place}/table",
        checkpoint=f"{place}/checkpoint",
        to_fact=lambda batch: events_to_fact(batch, customers),
        once=True,
    )
    query.awaitTermination()
    return query


def test_batches_in_any_order_equal_the_batch_answer(spark):
    """The newest files first, so that most events come weeks late; then more files in a second run."""
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    day = F.dayofmonth("ts")
    add_file(spark, inbox, day > 20)
    add_file(spark, inbox, (day <= 20) & (day > 10))
    run(spark, inbox, place)
    partly = read_rollup(spark, f"{place}/table").agg(F.max("date_hour"), F.min("date_hour")).first()
    assert partly[1].day == 11
    add_file(spark, inbox, day <= 10)
    run(spark, inbox, place)

    rolled = read_rollup(spark, f"{place}/table", SPEC)
    assert_same(Report(rolled, SPEC).summary().toPandas(), duck(FOLDER).execute(ORACLE["wow_summary"]).df())
    assert_same(Report(rolled, SPEC).hourly().toPandas(), duck(FOLDER).execute(ORACLE["hourly_cube"]).df())
    assert "PartitionFilters: [event_date#" in ran(Report(rolled, SPEC).summary())
    # Nothing new: nothing is added.
    before = read_rollup(spark, f"{place}/table").count()
    run(spark, inbox, place)
    assert read_rollup(spark, f"{place}/table").count() == before


def test_days_without_rows(spark):
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    add_file(spark, inbox, F.dayofmonth("ts") == 15)
    run(spark, inbox, place)
    totals = Report(read_rollup(spark, f"{place}/table", SPEC), SPEC).kpi_totals().first()
    assert totals.notif_today > 0 and totals.notif_last_week == 0
    other = SPEC.at(SPEC.as_of.replace(month=3))
    assert Report(read_rollup(spark, f"{place}/table", other), other).summary().count() == 0
    # A table that no batch has been written to yet.
    fresh = Report(read_rollup(spark, f"{place}/nothing", SPEC), SPEC)
    assert fresh.summary().count() == 0 and fresh.kpi_totals().first().notif_today == 0
    compact_rollup(spark, f"{place}/nothing")


def add_events(spark, inbox, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(inbox)


def event(at, value=None, kind="view", user=1, number=0):
    return (at, TODAY, user, kind, value, f'{{"k": {number}}}')


def start(spark, inbox, place, checkpoint="checkpoint", customers=((1, "a"),), to_fact=None):
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(inbox)
    known = spark.createDataFrame(list(customers), CUSTOMERS)
    query = start_rollup(
        events,
        f"{place}/table",
        f"{place}/{checkpoint}",
        to_fact or (lambda batch: events_to_fact(batch, known)),
        once=True,
    )
    query.awaitTermination()


def counted(spark, place):
    return read_rollup(spark, f"{place}/table").agg(F.sum("notification_shown")).first()[0]


def forget_last_commit(place):
    """As after losing the driver between writing the last batch and committing it."""
    commits = f"{place}/checkpoint/commits"
    last = max(int(name) for name in os.listdir(commits) if name.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.unlink(f"{commits}/{name}")
    return last


def test_a_new_checkpoint_adds_to_a_filled_table(spark):
    place = new_folder(spark, "rollup")
    for name, n in (("one", 5), ("two", 3)):
        inbox = new_folder(spark, "inbox")
        add_events(spark, inbox, [event(k) for k in range(n)])
        start(spark, inbox, place, name)
    assert counted(spark, place) == 8


def test_a_batch_run_again_replaces_itself(spark):
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    add_events(spark, inbox, [event(1)])
    start(spark, inbox, place)
    add_events(spark, inbox, [event(2)])
    start(spark, inbox, place)
    assert forget_last_commit(place) == 1
    start(spark, inbox, place)
    assert counted(spark, place) == 2


def test_a_batch_run_again_leaves_nothing_of_its_first_attempt(spark):
    """A customer is gone by then, and with it the only row of a day."""
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    other_day = (2, LAST_WEEK, 2, "view", None, '{"k": 0}')
    add_events(spark, inbox, [event(1), other_day])
    start(spark, inbox, place, customers=((1, "a"), (2, "b")))
    assert counted(spark, place) == 2
    forget_last_commit(place)
    start(spark, inbox, place, customers=((1, "a"),))
    assert counted(spark, place) == 1


def test_sums_do_not_depend_on_the_cut_into_batches(spark):
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    fine = lambda batch: batch.select(
        F.lit("a").alias("brand"), F.lit("f").alias("feature"), F.lit("s").alias("source"), F.col("ts").alias("date_hour"),
        F.col("value").cast("decimal(10,4)").alias("revenue"), *(F.lit(1).alias(c) for c in FACT_COLUMNS[5:]),
    )
    for k in range(4):
        add_events(spark, inbox, [event(k, 0.004)])
    start(spark, inbox, place, to_fact=fine)
    assert read_rollup(spark, f"{place}/table").agg(F.sum("revenue")).first()[0] == Decimal("0.016")
    rows = fact(spark, row(TODAY))
    for kind in ("double", "decimal(18,7)"):
        with pytest.raises(ValueError, match="scale"):
            hour_totals(rows.withColumn("revenue", F.col("revenue").cast(kind)), HOUR_KEYS)


@pytest.mark.parametrize("crash", [None, "written", "noted"])
def test_compaction_loses_nothing(spark, monkeypatch, crash):
    """Also if it stops after writing the sums, or after noting them and before removing files."""
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    table = f"{place}/table"
    for k in range(4):
        add_events(spark, inbox, [event(k), event(10 + k)])
    start(spark, inbox, place)
    assert counted(spark, place) == 8

    def stop(*args):
        raise KeyboardInterrupt

    if crash:
        # The note is made from a range.
        monkeypatch.setattr(*((spark.__class__, "range") if crash == "written" else (rollup, "_clean")), stop)
        with pytest.raises(KeyboardInterrupt):
            compact_rollup(spark, table)
        monkeypatch.undo()
        assert counted(spark, place) == 8
    compact_rollup(spark, table)
    assert counted(spark, place) == 8
    assert len({f for f in read_rollup(spark, table).inputFiles() if "/batches/" in f}) >= 1
    batches = spark.read.parquet(f"{table}/batches").select("batch_id").distinct().collect()
    assert [r.batch_id for r in batches] == [3]
    # The newest batch may still be run again, and the stream goes on.
    forget_last_commit(place)
    start(spark, inbox, place)
    assert counted(spark, place) == 8
    add_events(spark, inbox, [event(20)])
    start(spark, inbox, place)
    compact_rollup(spark, table)
    assert counted(spark, place) == 9
    assert {r.upto for r in spark.read.parquet(f"{table}/compacted").select("upto").distinct().collect()} == {2, 3}


def files_of_days(spark, table):
    found = {}
    for file in read_rollup(spark, table).inputFiles():
        if "/compacted/" in file:
            found.setdefault(file.split("event_date=")[1][:10], set()).add(file)
    return found


def test_compaction_rewrites_touched_days_only_and_in_levels(spark, monkeypatch):
    """Batches 0 to n of one day each, closed one by one; the first day comes once and keeps its files."""
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    table, written = f"{place}/table", []
    write = rollup._write
    monkeypatch.setattr(rollup, "_write", lambda sums, folder: (written.append(folder), write(sums, folder)))
    monkeypatch.setattr(rollup, "FAN", 2)
    early = TODAY - timedelta(days=9)
    add_events(spark, inbox, [(0, early, 1, "view", None, '{"k": 0}')])
    start(spark, inbox, place)
    first = None
    for k in range(1, 9):
        add_events(spark, inbox, [event(k)])
        start(spark, inbox, place)
        compact_rollup(spark, table)
        days = files_of_days(spark, table)
        first = first or days[str(early.date())]
        assert days[str(early.date())] == first
        assert counted(spark, place) == k + 1
    # Batch 0 on its own day, then batches 1 to 7, one a call.
    levels = [int(folder.split("level=")[1].split("/")[0]) for folder in written if "/compacted/" in folder]
    assert levels == [0, 0, 1, 0, 2, 0, 1, 0]
    parts = rollup._live(rollup._parts(spark, table), rollup._complete(spark, table))
    for level in range(3):
        assert sum(part.level == level for part in parts if part.day == str(TODAY.date())) < rollup.FAN


def test_an_unfinished_compaction_is_not_read(spark, monkeypatch):
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    table = f"{place}/table"
    for k in range(3):
        add_events(spark, inbox, [event(k)])
        start(spark, inbox, place)
    monkeypatch.setattr(spark.__class__, "range", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        compact_rollup(spark, table)
    monkeypatch.undo()
    add_events(spark, inbox, [event(3)])
    start(spark, inbox, place)
    assert counted(spark, place) == 4
    compact_rollup(spark, table)
    assert counted(spark, place) == 4
    assert {(part.first, part.upto) for part in rollup._parts(spark, table)} == {(0, 2)}


def deliver(spark, inbox, place, checkpoint, to_fact=None):
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(inbox)
    known = spark.createDataFrame([(1, "a")], CUSTOMERS)
    start_rollup(
        events, f"{place}/table", f"{place}/{checkpoint}", to_fact or (lambda batch: events_to_fact(batch, known)),
        once=True, event_id="event_id", event_time="ts",
    ).awaitTermination()


def test_a_feed_delivered_again_changes_nothing(spark):
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    add_events(spark, inbox, [event(1), event(2), event(2), event(None), event(None)])
    add_events(spark, inbox, [event(2), event(3), (3, TODAY - timedelta(days=1), 1, "view", None, '{"k": 0}')])
    deliver(spark, inbox, place, "one")
    # Ids 1, 2 and 3, 3 of another day, and two that cannot be told apart.
    assert counted(spark, place) == 6
    deliver(spark, inbox, place, "two")
    # The two count whenever they come.
    assert counted(spark, place) == 8
    compact_rollup(spark, f"{place}/table")
    deliver(spark, inbox, place, "three")
    assert counted(spark, place) == 10


def test_deliveries_survive_a_crash_between_ids_and_sums(spark):
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "rollup")
    add_events(spark, inbox, [event(1), event(2)])

    def crash(batch):
        raise RuntimeError("lost")

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            deliver(spark, inbox, place, "one", crash)
    # Its ids are there and its sums are not: another run counts the events, and the first one, resumed, does not.
    deliver(spark, inbox, place, "two")
    assert counted(spark, place) == 2
    deliver(spark, inbox, place, "one")
    assert counted(spark, place) == 2


def test_ids_and_times_go_together(spark):
    with pytest.raises(ValueError, match="event_time"):
        start_rollup(None, "", "", event_id="event_id")


@pytest.mark.parametrize("mode", ["complete", "append"])
def test_windowed_totals_equal_the_batch_answer(spark, mode):
    """Files in time order. In append mode hours come out when the watermark has passed them."""
    inbox, place = new_folder(spark, "inbox"), new_folder(spark, "windowed")
    fact = event_feed(spark, FOLDER)
    for first in (1, 11, 21):
        days = F.dayofmonth("date_hour").between(first, first + 9)
        fact.filter(days).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(FACT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
    # Files are taken in the order they were written.
    query = (
        windowed_totals(stream, horizon="10 days")
        .writeStream.format("memory")
        .queryName(f"windowed_{mode}")
        .outputMode(mode)
        .option("checkpointLocation", f"{place}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = spark.table(f"windowed_{mode}")
    wanted = hour_totals(fact, HOUR_KEYS)
    if mode == "append":
        last = found.agg(F.max("date_hour")).first()[0]
        assert last.day >= 19
        wanted = wanted.filter(F.col("date_hour") <= F.lit(str(last)).cast("timestamp_ntz"))
    assert found.count() > 0
    assert_same(found.toPandas(), wanted.toPandas())


def test_windows_stay_open_for_the_lookback(spark):
    stream = spark.readStream.schema(FACT_SCHEMA).parquet(f"{DATA}/sf0.01/{{events}}.parquet")
    for days, wanted in ((7, "8 days"), (14, "15 days")):
        plan = windowed_totals(stream, days)._jdf.queryExecution().logical().toString()
        assert f"EventTimeWatermark" in plan and wanted in plan


def test_windows_need_a_utc_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
    try:
        with pytest.raises(ValueError, match="UTC"):
            windowed_totals(event_feed(spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
