"""What the layouts of a fact table save: row groups, and shuffles."""

from __future__ import annotations

import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.comparing import DATA, assert_same
from tests.facts import LAST_WEEK, SPEC as EDGE_SPEC, TODAY, fact, row
from tests.plans import planned, ran
from weekpulse import Report
from weekpulse.queries import SPEC
from weekpulse.sources.events import event_feed
from weekpulse.sources.fact import DAY, read_fact, write_fact
from weekpulse.sources.layout import on_curve, write_buckets, write_clustered
from weekpulse.sources.shared import new_folder

FOLDER = f"{DATA}/sf0.01"
SMALL = {"parquet.block.size": str(1 << 14), "parquet.block.size.row.check.min": "100", "parquet.page.row.count.limit": "1000"}


@pytest.fixture
def no_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def rows_read(df) -> int:
    """Rows that come out of the scans: those of the row groups that were not skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()))


def many_keys(spark):
    """60,000 rows of the two days, 30 brands by 30 features; one pair has a third of them."""
    n = F.col("id")
    hot = n % 3 == 0
    key = lambda word, by: F.concat(F.lit(word), F.when(hot, 0).otherwise(F.floor(n / by) % 30))
    day = F.when(n % 2 == 0, F.lit(TODAY)).otherwise(F.lit(LAST_WEEK))
    return spark.range(60_000).select(
        key("b", 7).alias("brand"), key("f", 211).alias("feature"), F.lit("FOTA").alias("source"),
        (F.date_trunc("day", day) + F.make_dt_interval(F.lit(0), F.pmod(F.xxhash64("id"), F.lit(24)).cast("int"))).cast("timestamp_ntz").alias("date_hour"),
        F.lit(1).cast("decimal(18,2)").alias("revenue"),
        *(n.alias(c) for c in ("notification_shown", "experience_shown", "install_success", "new_devices")),
    )


def test_curve_takes_bits_in_turn(spark):
    place = on_curve([F.lit(0b10).cast("bigint"), F.lit(0b01).cast("bigint"), F.lit(0b11).cast("bigint")], 2)
    assert spark.range(1).select(place).first()[0] == 0b101011


def test_selection_reads_fewer_row_groups(spark, no_adaptive):
    rows, read, found = many_keys(spark), {}, {}
    spec = replace(EDGE_SPEC, brands=("b7", "b11"), features=("f3", "f19"))
    for name, write in (("hours", write_fact), ("curve", lambda f, p: write_clustered(f, p, files=4, row_group_bytes=1 << 14))):
        path = new_folder(spark, name)
        for key, value in SMALL.items():
            spark.sparkContext._jsc.hadoopConfiguration().set(key, value)
        try:
            write(rows, path)
        finally:
            for key in SMALL:
                spark.sparkContext._jsc.hadoopConfiguration().unset(key)
        summary = Report(read_fact(spark, path=path, spec=spec, day_column=DAY), spec).summary()
        read[name], found[name] = rows_read(summary), summary.toPandas()
    assert_same(found["curve"], found["hours"])
    assert len(found["curve"]) == 4
    assert read["curve"] * 3 < read["hours"], read


def test_clustered_rows_are_all_there(spark):
    rows = [row(TODAY), row(TODAY), row(TODAY, brand=None, feature=None, source=None, revenue=None), row(LAST_WEEK, brand="")]
    path = new_folder(spark, "curve")
    write_clustered(fact(spark, *rows), path)
    assert sorted(map(str, read_fact(spark, path=path).collect())) == sorted(map(str, fact(spark, *rows).collect()))


@pytest.fixture(scope="module")
def buckets(spark):
    table = f"buckets_{uuid.uuid4().hex}"
    write_buckets(event_feed(spark, FOLDER), table, 4, new_folder(spark, "buckets"))
    yield table
    spark.sql(f"DROP TABLE {table}")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("result", [Report.summary_by_join, Report.summary])
def test_buckets_need_no_shuffle(spark, buckets, no_broadcast, result):
    rows = read_fact(spark, table=buckets, spec=SPEC, day_column=DAY)
    of_table = result(Report(rows, SPEC))
    for plan in (planned(of_table), ran(of_table)):
        assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan
        assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan or result is Report.summary
    assert_same(of_table.toPandas(), Report(event_feed(spark, FOLDER, SPEC), SPEC).summary().toPandas())


def test_hourly_results_from_buckets(spark, buckets):
    rows = read_fact(spark, table=buckets, spec=SPEC, day_column=DAY)
    assert_same(Report(rows, SPEC).hourly().toPandas(), Report(event_feed(spark, FOLDER, SPEC), SPEC).hourly().toPandas())


def test_a_hot_key_is_few_rows_in_its_bucket(spark):
    table = f"buckets_{uuid.uuid4().hex}"
    rows = many_keys(spark)
    write_buckets(rows, table, 4, new_folder(spark, "buckets"))
    kept = spark.table(table)
    assert kept.where("brand = 'b0' and feature = 'f0'").count() <= 48
    assert kept.agg(F.sum("notification_shown")).first() == rows.agg(F.sum("notification_shown")).first()
    # One file for each bucket of a day.
    assert len(kept.inputFiles()) <= 8
    spark.sql(f"DROP TABLE {table}")


def test_null_sums_stay_null(spark):
    table = f"buckets_{uuid.uuid4().hex}"
    write_buckets(fact(spark, row(TODAY, revenue=None, devices=None), row(TODAY, revenue=None, devices=None)), table, 2, new_folder(spark, "buckets"))
    only = read_fact(spark, table=table).collect()
    assert [(r.revenue, r.new_devices, r.notification_shown) for r in only] == [(None, None, 0)]
    spark.sql(f"DROP TABLE {table}")
