"""A report that the stream keeps by itself, in state, at the newest hour it has seen.

State holds, for each brand, feature and lane, the sums of every hour that the report can still read. A
lane is a share of the rows, dealt by their own hash, so that a brand with a third of all rows is kept by
several tasks; readers add the lanes up. The report's time is the newest hour of all rows: the watermark
follows it at a distance of the lookback and a day, so a row that is too late for it is too old for the
report, too. A key emits its sums of both periods when rows of its own come, and whenever the watermark
moves: then a timer of each key fires, hours that have left both periods go from the state, and a key
without hours ends. State is bounded by keys x lanes x hours of the lookback, whatever the number of rows.

Rows may be single ones or hourly sums, such as the rollup's; both give the same report.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weekpulse.functions import percent
from weekpulse.operators.measures import ALL, FACT_COLUMN, MAIN, SIDES, compared
from weekpulse.operators.period_sums import add_up
from weekpulse.operators.rows import selected
from weekpulse.sources.shared import folders, remove
from weekpulse.spec import ReportSpec
from weekpulse.streaming.rollup import BATCH, REFRESH_INTERVAL, REVENUE_SCALE, UTC, read_if_there

LANES = 8
KEYS = ("brand", "feature", "lane")
MEASURES = tuple(FACT_COLUMN.values())
KINDS = {c: T.DecimalType(38, REVENUE_SCALE) if c == "revenue" else T.LongType() for c in MEASURES}
HOUR = T.StructType([T.StructField("hour", T.LongType())])
# A sum stays NULL when only NULL was added; `n` counts rows.
HOUR_SUMS = T.StructType([T.StructField(c, kind) for c, kind in KINDS.items()] + [T.StructField("n", T.LongType())])
LIVE = T.StructType(
    [
        T.StructField("brand", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("lane", T.LongType()),
        T.StructField("as_of", T.TimestampNTZType()),
        *[T.StructField(f"{m}_{s}", KINDS[FACT_COLUMN[m]]) for m in ALL for s in SIDES],
        *[T.StructField(f"rows_{s}", T.LongType()) for s in SIDES],
    ]
)
STORED = T.StructType([*LIVE.fields, T.StructField(BATCH, T.LongType())])
EPOCH = datetime(1970, 1, 1)


def horizon(spec: ReportSpec) -> timedelta:
    """No row that a report reads is older than this when the report is made."""
    return timedelta(days=spec.lookback_days + 1)


class PeriodState(StatefulProcessor):
    def __init__(self, spec: ReportSpec) -> None:
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", HOUR, HOUR_SUMS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, list] = {}
        for row in rows:
            sums = new.setdefault(row.hour, [None] * len(MEASURES) + [0])
            sums[:] = [*(plus(old, row[c]) for old, c in zip(sums, MEASURES)), sums[-1] + 1]
        for hour, sums in new.items():
            if self.hours.containsKey((hour,)):
                sums = [plus(a, b) for a, b in zip(self.hours.getValue((hour,)), sums)]
            self.hours.updateValue((hour,), tuple(sums))
        self._wake(timerValues)
        # Before the watermark has started the report's time is not known; the timer fires once it is.
        if timerValues.getCurrentWatermarkInMs() > 0:
            yield self._report(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        start = self._spec(timerValues).last_week.start
        left = 0
        for (hour,) in list(self.hours.keys()):
            if moment_of(hour) < start:
                self.hours.removeKey((hour,))
            else:
                left += 1
        if left:
            self._wake(timerValues)
        yield self._report(key, timerValues)

    def _wake(self, timerValues) -> None:
        """One timer, for the next time that the watermark moves."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), 0) + 1)

    def _spec(self, timerValues) -> ReportSpec:
        watermark = EPOCH + timedelta(milliseconds=timerValues.getCurrentWatermarkInMs())
        return self.spec.at(watermark + horizon(self.spec))

    def _report(self, key, timerValues) -> Row:
        spec = self._spec(timerValues)
        sums = {side: [None] * len(MEASURES) + [0] for side in SIDES}
        for (hour,), held in list(self.hours.iterator()):
            for side, period in zip(SIDES, spec.periods):
                if period.start <= moment_of(hour) <= period.end:
                    sums[side] = [plus(a, b) for a, b in zip(sums[side], held)]
        values = [sums[s][MEASURES.index(FACT_COLUMN[m])] for m in ALL for s in SIDES]
        return Row(*LIVE.names)(*key, spec.as_of, *values, *(sums[s][-1] for s in SIDES))

    def close(self) -> None:
        pass


def plus(a, b):
    return b if a is None else a if b is None else a + b


def moment_of(hour: int) -> datetime:
    return EPOCH + timedelta(hours=hour)


def live_sums(fact: DataFrame, spec: ReportSpec, lanes: int = LANES) -> DataFrame:
    """A stream of fact rows, stamped with whole hours, as one of each key's sums at the newest hour."""
    if fact.sparkSession.conf.get("spark.sql.session.timeZone") not in UTC:
        raise ValueError("set spark.sql.session.timeZone to UTC")
    rows = selected(fact, spec).select(
        F.col("date_hour").cast("timestamp").alias("event_time"),
        "brand",
        "feature",
        F.pmod(F.xxhash64("source", "date_hour", *MEASURES), F.lit(lanes)).alias("lane"),
        F.expr("unix_seconds(cast(date_hour as timestamp)) div 3600").alias("hour"),
        *[F.col(c).cast(kind).alias(c) for c, kind in KINDS.items()],
    )
    return (
        rows.withWatermark("event_time", f"{int(horizon(spec).total_seconds())} seconds")
        .groupBy(*KEYS)
        .transformWithState(PeriodState(spec), LIVE, "Update", "EventTime")
    )


def start_live(
    fact: DataFrame, spec: ReportSpec, table: str, checkpoint: str, once: bool = False, interval: str = REFRESH_INTERVAL
) -> StreamingQuery:
    """Keeps the report's sums at `table`; one stream writes it, and its state store is RocksDB.

    `spec.as_of` plays no part: the report's time is the stream's. Batches of an older time are removed
    when one of a newer time is complete, since every key emits when the time moves.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        path = f"{table}/{BATCH}={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        spark = batch.sparkSession
        newest = spark.read.schema(LIVE).parquet(path).agg(F.max("as_of")).first()[0]
        if newest is None:
            remove(spark, path)
            return
        rows = spark.read.schema(STORED).parquet(table).where(F.col(BATCH) != batch_id)
        kept = {r[BATCH] for r in rows.where(F.col("as_of") >= F.lit(newest)).select(BATCH).distinct().collect()}
        for name in folders(spark, table):
            if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) not in {*kept, batch_id}:
                remove(spark, f"{table}/{name}")

    spark = fact.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    # Read when the query starts, and then kept in its checkpoint.
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = live_sums(fact, spec).writeStream.outputMode("update").foreachBatch(store)
        trigger = {"availableNow": True} if once else {"processingTime": interval}
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(provider, before)


def read_live(spark: SparkSession, table: str) -> DataFrame:
    """brand, feature, as_of and the sums of both periods at the newest time; no rows before the first batch."""
    rows = read_if_there(spark, table, STORED)
    newest = rows.agg(F.max("as_of").alias("newest")).select("newest").scalar()
    now = rows.where(F.col("as_of") == newest)
    last = now.groupBy(*KEYS).agg(F.max_by(F.struct(*[c for c in LIVE.names if c not in KEYS]), BATCH).alias("last"))
    return add_up(last.select(*KEYS, "last.*"), ("brand", "feature", "as_of")).where("rows_today + rows_last_week > 0")


def live_summary(spark: SparkSession, table: str) -> DataFrame:
    """The rows of `Report.summary` at the newest time."""
    sums = read_live(spark, table)
    return sums.select("brand", "feature", *compared(MAIN, percent.rounded)).orderBy("brand", "feature")
