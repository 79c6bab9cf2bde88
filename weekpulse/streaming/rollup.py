"""A fact table kept up to date from a stream.

Reports add rows up, whatever their number per key. So each micro-batch only has to append its own
hourly sums: there is no state to keep, and an event is counted however late it comes. Where a
consumer wants finished hours instead, `windowed_totals` keeps state up to a watermark.

The table has these folders. `batches` has one folder per run and micro-batch; a run is a stream with its
checkpoint, so that a new checkpoint adds to the table and never replaces what another run wrote.
`compacted` has, per run and day, parts: the sums of batches `first` to `upto`; `compactions` has a row for
each compaction that is complete. Readers take the batches after a run's last complete compaction and, of
each day, the parts up to it that lie in no larger one. `ids` has, by day, the events that each batch
counted, if the stream names their id.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weekpulse.operators.measures import FACT_COLUMN
from weekpulse.sources.fact import DAY, FACT_SCHEMA, as_fact
from weekpulse.sources.shared import exists, folders, remove
from weekpulse.spec import ReportSpec

RUN, BATCH, LEVEL, FIRST, UPTO = "run_id", "batch_id", "level", "first", "upto"
# So many parts of a day and level become one of the next level.
FAN = 4
SUMS = [*[f for f in FACT_SCHEMA if f.name != "revenue"], T.StructField("revenue", T.DecimalType(38, 6))]
REVENUE_SCALE = 6
ROLLUP = T.StructType(
    [*SUMS, T.StructField(RUN, T.StringType()), T.StructField(BATCH, T.LongType()), T.StructField(DAY, T.DateType())]
)
COVERED = (LEVEL, FIRST, UPTO)
COMPACTED = T.StructType(
    [*ROLLUP.fields[:-2], *[T.StructField(c, T.LongType()) for c in COVERED], T.StructField(DAY, T.DateType())]
)
IDS = T.StructType([T.StructField("id", T.StringType()), *ROLLUP.fields[-3:]])
COMPACTIONS = T.StructType([T.StructField(RUN, T.StringType()), T.StructField(UPTO, T.LongType())])
REFRESH_INTERVAL = "5 minutes"
UTC = ("UTC", "Etc/UTC")
HOUR_KEYS = ("brand", "feature", "source", "date_hour")


def start_rollup(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    to_fact: Callable[[DataFrame], DataFrame] = as_fact,
    once: bool = False,
    interval: str = REFRESH_INTERVAL,
    event_id: str | None = None,
    event_time: str | None = None,
) -> StreamingQuery:
    """Appends the hourly sums of each micro-batch to the Parquet table at `table`.

    `to_fact` turns a micro-batch into fact rows. `table` and `checkpoint` must be folders that all
    executors share. A batch run again after a failure replaces all that it had written, also on
    days that it has no rows of any more. Events read again under a new checkpoint count again, unless
    `event_id` and `event_time` name the columns that hold an event's id and time: then an id counts once
    a day, however often and however late it is delivered, by whatever run. One stream at a time writes
    such a table.
    """
    if (event_id is None) != (event_time is None):
        raise ValueError("give both event_id and event_time, or neither")

    def append(batch: DataFrame, batch_id: int) -> None:
        # Kept in the checkpoint, and so the same after a restart.
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not run:
            raise RuntimeError("the stream's identity is not known")
        if event_id is not None:
            batch = _first_delivered(batch, table, run, batch_id, event_id, event_time)
        sums = hour_totals(to_fact(batch), HOUR_KEYS).withColumn(DAY, F.to_date("date_hour"))
        _write(sums, f"{table}/batches/{RUN}={run}/{BATCH}={batch_id}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def _first_delivered(batch: DataFrame, table: str, run: str, batch_id: int, event_id: str, event_time: str) -> DataFrame:
    """The events of a batch that no complete batch has counted; rows without an id or a time are all kept.

    Exact, and without state: an anti join with the ids of just the days that the batch has, both dealt by
    day and id. The ids of this batch are written first; they count as delivered only when its sums are
    complete, too, so that a crash in between neither loses events nor counts them twice.
    """
    spark = batch.sparkSession
    days = [r[0] for r in batch.select(F.to_date(event_time)).distinct().collect() if r[0] is not None]
    ids = read_if_there(spark, f"{table}/ids", IDS).where(F.col(DAY).isin(days))
    done = _complete(spark, table)
    unfinished = [
        (other, number)
        for other in _named(spark, f"{table}/ids", RUN)
        for number in map(int, _named(spark, f"{table}/ids/{RUN}={other}", BATCH))
        if (other, number) == (run, batch_id)
        or number > done.get(other, -1)
        and not exists(spark, f"{table}/batches/{RUN}={other}/{BATCH}={number}/_SUCCESS")
    ]
    ids = ids.where(~_any((F.col(RUN) == r) & (F.col(BATCH) == b) for r, b in unfinished))
    known = ids.select(F.col(DAY).alias("known_day"), F.col("id").alias("known_id"))
    told = batch.withColumns({"own_day": F.to_date(event_time), "own_id": F.col(event_id).cast("string")})
    none = F.col("own_id").isNull() | F.col("own_day").isNull()
    fresh = told.where(~none).dropDuplicates(["own_day", "own_id"])
    same = (F.col("own_day") == F.col("known_day")) & (F.col("own_id") == F.col("known_id"))
    fresh = fresh.join(known, same, "left_anti")
    counted = fresh.select(F.col("own_id").alias("id"), F.col("own_day").alias(DAY))
    _write(counted, f"{table}/ids/{RUN}={run}/{BATCH}={batch_id}")
    return fresh.union(told.where(none)).drop("own_day", "own_id")


def read_rollup(spark: SparkSession, table: str, spec: ReportSpec | None = None) -> DataFrame:
    """The rolled-up fact rows; with a spec those of its two days, whose files alone are read.

    A table without a batch yet has no rows.
    """
    done = _complete(spark, table)
    batches = read_if_there(spark, f"{table}/batches", ROLLUP)
    batches = batches.where(~_any((F.col(RUN) == run) & (F.col(BATCH) <= upto) for run, upto in done.items()))
    compacted = _read_parts(spark, table, _live(_parts(spark, table), done))
    return as_fact(batches.drop(BATCH).union(compacted.drop(*COVERED)), spec, DAY)


class Part(NamedTuple):
    run: str
    level: int
    first: int
    upto: int
    day: str

    @property
    def folder(self) -> str:
        return f"{RUN}={self.run}/{LEVEL}={self.level}/{FIRST}={self.first}/{UPTO}={self.upto}/{DAY}={self.day}"


def compact_rollup(spark: SparkSession, table: str, clean: bool = True) -> None:
    """Adds up all batches of each run but the newest, which may be run again, day by day in levels.

    The closed batches become a part of level 0 on each day that they have rows of. When `FAN` parts of a
    level have come together on a day, they become one of the next level. So a row is written again once a
    level, which is as often as the logarithm of the number of compactions; days that no batch has touched
    keep their files, and a day has fewer than `FAN` parts of each level.

    Parts are written first, then the compaction is noted as complete, and only then are old files removed:
    after a crash in between, readers still take the former ones. Readers that have listed files before they
    are removed fail; with `clean` false they stay until the next compaction.
    """
    done = _complete(spark, table)
    for run in _named(spark, f"{table}/batches", RUN):
        ids = [int(i) for i in _named(spark, f"{table}/batches/{RUN}={run}", BATCH)]
        closed = sorted(i for i in ids if done.get(run, -1) < i < max(ids))
        if not closed:
            continue
        first, upto = done.get(run, -1) + 1, closed[-1]
        rows = spark.read.schema(ROLLUP).parquet(f"{table}/batches")
        rows = rows.where((F.col(RUN) == run) & F.col(BATCH).between(first, upto)).drop(BATCH)
        live = [part for part in _live(_parts(spark, table), done) if part.run == run]
        merges: dict[tuple[int, int], list[tuple[str, list[Part]]]] = {}
        for day in sorted(str(r[DAY]) for r in rows.select(DAY).distinct().collect()):
            older = _to_merge([part for part in live if part.day == day])
            level = max((part.level + 1 for part in older), default=0)
            start = min((part.first for part in older), default=first)
            merges.setdefault((level, start), []).append((day, older))
        for (level, start), of_days in merges.items():
            older = _read_parts(spark, table, [part for _, parts in of_days for part in parts])
            merged = rows.where(F.col(DAY).isin([day for day, _ in of_days])).union(older.drop(*COVERED))
            sums = hour_totals(merged, HOUR_KEYS).withColumn(DAY, F.to_date("date_hour"))
            _write(sums, f"{table}/compacted/{RUN}={run}/{LEVEL}={level}/{FIRST}={start}/{UPTO}={upto}")
        # One file of one row, which is there or not.
        note = spark.range(1).select(F.lit(run).alias(RUN), F.lit(upto).cast("bigint").alias(UPTO))
        note.write.mode("append").parquet(f"{table}/compactions")
    if clean:
        _clean(spark, table)


def _to_merge(parts: list[Part]) -> list[Part]:
    """A day's parts that go into a new one: level after level, as long as one is full with it."""
    merged: list[Part] = []
    level = 0
    while len(same := [part for part in parts if part.level == level]) >= FAN - 1:
        merged += same
        level += 1
    return merged


def _clean(spark: SparkSession, table: str) -> None:
    """Removes what complete compactions stand for, and parts of one that was not completed."""
    done = _complete(spark, table)
    for run, upto in done.items():
        for number in _named(spark, f"{table}/batches/{RUN}={run}", BATCH):
            if int(number) <= upto:
                remove(spark, f"{table}/batches/{RUN}={run}/{BATCH}={number}")
    parts = _parts(spark, table)
    for part in set(parts) - set(_live(parts, done)):
        remove(spark, f"{table}/compacted/{part.folder}")


def _live(parts: list[Part], done: dict[str, int]) -> list[Part]:
    """Of each run and day, the parts of complete compactions that lie in no larger one."""
    by_day: dict[tuple[str, str], list[Part]] = {}
    for part in parts:
        if part.upto <= done.get(part.run, -1):
            by_day.setdefault((part.run, part.day), []).append(part)
    return [
        part
        for same in by_day.values()
        for part in same
        if not any(p != part and p.first <= part.first and part.upto <= p.upto for p in same)
    ]


def _parts(spark: SparkSession, table: str) -> list[Part]:
    """From the names of the files, which Spark lists."""
    names = (RUN, *COVERED, DAY)
    found = set()
    for file in read_if_there(spark, f"{table}/compacted", COMPACTED).inputFiles():
        named = dict(step.split("=", 1) for step in file.split("/") if step.split("=", 1)[0] in names and "=" in step)
        found.add(Part(named[RUN], int(named[LEVEL]), int(named[FIRST]), int(named[UPTO]), named[DAY]))
    return sorted(found)


def _read_parts(spark: SparkSession, table: str, parts: list[Part]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], COMPACTED)
    base = f"{table}/compacted"
    return spark.read.schema(COMPACTED).option("basePath", base).parquet(*(f"{base}/{part.folder}" for part in parts))


def _complete(spark: SparkSession, table: str) -> dict[str, int]:
    notes = read_if_there(spark, f"{table}/compactions", COMPACTIONS)
    return {r[RUN]: r.upto for r in notes.groupBy(RUN).agg(F.max(UPTO).alias(UPTO)).collect()}


def _named(spark: SparkSession, folder: str, column: str) -> list[str]:
    """The values of a partition column that a folder is divided by."""
    return [name.split("=", 1)[1] for name in folders(spark, folder) if name.startswith(f"{column}=")]


def read_if_there(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """No rows from a folder that nothing has been written to yet."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def _any(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result |= condition
    return result


def _write(sums: DataFrame, folder: str) -> None:
    writer = sums.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(DAY).parquet(folder)


def hour_totals(fact: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Exact sums in the rollup's types; revenue with more decimals than these hold is refused."""
    revenue = fact.schema["revenue"].dataType
    if not isinstance(revenue, T.DecimalType) or revenue.scale > REVENUE_SCALE:
        raise ValueError(f"revenue is {revenue.simpleString()}, not a decimal of scale {REVENUE_SCALE} at most")
    kinds = {field.name: field.dataType for field in SUMS}
    sums = [F.sum(c).cast(kinds[c]).alias(c) for c in FACT_COLUMN.values()]
    return fact.groupBy(*keys).agg(*sums).select(*(c for c in kinds if c in (*keys, *FACT_COLUMN.values())))


def windowed_totals(
    stream: DataFrame, lookback_days: int = ReportSpec.lookback_days, horizon: str | None = None
) -> DataFrame:
    """Hourly sums of a stream of fact rows as a stateful window aggregation.

    State is bounded by `horizon`; rows later than that are dropped, which is why the rollup above
    does not use it. If not given it is the reports' lookback and a day, so that all hours that they
    read stay open. Windows are cut on the session's clock, which therefore has to be UTC.
    """
    horizon = horizon or f"{lookback_days + 1} days"
    if stream.sparkSession.conf.get("spark.sql.session.timeZone") not in UTC:
        raise ValueError("set spark.sql.session.timeZone to UTC")
    timed = stream.withColumn("event_time", F.col("date_hour").cast("timestamp"))
    hour = F.window("event_time", "1 hour")
    sums = [F.sum(c).alias(c) for c in FACT_COLUMN.values()]
    totals = (
        timed.withWatermark("event_time", horizon).groupBy(hour, "brand", "feature", "source").agg(*sums)
    )
    return totals.select(
        "brand",
        "feature",
        "source",
        F.col("window.start").cast("timestamp_ntz").alias("date_hour"),
        *FACT_COLUMN.values(),
    )
