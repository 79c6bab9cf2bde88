"""Fact rows from an event log and its customer table.

An event counts for the segment (brand) of its user. Feature and source come from a number in the
event's properties.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpulse.functions.clock import moment, start_of_hour
from weekpulse.sources.fact import FACT_COLUMNS, report_days
from weekpulse.spec import Period, ReportSpec, read_for

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
CUSTOMERS = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)

N_FEATURES = 7
N_SOURCES = 3
AMOUNT = "decimal(18,2)"


def event_feed(spark: SparkSession, folder: str, spec: ReportSpec | None = None) -> DataFrame:
    return events_to_fact(read_events(spark, folder), read_customers(spark, folder), spec)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")


def read_customers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CUSTOMERS).parquet(f"{folder}/customer.parquet")


def events_to_fact(
    events: DataFrame, customers: DataFrame, spec: ReportSpec | None = None, day_column: str | None = None
) -> DataFrame:
    """With a spec, only events that its two periods can read.

    `day_column` names a date column of the log that holds the day of `ts`; with it only the report's
    days are read. Events and customers meet in one join by user: broadcast if the customers are
    small when they are read, else one shuffle of either side, in which adaptive execution splits a
    user with very many events. Events that `rejected` names are left out.
    """
    if spec is not None:
        if day_column is not None:
            events = events.filter(F.col(day_column).isin(report_days(spec)))
        events = events.filter(_readable(spec.today) | _readable(spec.last_week))
    brands = customers.select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("brand")
    )
    joined = _hourly_events(events).join(brands, "user_id")
    lane = F.col("lane")
    feature = F.concat(F.lit("feature_"), (lane % N_FEATURES).cast("string"))
    source = (
        F.when(lane % N_SOURCES == 0, "pre-install")
        .when(lane % N_SOURCES == 1, "FOTA")
        .otherwise("other")
    )
    fact = joined.withColumns({"feature": feature, "source": source}).select(*FACT_COLUMNS)
    return fact if spec is None else read_for(fact, spec)


def rejected() -> Column:
    """Why an event cannot count; NULL for one that can.

    Its number must be a whole one of 32 bits, and a purchase's amount, where there is one, must fit
    the revenue's type: NaN, infinite and too large amounts reject the event as a whole.
    """
    amount_lost = (F.col("event_type") == "purchase") & F.col("value").isNotNull() & _amount().isNull()
    return F.when(_number_in("props", "k").isNull(), "number").when(amount_lost, "amount")


def rejected_events(events: DataFrame) -> DataFrame:
    """How many events count and how many do not, by reason."""
    return events.groupBy(F.coalesce(rejected(), F.lit("counted")).alias("outcome")).agg(F.count("*").alias("n"))


def _readable(period: Period) -> Column:
    """The period in terms of the event time itself, so that the filter reaches the scan.

    An event counts at the start of its hour, so the whole hour of the period's end belongs to it.
    """
    if period.empty:
        return F.lit(False)
    end = period.end.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
    return (F.col("ts") >= moment(period.start)) & (F.col("ts") < moment(end))


def _hourly_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    # Feature and source both follow from this remainder.
    lane = _number_in("props", "k") % (N_FEATURES * N_SOURCES)
    return events.where(rejected().isNull()).select(
        "user_id",
        lane.alias("lane"),
        start_of_hour(F.col("ts")).alias("date_hour"),
        F.when(kind == "purchase", _amount()).otherwise(0).cast(AMOUNT).alias("revenue"),
        _one_if(kind == "view").alias("notification_shown"),
        _one_if(kind == "click").alias("experience_shown"),
        _one_if(kind == "purchase").alias("install_success"),
        _one_if(kind == "signup").alias("new_devices"),
    )


def _amount() -> Column:
    return F.col("value").try_cast(AMOUNT)


def _number_in(column: str, key: str) -> Column:
    """A whole number in a JSON object.

    Parsing JSON is most of the work per event. An object with just this number needs none; what is
    between its key and its end is no number for any other object, which is then parsed.
    """
    text, start = F.col(column), f'{{"{key}": '
    alone = F.substring(text, F.lit(len(start) + 1), F.length(text) - (len(start) + 1))
    number = F.when(text.startswith(start) & text.endswith("}"), alone.try_cast("int"))
    return F.coalesce(number, F.get_json_object(text, f"$.{key}").try_cast("int"))


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")
