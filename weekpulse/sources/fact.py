"""The hourly fact table as Parquet files or a catalog table, laid out by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpulse.spec import ReportSpec, read_for

FACT_SCHEMA = T.StructType(
    [
        T.StructField("brand", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("date_hour", T.TimestampNTZType()),
        T.StructField("revenue", T.DecimalType(18, 2)),
        T.StructField("notification_shown", T.LongType()),
        T.StructField("experience_shown", T.LongType()),
        T.StructField("install_success", T.LongType()),
        T.StructField("new_devices", T.LongType()),
    ]
)
FACT_COLUMNS = FACT_SCHEMA.fieldNames()
DAY = "event_date"


def read_fact(
    spark: SparkSession,
    path: str | None = None,
    table: str | None = None,
    spec: ReportSpec | None = None,
    day_column: str | None = None,
) -> DataFrame:
    """The fact columns of a Parquet folder or a table.

    `day_column` names a date column that holds the day of `date_hour`, such as the one `write_fact`
    lays tables out by. With it and a spec, only the two days of the report are read; the rows are
    then good for reports on these days only, and other reports on them are refused.
    """
    if (path is None) == (table is None):
        raise ValueError("give either a path or a table")
    return as_fact(spark.table(table) if path is None else spark.read.parquet(path), spec, day_column)


def as_fact(df: DataFrame, spec: ReportSpec | None = None, day_column: str | None = None) -> DataFrame:
    """The fact columns in types whose sums do not depend on how rows are spread over tasks."""
    missing = [c for c in FACT_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"not a fact table, columns missing: {missing}")
    columns = [_typed(field, df.schema[field.name].dataType) for field in FACT_SCHEMA]
    if spec is None or day_column is None:
        return df.select(*columns)
    if not isinstance(df.schema[day_column].dataType, T.DateType):
        raise ValueError(f"{day_column} is no date column")
    return read_for(df.filter(F.col(day_column).isin(report_days(spec))).select(*columns), spec)


def _typed(field: T.StructField, found: T.DataType) -> Column:
    """Decimals keep their scale. Floating-point numbers are refused: their sums are not exact."""
    column = F.col(field.name)
    if isinstance(found, T.NullType):
        return column.cast(field.dataType).alias(field.name)
    if isinstance(field.dataType, T.DecimalType):
        if isinstance(found, T.IntegralType):
            return column.cast("decimal(20,0)").alias(field.name)
        fits = isinstance(found, T.DecimalType)
    elif isinstance(field.dataType, T.LongType):
        fits = isinstance(found, T.IntegralType)
        column = column.cast("bigint")
    elif isinstance(field.dataType, T.TimestampNTZType):
        fits = isinstance(found, (T.TimestampNTZType, T.TimestampType))
        column = column if isinstance(found, T.TimestampNTZType) else column.cast("timestamp_ntz")
    else:
        fits = isinstance(found, T.StringType)
    if not fits:
        raise ValueError(f"{field.name} is {found.simpleString()}, not {field.dataType.simpleString()}")
    return column.alias(field.name)


def report_days(spec: ReportSpec) -> list:
    return [period.start.date() for period in spec.periods if not period.empty]


def write_fact(fact: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """By day, with the hours of a file close together. A day of any size is split by AQE.

    Mode `replace_days` replaces the days that `fact` has rows of and leaves all others.
    """
    by_day = fact.withColumn(DAY, F.to_date("date_hour")).hint("rebalance", DAY)
    writer = by_day.sortWithinPartitions(DAY, "date_hour").write
    if mode == "replace_days":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode).option("partitionOverwriteMode", "static")
    writer.partitionBy(DAY).parquet(path)
