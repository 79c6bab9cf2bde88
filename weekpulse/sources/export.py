"""Results as files, unformatted, with a header and the report's time in the name."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("csv", "parquet")


# Texts come back as they were: nothing trimmed, line breaks and quotes inside quotes.
CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_path(folder: str, as_of: datetime, name: str = "metrics") -> str:
    return f"{folder.rstrip('/')}/{name}_{as_of:%Y%m%d_%H%M%S}"


def export(
    df: DataFrame,
    folder: str,
    as_of: datetime,
    name: str = "metrics",
    format: str = "csv",
    mode: str = "errorifexists",
) -> str:
    """Writes in parallel and gives the path, so that results of any size can be exported.

    `name` tells results of one time apart; one that is there already is not overwritten unless
    `mode` says so.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    path = export_path(folder, as_of, name)
    writer = df.write.mode(mode)
    if format == "csv":
        # NULL is written as nothing, an empty text in quotes.
        writer = writer.options(**CSV, quoteAll=False, emptyValue='""', nullValue="")
    writer.format(format).save(path)
    return path


def read_export(
    spark: SparkSession, path: str, schema: T.StructType, format: str = "csv"
) -> DataFrame:
    reader = spark.read.schema(schema)
    if format == "csv":
        # Stands for nothing between two commas; were it '', empty texts would turn NULL too.
        reader = reader.options(**CSV, multiLine=True, nullValue="\u0000")
    return reader.format(format).load(path)
