"""Reading the text tables, and the helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpulse.sources.shared import new_folder

# Rows of an Arrow batch. Texts are long, and a task holds a few batches in either process.
BATCH_ROWS = 2_000
SPACE = r"\x20\x09-\x0D"


def small_batches(spark: SparkSession) -> None:
    """For the session: Spark has no setting for a single plan."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and no other letter."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


ASCII_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id as text; NULL for a missing id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def by_batch(
    frame: DataFrame,
    to_batch: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    at_end: Callable[[], None] | None = None,
) -> DataFrame:
    """Each Arrow batch turned into one batch of results; ``at_end`` runs when a task is through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield to_batch(batch)
        if at_end:
            at_end()

    return frame.mapInArrow(run, schema)


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and no executor's loss matters."""
    spark = frame.sparkSession
    path = new_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
