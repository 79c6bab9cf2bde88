"""Fact tables laid out for how reports read them.

`write_clustered`: inside a day, rows lie along a space-filling curve over brand, feature and hour, so
that a row group holds few of each and a selection skips most of them, by the dictionaries, ranges and
bloom filters of the files. `write_buckets`: hourly sums bucketed by brand and feature, so that neither
the sums by these keys nor the join of two periods shuffles anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpulse.operators.measures import FACT_COLUMN
from weekpulse.sources.fact import DAY, FACT_COLUMNS

CODE_BITS = 8
ROW_GROUP_BYTES = 32 << 20
CLUSTERED_BY = ("brand", "feature")
HOUR_KEYS = ("brand", "feature", "source", "date_hour")


def on_curve(codes: list[Column], bits: int = CODE_BITS) -> Column:
    """The place on the Z-order curve: the codes' bits in turn, highest first."""
    n = len(codes)
    moved = [
        F.shiftleft(F.shiftright(code, bit).bitwiseAND(F.lit(1)), bit * n + n - 1 - k)
        for k, code in enumerate(codes)
        for bit in range(bits)
    ]
    return reduce(Column.bitwiseOR, moved)


def cluster_place() -> Column:
    """Texts by their hash, which needs no list of values; NULL is a value like others. Hours in their order."""
    texts = [F.pmod(F.xxhash64(c), F.lit(1 << CODE_BITS)) for c in CLUSTERED_BY]
    hour = F.coalesce(F.hour("date_hour"), F.lit(0)) * ((1 << CODE_BITS) // 32)
    return on_curve([code.cast("bigint") for code in (*texts, hour)])


def write_clustered(
    fact: DataFrame,
    path: str,
    files: int | None = None,
    mode: str = "errorifexists",
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """By day, as `write_fact`, and along the curve inside each; read by `read_fact` like any other.

    Rows are dealt by ranges of day and place, taken from a sample, to about `files` tasks (else as many
    as the session's shuffles have). The hash of the whole row comes last, so that a brand and feature
    with most rows of an hour is divided, too.
    """
    keys = [F.to_date("date_hour"), cluster_place(), F.xxhash64(*FACT_COLUMNS)]
    placed = fact.select(*FACT_COLUMNS, *(k.alias(name) for k, name in zip(keys, (DAY, "place", "rest"))))
    order = (DAY, "place", "rest")
    dealt = placed.repartitionByRange(*order) if files is None else placed.repartitionByRange(files, *order)
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in (*CLUSTERED_BY, "source")}
    (
        dealt.sortWithinPartitions(*order)
        .drop("place", "rest")
        .write.mode(mode)
        .options(**blooms, **{"parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(row_group_bytes)})
        .partitionBy(DAY)
        .parquet(path)
    )


def write_buckets(fact: DataFrame, table: str, buckets: int, path: str, mode: str = "errorifexists") -> None:
    """The rows' sums by brand, feature, source and `date_hour` as a table by day, bucketed by brand and feature.

    Reports add rows up, so the sums stand for the rows. A key has one row for each of its sources and hours
    then, however many rows it had, so no bucket is hot. There is one file for each bucket of a day.
    """
    sums = fact.groupBy(*HOUR_KEYS).agg(*(F.sum(c).alias(c) for c in FACT_COLUMN.values()))
    # Spark's own number of the bucket, so that each file is written by one task and days by different ones.
    bucket = F.pmod(F.hash(*CLUSTERED_BY), F.lit(buckets))
    (
        sums.withColumn(DAY, F.to_date("date_hour"))
        .repartition(DAY, bucket)
        .sortWithinPartitions(DAY, bucket, *HOUR_KEYS)
        .write.mode(mode)
        .option("path", path)
        .partitionBy(DAY)
        .bucketBy(buckets, *CLUSTERED_BY)
        .sortBy(*CLUSTERED_BY)
        .saveAsTable(table)
    )
