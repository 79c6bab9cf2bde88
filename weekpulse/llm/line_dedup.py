"""Line dedup: lines that several documents share stay in the first of them only.

Each text is split at line ends; a line's key is the line stripped of white space at both ends, A-Z in
lower case. Keys of ``shortest`` code points or more go, as 128-bit hashes and once a document, to one
count of distinct documents a hash. Of keys in ``documents`` documents or more, all lines go except in
the document with the smallest id. The other lines are put together again by position.

Only hashes and ids are shuffled for the count, combined before it; the repeated keys are written to the
shared folder, so that the join back starts from files and its hot keys can be split (or the table
broadcast, when it is found small). Text is shuffled once, to meet its document's dropped keys.

NULL and empty texts are one empty line. A row without id is no document: its lines are not counted and
all stay. Rows that repeat an id are one document, each with its own result. Extra columns pass through
(n_lines and n_dropped excepted, which are replaced). An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from weekpulse.llm.tables import by_batch, written

SPACE = " \t\n\x0b\x0c\r"


def key_of(line: str, shortest: int) -> bytes | None:
    line = line.strip(SPACE)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= shortest else None


def keys_of(text: str, shortest: int) -> set[bytes]:
    keys = {key_of(line, shortest) for line in text.split("\n")}
    keys.discard(None)
    return keys


def shared_keys(keys: DataFrame, documents: int) -> DataFrame:
    """Of (id, key) rows the keys in so many different documents, each with the smallest id."""
    if documents == 2:
        counted = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        return counted.where("first < last").select("key", "first")
    counted = keys.groupBy("key", "id").count().groupBy("key")
    return counted.agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= documents).drop("n")


def line_dedup(
    docs: DataFrame, documents: int = 2, shortest: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows with the kept lines as their text, n_lines (before) and n_dropped."""
    kind = docs.schema[id_col].dataType

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [keys_of(x.as_py(), shortest) for x in batch.column(1)]
            rows = pa.array([k for k, own in enumerate(keys) for _ in own], pa.int64())
            flat = pa.array([key for own in keys for key in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), flat], ["id", "key"])

    keys = (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(emit, StructType([StructField("id", kind), StructField("key", BinaryType())]))
    )
    shared = written(shared_keys(keys, documents), "shared-lines")
    drops = (
        keys.join(shared, "key")
        .where(F.col("id") != F.col("first"))
        .groupBy("id")
        .agg(F.collect_set("key").alias("keys"))
    )
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    at, whose = names.index(text_col), f"c{names.index(id_col)}"
    places = [f"c{k}" for k in range(len(names))]
    placed = docs.toDF(*places)
    joined = placed.join(drops, F.col(whose) == F.col("id"), "left").drop("id")

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, before, dropped = [], [], []
        for text, gone in zip(batch.column(at), batch.column(len(names))):
            lines = (text.as_py() or "").split("\n")
            gone = set(gone.as_py() or ())
            kept = [x for x in lines if key_of(x, shortest) not in gone] if gone else lines
            texts.append("\n".join(kept))
            before.append(len(lines))
            dropped.append(len(lines) - len(kept))
        columns = [*batch.columns[:-1], pa.array(before, pa.int64()), pa.array(dropped, pa.int64())]
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, [*places, "n_lines", "n_dropped"])

    schema = StructType([*placed.schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return by_batch(joined, to_batch, schema).toDF(*names, "n_lines", "n_dropped")
