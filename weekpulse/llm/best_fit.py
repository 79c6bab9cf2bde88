"""Documents packed into sequences of a fixed size, by best fit over a histogram of lengths.

1. Texts are encoded once, by the tokenizers library's model over its pieces of text, which are remembered,
   since most come again. A document longer than a sequence is cut into full pieces, of which only the
   first may be shorter. The pieces (their place, length and checksum, no ids) are written to the shared
   folder. With them goes the task that made them and how many of the same length it had made before.
2. Pieces are counted by task and length; running sums over tasks turn the place within the task into a
   rank within the length, although no task ever holds all pieces of a length.
3. The plan is made from the number of pieces of each length, at most as many numbers as a sequence has
   places: lengths from long to short, each into the open sequences with the least room that holds it.
   Sequences with equal room are one range of numbers, so a whole range takes a length at once. The plan
   is a list of slots (length, first rank, sequences, pieces in each, offset). Each range of sequences
   has at most 44 different lengths (1 + ... + 44 = 990), and each length opens at most three ranges,
   so for 1,024 places there are at most 135,168 slots, whatever the number of documents: it is broadcast.
4. Each piece finds its slot by length and rank.

NULL text is empty; every document ends with ``end_id``, so an empty one has one place. Rows that repeat,
and NULL ids, are documents of their own. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpulse.llm.byte_bpe import Memo, byte_letters, parsed, parts, read_vocabulary
from weekpulse.llm.tables import written

SIZE, END_ID = 1024, 2
PIECE = "piece int, start long, length long, ids_crc32 long, task int, local long"
PLACE = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def encoder(content: bytes) -> Memo:
    """The tokenizer's ids of a piece, 32 bits each and little-endian."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(content).model
    letters = byte_letters()

    def ids(piece: str) -> bytes:
        found = [token.id for token in model.tokenize(piece.encode().decode("latin-1").translate(letters))]
        return struct.pack(f"<{len(found)}I", *found)

    return Memo(ids)


def encoded(text: str, content: bytes) -> bytes:
    ids = encoder(content).__getitem__
    return b"".join(
        struct.pack("<I", part) if isinstance(part, int) else b"".join(map(ids, part))
        for part in parts(text, parsed(content))
    )


def cuts(length: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document."""
    first = length % size
    whole = [(start, size) for start in range(first, length, size)]
    return [(0, first), *whole] if first else whole


def pieces(docs: DataFrame, content, size: int, end_id: int) -> DataFrame:
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(PIECE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, end = TaskContext.get().partitionId(), [0] * (size + 1), struct.pack("<I", end_id)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1)):
                ids = encoded(text.as_py(), content.value) + end
                for number, (start, length) in enumerate(cuts(len(ids) // 4, size)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append(row)
                    found.append((number, start, length, crc, task, made[length]))
                    made[length] += 1
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found), ARROW_PIECE)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], schema.names)
        encoder(content.value).forget()

    return docs.mapInArrow(run, schema)


ARROW_PIECE = [
    pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()),
    pa.field("ids_crc32", pa.int64()), pa.field("task", pa.int32()), pa.field("local", pa.int64()),
]


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots: length, first rank, first sequence, pieces in each sequence, offset."""
    room: dict[int, list[tuple[int, int]]] = {}  # places left: ranges (first sequence, number)
    slots, sequences = [], 0
    for length in sorted((n for n, count in counts.items() if count), reverse=True):
        left, rank = counts[length], 0
        # Changed ranges have less room than this length needs, or are the last of it.
        for free in sorted(r for r in room if r >= length):
            ranges = room.pop(free)
            while ranges and left:
                first, n = ranges.pop()
                each = free // length
                used = min(n, left // each)
                if used < n:
                    ranges.append((first + used, n - used))
                if not used:
                    # Fewer pieces are left than one sequence holds.
                    each, used = left, 1
                    first, n = ranges.pop()
                    if n > 1:
                        ranges.append((first + 1, n - 1))
                slots.append((length, rank, first, each, size - free))
                room.setdefault(free - each * length, []).append((first, used))
                rank, left = rank + used * each, left - used * each
            if ranges:
                room.setdefault(free, []).extend(ranges)
            if not left:
                break
        each = size // length
        for in_each, n in ((each, left // each), (left % each, 1)):
            if in_each and n:
                slots.append((length, rank, sequences, in_each, 0))
                room.setdefault(size - in_each * length, []).append((sequences, n))
                rank, sequences = rank + in_each * n, sequences + n
    return slots


def packed(
    docs: DataFrame, vocabulary_path: str, size: int = SIZE, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Each piece with the sequence it is in and its place there."""
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    made = written(pieces(rows, content, size, end_id), "pieces")
    by_task = written(made.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(before, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank")
    )
    schema = T.StructType([ranked.schema["doc_id"], *T._parse_datatype_string(PLACE).fields])
    slots = np.array(sorted(plan(counts, size)), np.int64).reshape(-1, 5)
    slots = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_of, rank_of, sequence_of, each_of, offset_of = slots.value.T
        # The first slot of each length, and within it the last that starts no later than the rank.
        keys = length_of * (1 << 50) + rank_of
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1
            within = rank - rank_of[at]
            sequence = sequence_of[at] + within // each_of[at]
            offset = offset_of[at] + within % each_of[at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(place, schema)
