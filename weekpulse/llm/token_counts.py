"""Token counts without token ids: a heap of adjacent pairs over a linked list of symbols.

The count of a piece is its number of bytes less the merges made. The pair of lowest rank, leftmost
first, is taken from the heap again and again; a pair whose symbols have changed since is skipped.

NULL text counts as empty: 0 bytes, 0 tokens. Rows are counted one by one, so repeated rows give
repeated results, an empty table gives none, and other columns are neither read nor kept.
"""

from __future__ import annotations

import functools
import heapq

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpulse.llm.byte_bpe import Memo, Vocabulary, parsed, parts, read_vocabulary
from weekpulse.llm.tables import by_batch

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def symbols_left(piece: bytes, vocabulary: Vocabulary) -> int:
    symbols = [vocabulary.ids[b] for b in piece]
    merges, end = vocabulary.merges, len(symbols)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = []
    for at in range(end - 1):
        merge = merges.get((symbols[at], symbols[at + 1]))
        if merge:
            heap.append((merge[0], at, merge[1]))
    heapq.heapify(heap)
    left = end
    while heap:
        rank, at, merged = heapq.heappop(heap)
        behind = after[at]
        # A symbol that was merged away is -1, and no merge has it.
        if behind >= end or merges.get((symbols[at], symbols[behind]), (None,))[0] != rank:
            continue
        symbols[at], symbols[behind] = merged, -1
        after[at] = following = after[behind]
        left -= 1
        if following < end:
            before[following] = at
            merge = merges.get((merged, symbols[following]))
            if merge:
                heapq.heappush(heap, (merge[0], at, merge[1]))
        previous = before[at]
        if previous >= 0:
            merge = merges.get((symbols[previous], merged))
            if merge:
                heapq.heappush(heap, (merge[0], previous, merge[1]))
    return left


@functools.lru_cache(maxsize=4)
def counter(content: bytes) -> Memo:
    vocabulary = parsed(content)
    return Memo(lambda piece: symbols_left(piece.encode(), vocabulary))


def count_tokens(text: str, content: bytes) -> int:
    counts = counter(content).__getitem__
    return sum(
        1 if isinstance(part, int) else sum(map(counts, part))
        for part in parts(text, parsed(content))
    )


def token_counts(
    docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """n_bytes, n_tokens and whether there are more than ``limit`` tokens, for each row."""
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        counts = pa.array([count_tokens(x.as_py(), content.value) for x in texts], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pc.binary_length(texts).cast(pa.int64()), counts, pc.greater(counts, limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")))
    return by_batch(rows, to_batch, SCHEMA, at_end=lambda: counter(content.value).forget())
