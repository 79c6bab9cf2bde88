"""Exact substring dedup: every byte inside a string of ``LENGTH`` bytes that also starts elsewhere goes.

The method is the merge of Burrows-Wheeler transforms by interleave refinement: starting at the right
end, each step puts the symbol before every suffix (its BWT symbol) in front, and a stable partition of
the present interleave of all shards by that symbol is the interleave one symbol deeper. Common
prefixes come along: two neighbours in the new order share one more than the least common prefix
between them in the old order. No suffix is ever compared or sorted anew.

To spread this over a cluster, suffixes are aligned at anchors. The anchor of a window (``LENGTH`` bytes)
is its leftmost ``GRAM``-byte string of least hash; equal windows have equal anchors at equal offsets. So:

1. Anchors are counted over all texts (partial sums before the shuffle). One that stands at a single
   place settles its windows: none is repeated.
2. The windows of one anchor place form a segment (269 bytes on average). Segments that are equal are
   repeated as a whole; within a text that is seen at once, across texts by a count over hashes.
3. What is left are different segments around equal anchors. They are dealt by anchor into
   tasks of about ``TASK_BYTES``; each task merges its shards (the segments of all texts, aligned at the
   anchor) column by column from right to left, and windows with a neighbour that shares ``LENGTH``
   bytes or more are repeated. An anchor with more than ``most_segments`` different segments does not go
   to one task: its windows are counted one by one by 128-bit hash, spread over all tasks.
4. Each text meets its ranges, and the bytes in them are cut.

NULL text counts as empty: 0 bytes. Rows that repeat (id and text) are places of their own, so that both
lose what they share; they get equal results. A NULL id is an id like others. Texts of any length are
worked through in stretches. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpulse.llm.tables import by_batch, written

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM + 1
STRETCH = 1 << 18
TASK_BYTES = 8_000_000
BYTE_HASH = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACES = "anchor long, segment long, doc_id long, row int, start int, n int, offset int"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, from hashes of half as many."""
    hashes, n = BYTE_HASH[data], 1
    while n < GRAM:
        left = hashes[:-n]
        hashes = (left * MIX) ^ (hashes[n:] + (left >> np.uint64(29)))
        n *= 2
    hashes ^= hashes >> np.uint64(32)
    return hashes * MIX


def least_ahead(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of each REACH hashes in a row and its first place."""
    least, place, n = hashes, np.arange(len(hashes)), 1

    def joined(shift: int):
        take = least[shift:] < least[:-shift]
        return np.where(take, least[shift:], least[:-shift]), np.where(take, place[shift:], place[:-shift])

    while 2 * n <= REACH:
        least, place = joined(n)
        n *= 2
    if REACH > n:
        least, place = joined(REACH - n)
    return least, place


def segments(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each stretch: anchors, places of the anchors, first windows and numbers of windows."""
    windows = len(data) - LENGTH + 1
    for start in range(0, windows, STRETCH):
        stop = min(windows, start + STRETCH)
        least, place = least_ahead(gram_hashes(np.frombuffer(data, np.uint8, stop - start + LENGTH - 1, start)))
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        n = np.diff(np.append(first, stop - start))
        yield least[first], place[first] + start, first + start, n


def row_hash(data: bytes) -> int:
    """Tells rows of one id apart."""
    return xxhash.xxh3_64_intdigest(data) & 0x7FFFFFFF


def counted_anchors(texts: DataFrame) -> DataFrame:
    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [part[0] for text in batch.column(0) for part in segments(text.as_buffer().to_pybytes())]
        anchors, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n)], ["anchor", "n"])

    rows = by_batch(texts.select(F.col("text").cast("binary")), to_batch, "anchor long, n long")
    return rows.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def places_of(texts: DataFrame) -> DataFrame:
    """A row for each different segment of each text, and rows without anchor for what repeats in it."""

    def of_text(data: bytes) -> tuple[np.ndarray, ...]:
        parts = list(segments(data))
        if not parts:
            return ()
        anchors, at, first, n = (np.concatenate(x) for x in zip(*parts))
        own = [xxhash.xxh3_64_intdigest(data[a : a + k + LENGTH - 1]) for a, k in zip(first.tolist(), n.tolist())]
        own = np.array(own, np.uint64).view(np.int64)
        pairs = np.stack([anchors.view(np.int64), own], 1)
        _, kept, group, count = np.unique(pairs, axis=0, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[group.ravel()] > 1)
        # Segments next to each other that repeat in this text make one range.
        breaks = np.flatnonzero(np.append(True, np.diff(again) > 1)) if len(again) else again
        ends = np.append(breaks[1:] - 1, len(again) - 1) if len(again) else breaks
        start = first[again[breaks]]
        length = first[again[ends]] + n[again[ends]] - start
        return anchors[kept].view(np.int64), own[kept], first[kept], n[kept], at[kept] - first[kept], start, length

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {name: [] for name in ("anchor", "segment", "at", "row", "start", "n", "offset", "whole")}
        for k, text in enumerate(batch.column(1)):
            data = text.as_buffer().to_pybytes()
            found = of_text(data)
            if not found:
                continue
            anchor, own, first, n, offset, start, length = found
            rest = len(start)
            out["anchor"].append(np.append(anchor, np.zeros(rest, np.int64)))
            out["segment"].append(np.append(own, np.zeros(rest, np.int64)))
            out["at"].append(np.full(len(anchor) + rest, k))
            out["row"].append(np.full(len(anchor) + rest, row_hash(data)))
            out["start"].append(np.append(first, start))
            out["n"].append(np.append(n, length))
            out["offset"].append(np.append(offset, np.zeros(rest, np.int64)))
            out["whole"].append(np.append(np.zeros(len(anchor), bool), np.ones(rest, bool)))
        cat = {name: np.concatenate(x) if x else np.empty(0, np.int64) for name, x in out.items()}
        whole = cat["whole"].astype(bool)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(cat["anchor"], pa.int64(), mask=whole),
                pa.array(cat["segment"], pa.int64(), mask=whole),
                batch.column(0).take(pa.array(cat["at"], pa.int64())),
                *(pa.array(cat[name].astype(np.int32)) for name in ("row", "start", "n", "offset")),
            ],
            ["anchor", "segment", "doc_id", "row", "start", "n", "offset"],
        )

    return by_batch(texts.select("doc_id", F.col("text").cast("binary")), to_batch, PLACES)


def least_between(values: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The least of values[before + 1 .. after] for each pair."""
    gap = after - before
    out = values[after]
    far = np.flatnonzero(gap > 1)
    if len(far):
        level, table, left = 0, values, gap[far]
        deepest = int(left.max()).bit_length() - 1
        own = np.frexp(left.astype(float))[1] - 1
        for level in range(deepest + 1):
            here = own == level
            if here.any():
                start, stop = before[far[here]] + 1, after[far[here]] + 1 - (1 << level)
                out[far[here]] = np.minimum(table[start], table[stop])
            table = np.minimum(table[: -(1 << level)], table[1 << level :])
    return out


def repeated_windows(group: np.ndarray, data: list[bytes], offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of segments aligned at their anchors, the windows (segment, first byte) that another one has.

    ``group`` tells the anchors apart; offset is the anchor's place in its segment.
    """
    lengths = np.array([len(x) for x in data])
    text = np.frombuffer(b"".join(data), np.uint8)
    anchor_at = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + offset
    left, right = -offset, lengths - offset
    enters = np.argsort(-right, kind="stable")
    entry = right[enters]
    order, common = np.empty(0, np.int64), np.empty(0, np.int64)
    owners, windows, entered = [], [], 0
    for column in range(int(right.max()) - 1, int(left.min()) - 1, -1):
        stop = np.searchsorted(-entry, -column, side="left")
        fresh = enters[entered:stop]
        entered = stop
        # The present interleave, then those whose last byte stands in this column.
        stay = np.flatnonzero(left[order] <= column)
        old = np.concatenate([stay, np.full(len(fresh), -1)])
        now = np.concatenate([order[stay], fresh])
        if not len(now):
            order, common = now, np.empty(0, np.int64)
            continue
        key = (group[now] << 8) | text[anchor_at[now] + column]
        moved = np.argsort(key, kind="stable")
        key, old, now = key[moved], old[moved], now[moved]
        shared = np.zeros(len(now), np.int64)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        shared[same] = 1
        both = same[(old[same] >= 0) & (old[same - 1] >= 0)]
        if len(both):
            shared[both] = np.minimum(LENGTH, 1 + least_between(common, old[both - 1], old[both]))
        full = shared >= LENGTH
        full[:-1] |= full[1:]
        if full.any():
            found = now[full]
            owners.append(found)
            windows.append(column - left[found])
        order, common = now, shared
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *owners]), np.concatenate([empty, *windows])


def runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows next to each other as (owner, first, number)."""
    if not len(owner):
        return owner, at, at
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(at) != 1))
    first = np.flatnonzero(new)
    return owner[first], at[first], np.diff(np.append(first, len(owner)))


def merged_task(table: pa.Table) -> pa.Table:
    _, group = np.unique(table.column("anchor").to_numpy(), return_inverse=True)
    data = table.column("bytes").to_pylist()
    owner, first, n = runs(*repeated_windows(group, data, table.column("offset").to_numpy().astype(np.int64)))
    start = table.column("start").to_numpy()[owner] + first
    picked = table.select(["doc_id", "row"]).take(pa.array(owner))
    return picked.append_column("start", pa.array(start.astype(np.int32))).append_column("n", pa.array(n.astype(np.int32)))


RANGES = "doc_id long, row int, start int, n int"


def with_bytes(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The segments' bytes, read from the one text that each is taken from."""
    lists = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "start", "n", "offset")).alias("wanted"))
    rows = joined_by_row(texts, lists, "inner")

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(3)
        parent = np.repeat(np.arange(batch.num_rows), [len(x) for x in own])
        flat = own.flatten()
        anchor, start, n, offset = flat.flatten()
        texts = [x.as_buffer() for x in batch.column(2)]
        cut = [
            texts[p][a : a + k + LENGTH - 1].to_pybytes()
            for p, a, k in zip(parent.tolist(), start.to_pylist(), n.to_pylist())
        ]
        at = pa.array(parent)
        return pa.RecordBatch.from_arrays(
            [anchor, pa.array(cut, pa.binary()), batch.column(0).take(at), batch.column(1).take(at), start, offset],
            ["anchor", "bytes", "doc_id", "row", "start", "offset"],
        )

    schema = "anchor long, bytes binary, doc_id long, row int, start int, offset int"
    # Copies of one row would give their segments twice.
    return by_batch(rows, to_batch, schema)


def joined_by_row(texts: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """(doc_id, row, text, and the ranges' last column)."""

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column(1)
        rows = pa.array([row_hash(x.as_buffer().to_pybytes()) for x in data], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), rows, data], ["doc_id", "row", "text"])

    keyed = by_batch(texts.select("doc_id", F.col("text").cast("binary")), to_batch, "doc_id long, row int, text binary")
    last = ranges.columns[-1]
    ranges = ranges.select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row"), last)
    return keyed.join(ranges, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")), how).select(
        "doc_id", "row", "text", last
    )


def hot_windows(rows: DataFrame) -> DataFrame:
    """The repeated windows of segments of anchors too frequent for one task, by a count of windows."""

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        parent, at, hashes = [], [], []
        for k, data in enumerate(batch.column(1)):
            data = data.as_buffer().to_pybytes()
            for first in range(len(data) - LENGTH + 1):
                parent.append(k)
                at.append(first)
                hashes.append(xxhash.xxh3_128_digest(data[first : first + LENGTH]))
        place = pa.array(parent, pa.int64())
        start = pa.array((batch.column(4).to_numpy()[parent] + np.array(at, np.int64)).astype(np.int32)) if parent else pa.array([], pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(place), pa.array(hashes, pa.binary()), batch.column(2).take(place), batch.column(3).take(place), start],
            ["anchor", "window", "doc_id", "row", "start"],
        )

    windows = by_batch(rows, to_batch, "anchor long, window binary, doc_id long, row int, start int")
    again = written(windows.groupBy("anchor", "window").count().where("count > 1").drop("count"), "hot-windows")
    return windows.join(again, ["anchor", "window"], "left_semi").select("doc_id", "row", "start", F.lit(1).alias("n"))


def repeated_ranges(texts: DataFrame, most_segments: int, task_bytes: int) -> DataFrame:
    """doc_id, row, first window and number of windows, for all windows that are repeated."""
    anchors = written(counted_anchors(texts), "anchors")
    places = places_of(texts)
    # Rows without anchor are ranges already.
    marked = places.join(anchors.withColumn("again", F.lit(True)), "anchor", "left").where("again OR anchor IS NULL")
    places = written(marked.drop("again"), "places")
    settled = places.where("anchor IS NULL")
    places = places.where("anchor IS NOT NULL")
    kinds = written(
        places.groupBy("anchor", "segment").agg(
            F.count("*").alias("places"), F.min(F.struct("doc_id", "row", "start", "n", "offset")).alias("one")
        ),
        "segments",
    )
    equal = places.join(kinds.where("places > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi")
    # Anchors with different segments, of which at least one stands at a single place.
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("places").alias("least"))
    groups = written(groups.where("kinds > 1 AND least = 1").select("anchor", "kinds"), "groups")
    different = kinds.join(groups, "anchor").select("anchor", "kinds", "one.*")
    size = groups.agg(F.sum("kinds"), F.max("kinds")).first()
    tasks = (size[0] or 0) * 300 // task_bytes + 1
    cold = with_bytes(different.where(F.col("kinds") <= most_segments), texts)
    merged = (
        cold.withColumn("task", F.pmod(F.xxhash64("anchor"), F.lit(tasks))).groupBy("task").applyInArrow(merged_task, RANGES)
    )
    ranges = settled.select("doc_id", "row", "start", "n").union(equal.select("doc_id", "row", "start", "n")).union(merged)
    if (size[1] or 0) > most_segments:
        hot = with_bytes(different.where(F.col("kinds") > most_segments), texts)
        ranges = ranges.union(hot_windows(written(hot, "hot-segments")))
    return ranges


def cut(data: bytes, starts: list[int], numbers: list[int]) -> tuple[bytes, int]:
    """What stays, and the number of runs that go."""
    out, done, spans = [], 0, 0
    reached = None
    for start, n in sorted(zip(starts, numbers)):
        end = start + n + LENGTH - 1
        if reached is None or start > reached:
            if reached is not None:
                done = reached
            out.append(data[done:start])
            spans += 1
            reached = end
        else:
            reached = max(reached, end)
    return b"".join([*out, data[reached or 0 :]]), spans


def suffix_dedup(
    docs: DataFrame, most_segments: int = 20_000, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ranges = repeated_ranges(texts, most_segments, task_bytes)
    lists = ranges.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, spans, kept = [], [], [], []
        for text, own in zip(batch.column(2), batch.column(3)):
            data = text.as_buffer().to_pybytes()
            starts, numbers = ([x.to_pylist() for x in own.values.flatten()] if own.is_valid else ([], []))
            left, n = cut(data, starts, numbers)
            sizes.append(len(data))
            removed.append(len(data) - len(left))
            spans.append(n)
            kept.append(left)
        numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *numbers, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )

    joined = joined_by_row(texts, lists, "left")
    return by_batch(joined, to_batch, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
