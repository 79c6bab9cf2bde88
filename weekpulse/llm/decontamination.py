"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton has every run of words of every item. A document's words are streamed through it; after
each word the state gives the longest run ending there that some item has. A run of ``window`` words
or more is hit as a whole, and so is a whole item of fewer words. Items come to the driver as text, up to
``MOST_BYTES`` (a benchmark larger than that is refused), and are broadcast in blocks of ``BLOCK_BYTES``;
each block has its own automaton, so that memory stays bounded. A Python worker keeps two of them; with
more blocks each is built once for every Arrow batch and all texts of the batch are streamed through it.
A text longer than ``STRETCH`` is read in parts, the state going on from one to the next.

Words are runs of digits, a-z (A-Z lower-cased) and characters outside ASCII. NULL and empty texts have
no words, as have NULL items; such items never occur. A NULL item id counts as one id, shown as an
empty string. Repeated items count once by id; repeated documents are treated one by one. Empty tables
give no rows, or no hits. Extra columns are kept as they are by ``decontaminated``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpulse.llm.tables import by_batch

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
NOT_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")
MOST_BYTES = 256_000_000
BLOCK_BYTES = 2_000_000
PART_WORDS = 50_000
STRETCH = 1 << 20
HITS = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def words_of(data: bytes) -> Iterator[list[bytes]]:
    start = 0
    while start < len(data):
        cut = NOT_WORD.search(data, start + STRETCH)
        end = cut.start() if cut else len(data)
        yield WORD.findall(data, start, end)
        start = end


class Automaton:
    """All runs of words of the items; ``items`` and ``whole`` have the items of the states that matter."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.following: list[dict[bytes, int]] = [{}]
        self.link, self.longest = [-1], [0]
        paths = []
        for item, text in items:
            words = [w for part in words_of(text) for w in part]
            state, path = 0, []
            for word in words:
                state = self.extended(state, word)
                path.append(state)
            paths.append((item, path))
        states = range(len(self.link))
        # For each state that of the last ``window`` words; below, the short items that end there.
        self.at_window = [self.up_to(state) for state in states]
        self.items: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        for item, path in paths:
            if 0 < len(path) < window:
                whole.setdefault(path[-1], set()).add(item)
            for state in path[window - 1 :]:
                self.items.setdefault(self.at_window[state], set()).add(item)
        self.whole = whole
        self.shorts: list[tuple[int, ...]] = [()] * len(self.link)
        for state in sorted(states, key=self.longest.__getitem__):
            above = self.shorts[self.link[state]] if state else ()
            self.shorts[state] = (state, *above) if state in whole else above
        self.least = min([window, *(self.longest[state] for state in whole)])

    def extended(self, last: int, word: bytes) -> int:
        """The state of one item's words so far and the next one."""
        following, link, longest = self.following, self.link, self.longest
        known = following[last].get(word)
        if known is not None:
            if longest[known] == longest[last] + 1:
                return known
            return self.split(last, word, known)
        state = len(link)
        following.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in following[at]:
            following[at][word] = state
            at = link[at]
        if at >= 0:
            other = following[at][word]
            link[state] = other if longest[other] == longest[at] + 1 else self.split(at, word, other)
        return state

    def split(self, at: int, word: bytes, state: int) -> int:
        """A copy of the state for its shorter runs only."""
        copy = len(self.link)
        self.following.append(dict(self.following[state]))
        self.longest.append(self.longest[at] + 1)
        self.link.append(self.link[state])
        self.link[state] = copy
        while at >= 0 and self.following[at].get(word) == state:
            self.following[at][word] = copy
            at = self.link[at]
        return copy

    def up_to(self, state: int) -> int:
        while state > 0 and self.longest[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; first and last word of each run hit; items that occur."""
        following, link, longest, least = self.following, self.link, self.longest, self.least
        state = length = n = 0
        spans: list[list[int]] = []
        ended: set[int] = set()
        for part in words_of(text):
            for at, word in enumerate(part, n):
                target = following[state].get(word)
                while target is None and state:
                    state = link[state]
                    length = longest[state]
                    target = following[state].get(word)
                if target is None:
                    length = 0
                    continue
                state = target
                length += 1
                if length < least:
                    continue
                hit = 0
                if length >= self.window:
                    hit = length
                    ended.add(self.at_window[state])
                for short in self.shorts[state]:
                    if longest[short] <= length:
                        hit = max(hit, longest[short])
                        ended.add(~short)
                if hit:
                    first = at - hit + 1
                    while spans and spans[-1][1] >= first - 1:
                        first = min(first, spans.pop()[0])
                    spans.append([first, at])
            n += len(part)
        found = [self.whole[~x] if x < 0 else self.items[x] for x in ended]
        return n, [(a, b) for a, b in spans], set().union(*found)


@functools.lru_cache(maxsize=2)
def automaton(items: tuple[tuple[str, bytes], ...], window: int) -> Automaton:
    return Automaton(list(items), window)


def blocks_of(items: DataFrame, window: int, id_col: str, text_col: str) -> list[tuple]:
    """Items in blocks; a long one in parts that share ``window - 1`` words, so that no window is lost."""
    rows = items.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col
    )
    blocks, block, size, total = [], [], 0, 0
    for item, text in rows.toLocalIterator():
        words = [w for part in words_of(text.encode().lower()) for w in part]
        total += sum(map(len, words))
        if total > MOST_BYTES:
            raise ValueError(f"items with more than {MOST_BYTES} bytes")
        for start in range(0, max(1, len(words) - window + 1), PART_WORDS):
            part = b" ".join(words[start : start + PART_WORDS + window - 1])
            if block and size + len(part) > BLOCK_BYTES:
                blocks.append(tuple(block))
                block, size = [], 0
            block.append((item, part))
            size += len(part)
    return [*blocks, tuple(block)] if block or not blocks else blocks


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def all_hits(texts: list[bytes], blocks: list[tuple], window: int) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text its words, the runs hit and the items; block by block, each automaton built once for all texts."""
    n_words = [0] * len(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        own = automaton(block, window)
        for k, text in enumerate(texts):
            n_words[k], found, names = own.hits(text)
            spans[k] += found
            items[k] |= names
    return [(n, merged_spans(found), names) for n, found, names in zip(n_words, spans, items)]


def benchmark_hits(
    docs: DataFrame, items: DataFrame, window: int = 10,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """For each document its words, the runs of words hit and the ids of the items found."""
    blocks = docs.sparkSession.sparkContext.broadcast(blocks_of(items, window, item_id, item_text))

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = all_hits([x.as_py().encode().lower() for x in batch.column(1)], blocks.value, window)
        spans = [[{"first": a, "last": b} for a, b in found] for _, found, _ in rows]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                pa.array([sorted(x) for _, _, x in rows], pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "spans", "items"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")))
    return by_batch(rows, to_batch, HITS)


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the runs of words and what stands between their words."""
    out, done, at, places = [], 0, 0, iter(WORD.finditer(data.lower()))
    for first, last in spans:
        for _ in range(first - at):
            next(places)
        start = end = next(places)
        for _ in range(last - first):
            end = next(places)
        at = last + 1
        out.append(data[done : start.start()])
        done = end.end()
    return b"".join([*out, data[done:]])


def cleaned(texts: list[str | None], blocks: list[tuple], window: int, most_share: float) -> list[str | None]:
    """The texts without the runs hit; None for those with more than ``most_share`` of their words hit."""
    data: list[bytes | None] = [(text or "").encode() for text in texts]
    left, first_round = list(range(len(data))), True
    # Words that come together when a run is cut out may form a new one.
    while left:
        found = all_hits([data[k].lower() for k in left], blocks, window)
        again = []
        for k, (n, spans, _) in zip(left, found):
            if first_round and sum(b - a + 1 for a, b in spans) > most_share * n:
                data[k] = None
            elif spans:
                data[k] = without(data[k], spans)
                again.append(k)
        left, first_round = again, False
    return [text if text is None else text.decode() for text in data]


def decontaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, most_share: float = 0.5,
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows with hit runs cut out of the text; rows hit in over ``most_share`` of their words go."""
    blocks = docs.sparkSession.sparkContext.broadcast(blocks_of(items, window, item_id, item_text))
    at = docs.columns.index(text_col)
    placed = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(at).to_pylist()
        new = cleaned(old, blocks.value, window, most_share)
        texts = pa.array([x if x is None else y for x, y in zip(old, new)], pa.string())
        kept = pa.array([y is not None for y in new])
        return batch.set_column(at, batch.schema.field(at), texts).filter(kept)

    return by_batch(placed, to_batch, placed.schema).toDF(*docs.columns)
