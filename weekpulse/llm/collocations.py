"""Phrases of words that stand together more often than their parts, from FM-indexes of word ids.

1. Each task collects the words of its texts, language by language, into shards of about ``SHARD`` symbols
   (a word's id in the shard, or 0 between pieces). A shard's index is the Burrows-Wheeler transform of its
   symbols and that of their reverse, over suffixes ordered by their first four symbols, which is all that
   phrases of up to four words need. The indexes are written to the shared folder: texts are read once. Their
   cells are packed by the task that makes them and unpacked by the one that counts, one shard at a time, so that
   Spark between them never holds more than small pieces: an executor's memory does not follow the input.
2. A phrase is a pair of intervals, one in either transform. All intervals of a shard are extended at once:
   left by the symbols of the first transform (words to pairs, three to four), right by those of the second
   (two to three). Each extension moves both intervals, and its size is the phrase's count.
3. Counts are added up over shards, a word at a time longer: first by ``KEY_BITS`` of a hash, which tells
   what may be frequent, then as strings, of these phrases alone, which decides. A phrase can only be frequent
   if its parts are, so a shard extends only phrases that may be. What may be is a bitmap of 2^``FILTER_BITS``
   places, the one thing broadcast: 8 MB for each length. Wrong hits only cost work.
4. What is frequent is joined to its parts by phrase, to longer phrases by what they contain, and ranked.

NULL text is empty and has no words; a NULL language is ``und``. Repeated rows count again, ids are not read,
nor are other columns. A word or text may be of any length; a text may begin in one shard and end in the next
only between pieces. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekpulse.llm.tables import written
from weekpulse.sources.shared import new_folder

UNKNOWN = "und"
MOST_WORDS = 4
SHARD = 1 << 19
KEY_BITS, FILTER_BITS = 40, 26
BUCKET = 1 << 15  # places in one of Spark's bitmaps
INDEX = "lang string, words binary, bwt binary, reverse_bwt binary"
GRAMS = "lang string, phrase string, n long"
ROWS_OUT = 50_000
SIZE_BYTES = 8  # of the length that stands before a packed cell
# Fixed value: the marks that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
PIECE_END = b"."
TO_PIECES = bytes.maketrans(ENDS, PIECE_END * len(ENDS))


def symbols(text: bytes) -> list[bytes]:
    """Words in lower case, and PIECE_END between pieces, which no word can be."""
    return text.lower().translate(TO_PIECES).replace(PIECE_END, b" . ").split()


def packed(cell: bytes) -> bytes:
    return len(cell).to_bytes(SIZE_BYTES, "little") + pa.Codec("zstd").compress(cell, asbytes=True)


def unpacked(cell: pa.Buffer) -> pa.Buffer:
    size = int.from_bytes(cell[:SIZE_BYTES].to_pybytes(), "little")
    return pa.Codec("zstd").decompress(cell[SIZE_BYTES:], size) if size else pa.py_buffer(b"")


def packed_ids(ids: np.ndarray) -> bytes:
    """Their first bytes, then all second ones and so on: the last ones are mostly 0."""
    return packed(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_ids(cell: pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(unpacked(cell), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


class Index(NamedTuple):
    """words: of ids 1, 2, ...; both transforms of the symbols (up to two words need only the first)."""

    words: list[bytes]
    bwt: np.ndarray
    reverse_bwt: np.ndarray | None = None


def transform(symbols: np.ndarray) -> np.ndarray:
    """The symbol before each suffix, with suffixes by their first four symbols, in a circle.

    Suffixes equal so far may stand in any order: a phrase's interval holds all of them or none.
    """
    pairs = symbols.astype(np.int64)
    pairs = pairs * (int(pairs.max()) + 1) + np.roll(pairs, -1)
    order = np.argsort(pairs)
    ordered = pairs[order]
    rank = np.empty_like(pairs)
    rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    return symbols[np.argsort(rank * (int(rank.max()) + 1) + np.roll(rank, -2)) - 1]


def fronts_of(bwt: np.ndarray) -> np.ndarray:
    """For each row the place of its suffix with the symbol of ``bwt`` put before it."""
    # Symbol and row in one number: the same order as a stable sort by symbol, and faster.
    order = bwt.astype(np.int64)
    order <<= 32
    order |= np.arange(len(bwt))
    order.sort()
    order &= 0xFFFFFFFF
    fronts = np.empty(len(order), np.int32)
    fronts[order] = np.arange(len(order), dtype=np.int32)
    return fronts


def shards(docs: DataFrame, shard: int) -> DataFrame:
    """Index rows of the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[defaultdict, list[np.ndarray]]] = {}
        length: Counter[str] = Counter()
        total = 0

        def close(lang: str) -> pa.RecordBatch:
            nonlocal total
            ids, parts = held.pop(lang)
            total -= length.pop(lang)
            all_symbols = np.concatenate([[0], *parts]).astype(np.int32)
            row = (
                lang,
                packed(b" ".join(list(ids)[1:])),
                packed_ids(transform(all_symbols)),
                packed_ids(transform(all_symbols[::-1])),
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.string(), pa.binary(), pa.binary(), pa.binary()))],
                ["lang", "words", "bwt", "reverse_bwt"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held:
                    ids = defaultdict(count().__next__)
                    ids[PIECE_END]  # id 0
                    held[lang] = ids, []
                ids, parts = held[lang]
                found = symbols(text.as_buffer().to_pybytes())
                own = np.fromiter(map(ids.__getitem__, found), np.int32, len(found))
                parts += [own, np.zeros(1, np.int32)]
                length[lang] += len(own) + 1
                total += len(own) + 1
                if length[lang] >= shard:
                    yield close(lang)
                elif total >= 4 * shard:
                    # Many languages, none of which fills a shard.
                    yield close(max(length, key=length.get))
        for lang in list(held):
            yield close(lang)

    return docs.mapInArrow(run, INDEX)


def extend(
    low: np.ndarray, size: np.ndarray, other: np.ndarray, bwt: np.ndarray, to_front: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each interval by each symbol of its part of ``bwt``: interval, symbol, low, size, other low.

    ``to_front`` is the place of each row's suffix with that symbol put before it. In the other
    transform the extended phrases lie in the old interval, in the order of their new symbols.
    """
    starts = np.cumsum(size) - size
    symbols = int(bwt.max()) + 1
    rows = np.repeat(low - starts, size)
    rows += np.arange(len(rows))
    key = np.repeat(np.arange(len(low)) * symbols, size)
    key += bwt[rows]
    order = np.argsort(key)
    key, rows = key[order], rows[order]
    del order
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    top = np.minimum.reduceat(rows, first) if len(first) else first
    interval = key[first] // symbols
    symbol = bwt[top]
    inside = symbol > 0
    return tuple(
        x[inside] for x in (interval, symbol, to_front[top], n, other[interval] + first - starts[interval])
    )  # type: ignore[return-value]


def rotated(hashes: np.ndarray, place: int) -> np.ndarray:
    by = 13 * place
    return (hashes << np.uint64(by)) | (hashes >> np.uint64(64 - by)) if by else hashes


class Known:
    """Whether the phrases of each length, as ids of a shard's words, may be frequent."""

    def __init__(self, lang: str, words: list[bytes], bits: dict[int, np.ndarray]):
        self.of_word = np.array([0, *(xxhash.xxh64_intdigest(w) for w in words)], np.uint64)
        self.of_lang = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
        self.bits = bits

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Hashes of rows of word ids, ``KEY_BITS`` long."""
        hashes = np.full(len(grams), self.of_lang)
        for place in range(grams.shape[1]):
            hashes ^= rotated(self.of_word[grams[:, place]], place)
        return (hashes & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self.keys(grams) & ((1 << FILTER_BITS) - 1)
        return ((self.bits[grams.shape[1]][at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def filter_of(keys: DataFrame) -> bytes:
    """A bit for each key's last ``FILTER_BITS``; Spark's bitmaps count from 1 on."""
    at = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    bitmaps = keys.groupBy(F.bitmap_bucket_number(at).alias("number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    bits = bytearray((1 << FILTER_BITS) // 8)
    for row in bitmaps.collect():
        bits[(row.number - 1) * BUCKET // 8 : row.number * BUCKET // 8] = row.bits
    return bytes(bits)


def grams(index: Index, known: Known, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``length`` words as ids, and their counts: only those whose parts ``known`` lets through."""
    counts = np.bincount(index.bwt, minlength=len(index.words) + 1)
    ids = np.arange(1, len(counts), dtype=np.int32)
    phrases, size = ids[:, None], counts[1:]
    if length == 1:
        return phrases, size
    low = np.cumsum(counts)[:-1]
    back_low = low
    fronts = {}
    for step in range(2, length + 1):
        kept = np.flatnonzero(known(phrases))
        phrases, low, back_low, size = phrases[kept], low[kept], back_low[kept], size[kept]
        to_left = step != 3
        bwt = index.bwt if to_left else index.reverse_bwt
        if to_left not in fronts:
            fronts[to_left] = fronts_of(bwt)
        if to_left:
            of, symbol, low, size, back_low = extend(low, size, back_low, bwt, fronts[to_left])
            phrases = np.column_stack([symbol, phrases[of]])
            part = phrases[:, :-1]
        else:
            of, symbol, back_low, size, low = extend(back_low, size, low, bwt, fronts[to_left])
            phrases = np.column_stack([phrases[of], symbol])
            part = phrases[:, 1:]
        kept = np.flatnonzero(known(part))
        phrases, low, back_low, size = phrases[kept], low[kept], back_low[kept], size[kept]
    return phrases, size


def counted(indexes: DataFrame, length: int, filters: dict, as_keys: bool) -> DataFrame:
    """Counts of each shard's phrases: by hash, or as strings of those that the filter of their length has.

    ``filters`` holds the broadcast bits of each length. Beside single words goes the number of all of them,
    as that of the empty phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {n: np.frombuffer(of_length.value, np.uint8) for n, of_length in filters.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                lang, words, *transforms = (c[row] for c in batch.columns)
                lang = lang.as_py()
                text = unpacked(words.as_buffer()).to_pybytes()
                words = text.split(b" ") if text else []
                index = Index(words, *(unpacked_ids(t.as_buffer()) for t in transforms))
                known = Known(lang, words, bits)
                phrases, size = grams(index, known, length)
                if as_keys:
                    keys = known.keys(phrases)
                    order = np.argsort(keys)
                    keys, size = keys[order], size[order]
                    for start in range(0, len(size), ROWS_OUT):
                        part = slice(start, start + ROWS_OUT)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(size[part])], ["key", "n"])
                    continue
                if length == 1:
                    of_all = [pa.array([v]) for v in (lang, "", int(size.sum()))]
                    yield pa.RecordBatch.from_arrays(of_all, ["lang", "phrase", "n"])
                kept = known(phrases)
                phrases, size = phrases[kept], size[kept]
                texts = pa.array([b"", *words], pa.binary()).cast(pa.string())
                for start in range(0, len(size), ROWS_OUT):
                    part = phrases[start : start + ROWS_OUT]
                    joined = pc.binary_join_element_wise(*(texts.take(pa.array(c)) for c in part.T), " ")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), joined, pa.array(size[start : start + ROWS_OUT], pa.int64())],
                        ["lang", "phrase", "n"],
                    )

    columns = ["lang", "words", "bwt"] + (["reverse_bwt"] if length > 2 else [])
    return indexes.select(*columns).mapInArrow(run, "key long, n long" if as_keys else GRAMS)


# Texts and index rows are long. Buffers of a few megabytes are pooled and used again; larger ones are taken from
# the system one by one, which leaves it in pieces, and make the heap grow to its limit.
BATCH_BYTES = "1m"


@contextmanager
def settings(spark: SparkSession, own: dict[str, str]):
    """Settings of the session while something runs."""
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def batches_of(most_bytes: str) -> dict[str, str]:
    return {"spark.sql.execution.arrow.maxBytesPerBatch": most_bytes}


def bounded_passes(spark: SparkSession, batch_bytes: str = "16m"):
    """Settings while the passes run: rows are megabytes long, so that an Arrow batch has few of them,
    and each pass is written or collected once, so that its shuffle files go when it ends."""
    once = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    return settings(spark, batches_of(batch_bytes) | once)


def frequent_phrases(
    docs: DataFrame, least: int, lang_col: str, text_col: str, shard: int = SHARD
) -> tuple[list[DataFrame], DataFrame]:
    """Tables of lang, phrase, n for 1 to 4 words, with n >= ``least``; and each language's number of words."""
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    path = new_folder(spark, "fm-indexes")
    # Row groups of few shards, so that no reader holds more of them. What is packed is not compressed again.
    few = {
        "parquet.block.size": str(1 << 22),
        "parquet.block.size.row.check.min": "1",
        "parquet.enable.dictionary": "false",
        "compression": "uncompressed",
    }
    with settings(spark, batches_of(BATCH_BYTES)):
        shards(texts, shard).write.options(**few).parquet(path)
    indexes = spark.read.schema(INDEX).parquet(path)
    levels, filters, n_words = [], {}, None
    with bounded_passes(spark, BATCH_BYTES):
        for length in range(1, MOST_WORDS + 1):
            by_key = counted(indexes, length, dict(filters), True).groupBy("key").agg(F.sum("n").alias("n"))
            filters[length] = spark.sparkContext.broadcast(filter_of(by_key.where(F.col("n") >= least)))
            found = counted(indexes, length, dict(filters), False)
            sums = written(found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrases")
            if length == 1:
                n_words = sums.where("phrase = ''").select("lang", F.col("n").alias("n_words"))
            levels.append(sums.where((F.col("n") >= least) & (F.col("phrase") != "")))
    return levels, n_words


def wide(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def part_of(phrase: Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first + 1, n), " ")


def collocations(
    docs: DataFrame, least: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text", shard: int = SHARD
) -> DataFrame:
    """The best phrases of each language, with their counts and how many frequent phrases extend them.

    lang, rank, phrase, a, l, r, n, score, n_left, n_right.
    """
    levels, n_words = frequent_phrases(docs, least, lang_col, text_col, shard)
    phrase = F.col("phrase")
    all_counts = levels[0]
    for level in levels[1:]:
        all_counts = all_counts.union(level)
    cuts, inside = None, None
    for length in range(2, MOST_WORDS + 1):
        level = levels[length - 1].select("lang", "phrase", F.col("n").alias("a"))
        ways = F.array(*(F.struct(F.lit(k).alias("k"), part_of(phrase, 0, k).alias("first"), part_of(phrase, k, length).alias("rest")) for k in range(1, length)))
        own_cuts = level.select("lang", "phrase", "a", F.inline(ways))
        cuts = own_cuts if cuts is None else cuts.union(own_cuts)
        # Each shorter phrase in this one, and whether it is followed or preceded by just one word.
        parts = [(first, n) for n in range(2, length) for first in range(length - n + 1)]
        if not parts:
            continue
        held = F.array(*(F.struct(part_of(phrase, first, n).alias("part"), F.lit(int(n == length - 1 and first == 1)).alias("left"), F.lit(int(n == length - 1 and first == 0)).alias("right")) for first, n in parts))
        own_parts = level.select("lang", "a", F.inline(held))
        inside = own_parts if inside is None else inside.union(own_parts)
    counts = lambda name, n: all_counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(counts("first", "l"), ["lang", "first"]).join(counts("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = inside.groupBy("lang", F.col("part").alias("phrase")).agg(
        F.max("a").alias("most"), F.sum("left").alias("n_left"), F.sum("right").alias("n_right")
    )
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (100 * wide("most") < 80 * wide("a"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.select("lang", "phrase", "a", "cut.*", "n_left", "n_right").withColumn("rank", rank)
    none = F.lit(0).cast("long")
    return best.where(F.col("rank") <= top).join(n_words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score",
        F.coalesce("n_left", none).alias("n_left"), F.coalesce("n_right", none).alias("n_right"),
    )
