"""LM scoring by deleted interpolation of trigrams, bigrams and unigrams.

The probability of a word after its predecessor is a mixture of the maximum-likelihood bigram, the
maximum-likelihood unigram and the add-one unigram (which knows a place for words never seen); after its two
predecessors it is a mixture of that and the maximum-likelihood trigram. The weights depend on how often
the context (one word, or two) was seen, in buckets by powers of two, and are learned by
expectation-maximisation on counts of a fold of the training texts that is left out of the counts for
that purpose (deleted); the scores then use the counts of all training texts.

No table of the corpus' n-grams goes to one place. Each task makes batches of about ``BATCH_BYTES`` of its
texts as it reads them, and writes them as numbers of words. A batch asks for its distinct n-grams, as sorted hashes
with their counts in the kept and in the deleted fold, by ranges of the hash space (about ``RANGE_GRAMS`` each); a
range adds the counts up and answers in the order of the question. One step asks at most ``FAN`` ranges. Where there are more, as many
batches are first merged to a node that holds one part in ``FAN`` of the hash space, and so about as many n-grams
as one batch; nodes ask on in the same way, and answers take the same steps back. So each step
moves every n-gram of a batch once in rows that do not get shorter with the input, and the number of steps is
its logarithm. A frequent word or a copied text is one n-gram a batch, so no range is hot. What EM needs of the
deleted fold are histograms over buckets and the ratios of the estimates in steps of a 32nd of an
octave: bounded, and added up by cell.

Words are 64-bit hashes; those of longer n-grams have 20 bits more than the number of tokens. Texts are read and cut
into words once; questions are made again from the written batches wherever they are needed, and asked in ``PASSES`` of
about the same size, each of which drops its shuffle files when it ends, so that disk holds one pass's questions at a
time.

NULL and empty texts are just an end. Rows without id are scored but neither learned from nor counted in a fold;
rows that repeat an id are scored and counted one by one. Without training rows every weight is on the add-one
unigram. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpulse.llm.collocations import bounded_passes
from weekpulse.llm.tables import crc_of_id, written
from weekpulse.sources.shared import new_folder

BATCH_BYTES = 8_000_000
RANGE_GRAMS = 1_500_000
FAN = 128
# Numbers of words before the last one: words and bigrams, then trigrams.
PASSES = ((0, 1), (2,))
ORDERS = (0, 1, 2)
# About so many bytes of text for each token; only sets the number of ranges and of bits.
TOKEN_BYTES = 5
END, START, BEFORE = (np.uint64(xxhash.xxh3_64_intdigest(b"", seed)) for seed in (0, 1, 2))
MIX = np.uint64(0x9E3779B97F4A7C15)
BUCKETS = 24
# Ratios of estimates are told apart in so many steps an octave.
STEPS = 32
UNSEEN = -(1 << 20)
STRETCH = 1 << 20
TEXTS = "source long, texts binary"
ASKED = "place long, source long, n int, grams binary, kept binary, deleted binary"
ANSWERED = "place long, source long, n int, kept binary, deleted binary"
TOTALS = ("distinct", "distinct_kept", "tokens", "tokens_kept")
FINAL = ANSWERED + "".join(f", {name} long" for name in TOTALS)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
ARROW = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}


def rows_of(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.table({name: pa.array(own, ARROW[kind]) for (name, kind), own in zip(fields, columns)})


def packed(values: np.ndarray) -> bytes:
    """Whole numbers by bytes of equal weight, without the leading ones that are all zero, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + pa.compress(planes[:used].tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    if n:
        own = pa.decompress(data[1:], data[0] * n, "zstd", asbytes=True)
        planes[: data[0]] = np.frombuffer(own, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def tokens_of(text: str) -> np.ndarray:
    data = (text or "").encode().lower()
    parts, start = [], 0
    while start < len(data):
        end = min(len(data), start + STRETCH)
        # Up to the next white space, so that no word is cut.
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = data[start:end].split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        start = end
    return np.concatenate([*parts, np.array([END])])


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each pair of hashes."""
    both = left * MIX
    both ^= both >> np.uint64(32)
    both += right
    both *= MIX
    both ^= both >> np.uint64(29)
    both *= MIX
    return both


class Batch:
    """A batch's tokens, one text after the other, as places in its sorted words; its distinct n-grams of some orders."""

    def __init__(self, words: np.ndarray, at: np.ndarray, lengths: np.ndarray, bits: int, orders: tuple[int, ...]):
        self.words, self.tokens_at, self.lengths = words, at, lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self.bits = (64, bits, bits)
        found = {order: self.distinct(order) for order in orders}
        self.grams, self.at = ({order: x[k] for order, x in found.items()} for k in (0, 1))

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams, and the place there of the one that ends in each token."""
        if order == 0:
            return self.words, self.tokens_at
        tokens = self.words[self.tokens_at]
        own = tokens
        for first in (START, BEFORE)[:order]:
            own = joined(self.before(own, first), tokens)
        return np.unique(own >> np.uint64(64 - self.bits[order]), return_inverse=True)

    def before(self, values: np.ndarray, first: np.uint64 | np.ndarray) -> np.ndarray:
        """The value of the token before; ``first`` where a text begins."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out

    @classmethod
    def of_texts(cls, texts: list[str | None], bits: int, orders: tuple[int, ...] = ORDERS) -> Batch:
        own = [tokens_of(text) for text in texts]
        words, at = np.unique(np.concatenate(own), return_inverse=True)
        return cls(words, at, np.array([len(x) for x in own]), bits, orders)

    def kept(self) -> tuple:
        """What ``restored`` needs: words by falling frequency, as their numbers are smaller then."""
        words, at = self.words, self.tokens_at
        order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        return self.lengths, words[order], packed(number[at])

    @classmethod
    def restored(cls, lengths: np.ndarray, words: np.ndarray, numbers: bytes, bits: int, orders: tuple[int, ...] = ORDERS) -> Batch:
        order = np.argsort(words)
        at = np.empty(len(words), np.int64)
        at[order] = np.arange(len(words))
        return cls(words[order], at[unpacked(numbers, int(lengths.sum())).astype(np.int64)], lengths, bits, orders)

    def asked(self, fold: np.ndarray, each: int) -> Iterator[tuple]:
        """fold of each text: 0 kept, 1 deleted, 2 neither. Yields (place, n, grams, kept, deleted)."""
        folds = np.repeat(fold, self.lengths)
        for order, grams in self.grams.items():
            counts = [np.bincount(self.at[order][folds == k], minlength=len(grams)) for k in (0, 1)]
            yield from split(order * each, grams, *counts, slices(grams, self.bits[order], each, 0, each))

    def answered(self, answers: dict[int, tuple[bytes, bytes]], each: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the kept and the deleted count of every distinct n-gram."""
        out = []
        for order, grams in self.grams.items():
            found = [np.zeros(len(grams), np.int64) for _ in range(2)]
            for place, part in slices(grams, self.bits[order], each, 0, each):
                for into, data in zip(found, answers[order * each + place]):
                    into[part] = unpacked(data, part.stop - part.start)
            out.append(tuple(found))
        return out

    def estimates(self, counts: list[np.ndarray], n: int, distinct: int) -> Estimates:
        word, pair, three = (own[self.at[order]] for order, own in enumerate(counts))
        # As many texts begin as end.
        begun = counts[0][np.searchsorted(self.grams[0], END)]
        return Estimates(word, self.before(word, begun), self.before(pair, begun), pair, three, n, distinct)


class Estimates:
    """For each token: its count, those of the word and of the two words before, and the estimates."""

    def __init__(self, word, context, context_2, pair, three, n: int, distinct: int):
        self.count, self.context, self.context_2 = word, context, context_2
        share = lambda part, whole: np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)
        self.trigram, self.bigram = share(three, context_2), share(pair, context)
        self.unigram, self.base = word / max(n, 1), (word + 1) / (n + distinct + 1)

    def after_one(self, weights: np.ndarray) -> np.ndarray:
        weight = weights[bucket_of(self.context)]
        return weight[:, 0] * self.bigram + weight[:, 1] * self.unigram + weight[:, 2] * self.base

    def after_two(self, weights: np.ndarray, shares: np.ndarray) -> np.ndarray:
        share = shares[bucket_of(self.context_2)]
        return share * self.trigram + (1 - share) * self.after_one(weights)


def slices(grams: np.ndarray, bits: int, parts: int, first: int, n: int) -> Iterator[tuple[int, slice]]:
    """Of ``parts`` ranges of the hash space the n from ``first`` on: the filled ones, and where their n-grams stand."""
    edges = np.array([((first + k) << bits) // parts for k in range(1, n)], np.uint64)
    cuts = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
    for place, (start, stop) in enumerate(zip(cuts, cuts[1:])):
        if start < stop:
            yield place, slice(start, stop)


def split(first: int, grams: np.ndarray, kept: np.ndarray, deleted: np.ndarray, parts: Iterator) -> Iterator[tuple]:
    for place, part in parts:
        own = np.diff(grams[part], prepend=np.uint64(0))
        yield first + place, len(own), packed(own), packed(kept[part]), packed(deleted[part])


class Sums:
    """The n-grams that several sources ask for in one range: distinct, with their counts added up."""

    def __init__(self, asked: pa.Table):
        self.rows = asked.to_pylist()
        sizes = [row["n"] for row in self.rows]
        grams = [np.cumsum(unpacked(row["grams"], row["n"]), dtype=np.uint64) for row in self.rows]
        self.grams, self.at = np.unique(np.concatenate(grams), return_inverse=True)
        self.kept, self.deleted = (
            np.bincount(self.at, np.concatenate([unpacked(row[name], row["n"]) for row in self.rows]), len(self.grams)).astype(np.int64)
            for name in ("kept", "deleted")
        )
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])

    def answers(self, kept: np.ndarray, deleted: np.ndarray) -> Iterator[tuple]:
        """(place, source, n, kept, deleted) for each source, in its own order."""
        for row, start, stop in zip(self.rows, self.cuts, self.cuts[1:]):
            own = self.at[start:stop]
            yield row["place"], row["source"], row["n"], packed(kept[own]), packed(deleted[own])


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one for each power of two."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def ratio_bins(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log2 of the ratio in steps of 1/STEPS; UNSEEN where the part is 0."""
    bins = np.full(len(part), UNSEEN)
    some = part > 0
    bins[some] = np.rint(np.log2(part[some] / whole[some]) * STEPS)
    return bins


def learned(own: np.ndarray, usable: np.ndarray, rounds: int = 100) -> np.ndarray:
    """EM over cells of ratios to the last estimate and a number of tokens: one weight for each estimate."""
    weight = usable / usable.sum()
    ratios = [np.where(own[:, k] == UNSEEN, 0.0, np.exp2(own[:, k] / STEPS)) for k in range(own.shape[1] - 1)]
    relative = np.stack([*ratios, np.ones(len(own))], 1)
    for _ in range(rounds):
        share = weight * relative
        share *= (own[:, -1] / share.sum(axis=1))[:, None]
        # A half count each, so that no weight becomes 0.
        weight = (share.sum(axis=0) + 0.5) * usable
        weight /= weight.sum()
    return weight


def learned_weights(cells: np.ndarray) -> np.ndarray:
    """Of (bucket, bigram bin, unigram bin, n) cells; a row of three weights for each bucket."""
    weights = np.zeros((BUCKETS, 3))
    for bucket in range(BUCKETS):
        own = cells[cells[:, 0] == bucket, 1:]
        if len(own):
            weights[bucket] = learned(own, np.array([bucket > 0, True, True]))
        else:
            weights[bucket] = weights[bucket - 1] if bucket > 1 else [0.0, 0.0, 1.0]
    return weights


def learned_shares(cells: np.ndarray) -> np.ndarray:
    """Of (bucket, trigram bin, n) cells; the trigram's share for each bucket."""
    shares = np.zeros(BUCKETS)
    for bucket in range(1, BUCKETS):
        own = cells[cells[:, 0] == bucket, 1:]
        shares[bucket] = learned(own, np.array([True, True]))[0] if len(own) else shares[bucket - 1]
    return shares


def batched(rows: DataFrame, batch_bytes: int, bits: int) -> DataFrame:
    """The texts in batches, written as numbers of words, with ids and folds."""

    def flushed(batch: int, ids: list, texts: list, fold: list) -> pa.RecordBatch:
        kept = pickle.dumps((ids, np.array(fold), *Batch.of_texts(texts, bits, ()).kept()))
        return rows_of(TEXTS, [(batch, kept)]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        # The deleted fold has batches of its own, since EM reads only them: those of odd numbers.
        held, sizes = [([], [], []), ([], [], [])], [0, 0]
        for batch in batches:
            for doc_id, text, fold in zip(*(column.to_pylist() for column in batch.columns)):
                odd = int(fold == 1)
                for into, value in zip(held[odd], (doc_id, text, fold)):
                    into.append(value)
                sizes[odd] += len(text) + 1
                if sizes[odd] >= batch_bytes:
                    yield flushed(first + 2 * made + odd, *held[odd])
                    held[odd], sizes[odd], made = ([], [], []), 0, made + 1
        for odd in (0, 1):
            if held[odd][0]:
                yield flushed(first + 2 * made + odd, *held[odd])

    path = new_folder(rows.sparkSession, "texts")
    # Row groups of few batches, so that no reader holds more of them.
    few = {"parquet.block.size": str(1 << 24), "parquet.block.size.row.check.min": "1"}
    rows.mapInArrow(run, TEXTS).write.options(**few).parquet(path)
    return rows.sparkSession.read.schema(TEXTS).parquet(path)


def asking(texts: DataFrame, each: int, bits: int, orders: tuple[int, ...]) -> DataFrame:
    """What the batches ask about n-grams of these orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(*batch.columns):
                _, fold, *kept = pickle.loads(data.as_buffer())
                own = Batch.restored(*kept, bits, orders)
                out = [(place, source.as_py(), *rest) for place, *rest in own.asked(fold, each)]
                yield rows_of(ASKED, out).combine_chunks().to_batches()[0]

    return texts.mapInArrow(run, ASKED)


def counted(asked: DataFrame, batches: int, each: int, levels: int, bits: int, level: int = 1) -> tuple[DataFrame, DataFrame]:
    """The answers to what is asked at this level, and the last level's, which have the totals."""

    def last(table: pa.Table) -> pa.Table:
        sums = Sums(table)
        of_words = sums.rows[0]["place"] < each**levels
        every = sums.kept + sums.deleted
        totals = [int((every > 0).sum()), int((sums.kept > 0).sum()), int(every.sum()), int(sums.kept.sum())]
        out = []
        for k, (place, source, n, kept, deleted) in enumerate(sums.answers(sums.kept, sums.deleted)):
            out.append((place, source, n, kept, deleted, *(totals if of_words and not k else [0] * len(TOTALS))))
        return rows_of(FINAL, out)

    if level == levels:
        final = written(asked.groupBy("place").applyInArrow(last, FINAL), "counts")
        return final, final

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        place, group = (x.as_py() for x in key)
        sums = Sums(table)
        order, first = divmod(place, each**level)
        parts = slices(sums.grams, bits if order else 64, each ** (level + 1), first * each, each)
        rows = split(place * each, sums.grams, sums.kept, sums.deleted, parts)
        return rows_of(ASKED, [(place, group, *rest) for place, *rest in rows])

    def back(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return rows_of(ANSWERED, [])
        sums = Sums(table)
        own = sorted(answers.to_pylist(), key=lambda row: row["place"])
        found = (np.concatenate([unpacked(row[name], row["n"]) for row in own]).astype(np.int64) for name in ("kept", "deleted"))
        return rows_of(ANSWERED, list(sums.answers(*found)))

    groups = -(-batches // each**level)
    group = F.pmod(F.xxhash64("source") if level == 1 else F.col("source"), F.lit(groups))
    placed = asked.withColumn("group", group)
    merged = placed.groupBy("place", "group").applyInArrow(merge, ASKED)
    if level + 1 < levels:
        merged = written(merged, "merged")
    answers, final = counted(merged, batches, each, levels, bits, level + 1)
    above = answers.select("place", "n", "kept", "deleted", F.col("source").alias("group"), F.expr(f"place DIV {each}").alias("parent"))
    return placed.groupBy("place", "group").cogroup(above.groupBy("parent", "group")).applyInArrow(back, ANSWERED), final


def lm_scores(
    docs: DataFrame, folds: int = 7, held_out: int = 2, deleted: int = 3, id_col: str = "doc_id", text_col: str = "text",
    batch_bytes: int = BATCH_BYTES, range_grams: int = RANGE_GRAMS, fan: int = FAN,
) -> DataFrame:
    """Scores of all rows; crc32(id as text) mod folds tells the held-out and the deleted ones."""
    fold = F.coalesce(crc_of_id("doc_id") % folds, F.lit(held_out))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.when(fold == held_out, 2).when(fold == deleted, 1).otherwise(0).alias("fold"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    batches = size // batch_bytes + 1
    ranges = size // TOKEN_BYTES // range_grams + 1
    levels = 1
    while fan**levels < ranges:
        levels += 1
    each = next(k for k in range(1, fan + 1) if k**levels >= ranges)
    bits = min(64, (size // TOKEN_BYTES).bit_length() + 20)

    texts = batched(rows, batch_bytes, bits)
    answers, totals = [], {}
    with bounded_passes(docs.sparkSession):
        for orders in PASSES:
            own, final = counted(asking(texts, each, bits, orders), batches, each, levels, bits)
            answers.append((own if levels == 1 else written(own, "answers")).select("source", "place", "kept", "deleted"))
            if 0 in orders:
                totals = {k: v or 0 for k, v in final.agg(*(F.sum(c).alias(c) for c in TOTALS)).first().asDict().items()}
    answers = reduce(DataFrame.union, answers)

    def per_batch(work: Callable[[Batch, list, np.ndarray, list], pa.Table], schema: str, condition: Column) -> DataFrame:
        def run(own: pa.Table, answered: pa.Table) -> pa.Table:
            ids, fold, *kept = pickle.loads(own.column("texts")[0].as_buffer())
            batch = Batch.restored(*kept, bits)
            places, *counts = (answered.column(c).to_pylist() for c in ("place", "kept", "deleted"))
            return work(batch, ids, fold == 2, batch.answered(dict(zip(places, zip(*counts))), each))

        return texts.where(condition).groupBy("source").cogroup(answers.where(condition).groupBy("source")).applyInArrow(run, schema)

    def observed(names: tuple[str, ...], bins: Callable[[Estimates], list[np.ndarray]]) -> np.ndarray:
        """What the deleted texts show under the kept texts' counts: cells, in order, with their number of tokens."""

        def observe(batch: Batch, ids: list, held: np.ndarray, counts: list) -> pa.Table:
            found = batch.estimates([kept for kept, _ in counts], totals["tokens_kept"], totals["distinct_kept"])
            own = [x.astype(np.int64) for x in bins(found)]
            # One number for each cell, which sorts faster than a row.
            key = own[0]
            for other in own[1:]:
                key = (key << 22) + (other - UNSEEN)
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            return pa.table({**{name: values[at] for name, values in zip(names, own)}, "n": n})

        schema = ", ".join(f"{name} long" for name in (*names, "n"))
        cells = per_batch(observe, schema, F.expr("source % 2 = 1")).groupBy(*names).agg(F.sum("n").alias("n"))
        cells = cells.toPandas().to_numpy(dtype=np.int64).reshape(-1, len(names) + 1)
        return cells[np.lexsort(cells.T[::-1])]

    with bounded_passes(docs.sparkSession):
        weights = learned_weights(observed(
            ("bucket", "bigram", "unigram"),
            lambda x: [bucket_of(x.context), ratio_bins(x.bigram, x.base), ratio_bins(x.unigram, x.base)],
        ))
        shares = learned_shares(observed(
            ("bucket", "trigram"), lambda x: [bucket_of(x.context_2), ratio_bins(x.trigram, x.after_one(weights))]
        ))

    def score(batch: Batch, ids: list, held: np.ndarray, counts: list) -> pa.Table:
        found = batch.estimates([kept + gone for kept, gone in counts], totals["tokens"], totals["distinct"])
        by_text = lambda x: np.add.reduceat(x, batch.starts)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held),
                "n_tokens": batch.lengths.astype(np.int64), "n_known": by_text((found.count > 0).astype(np.int64)),
                "base_score": by_text(np.log10(found.base)), "score": by_text(np.log10(found.after_two(weights, shares))),
            }
        )

    return per_batch(score, SCORED, F.lit(True)).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
