"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled training text, hashed into ``buckets`` columns, in one
pass: each task keeps one matrix (languages by buckets) and emits its filled cells, which are summed
by key. The matrix of log probabilities has ``buckets`` x languages cells, whatever the corpus; with
``most_languages`` that is its proven bound, and it is broadcast. Scoring gathers, for the n-grams of a
batch, their rows of the matrix and adds them up by text.

Text is lower-cased and every run of other characters than letters becomes one space; n-grams may hold
that space. The score is the posterior probability of the language predicted, priors being the share
of training texts. A text that is NULL or has no letter gets ``und`` and score 0, as does every text
when there is no training row. Rows with a NULL or repeated id are scored like any other; rows with a
NULL lang are not learned from. Equal scores: the language first in alphabetical order. Texts of any
length are worked through in slices. Other columns, whatever their names, pass through ``identified``
untouched (names of its two results excepted, which it replaces).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

UNDETERMINED = "und"
NOT_LETTERS = regex.compile(r"\P{L}+")
SLICE = 1 << 18
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)


@dataclass(frozen=True)
class Grams:
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 16

    def of(self, codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each n-gram that lies within one owner's code points, and its owner."""
        buckets, whose = [], []
        for n in self.orders:
            if len(codes) < n:
                continue
            last = len(codes) - n + 1
            mixed = np.full(last, n * 0x51ED270B, np.uint64)
            for at in range(n):
                mixed ^= codes[at : at + last] * MULTIPLIERS[at % 5]
                mixed *= np.uint64(0xFF51AFD7ED558CCD)
                mixed ^= mixed >> np.uint64(32)
            inside = owners[:last] == owners[n - 1 :]
            buckets.append((mixed & np.uint64(self.buckets - 1)).astype(np.int64)[inside])
            whose.append(owners[:last][inside])
        if not buckets:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(buckets), np.concatenate(whose)

    def slices(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Buckets and owners for all texts, some SLICE code points at a time."""
        held, owners, size = [], [], 0
        overlap = max(self.orders) - 1

        def flush():
            codes = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32).astype(np.uint64)
            return self.of(codes, np.repeat(owners, [len(x) for x in held]))

        for owner, text in enumerate(texts):
            letters = letters_of(text)
            if len(letters) <= SLICE:
                held.append(letters)
                owners.append(owner)
                size += len(letters)
            else:
                yield from self.long(letters, owner, overlap)
            if size >= SLICE:
                yield flush()
                held, owners, size = [], [], 0
        if held:
            yield flush()

    def long(self, letters: str, owner: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices that overlap; each n-gram is counted where it starts."""
        for start in range(0, len(letters), SLICE):
            for n in self.orders:
                part = letters[start : start + SLICE + n - 1]
                codes = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64)
                yield Grams((n,), self.buckets).of(codes, np.full(len(codes), owner))


def letters_of(text: str | None) -> str:
    """Letters in lower case, one space for all between, one at each end; empty without letters."""
    letters = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {letters} " if letters else ""


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray
    grams: Grams

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        totals = np.tile(self.prior, (len(texts), 1))
        found = np.zeros(len(texts), bool)
        for buckets, owners in self.grams.slices(texts):
            for k in range(len(self.languages)):
                totals[:, k] += np.bincount(owners, self.weights[k][buckets], len(texts))
            found[owners] = True
        best = totals.argmax(axis=1)
        share = 1.0 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        return (
            [self.languages[b] if f else UNDETERMINED for b, f in zip(best, found)],
            np.where(found, share, 0.0).tolist(),
        )


def train(
    docs: DataFrame,
    training: Column,
    grams: Grams = Grams(),
    smoothing: float = 0.5,
    most_languages: int = 100,
    lang_col: str = "lang",
    text_col: str = "text",
) -> Model:
    """The model of the rows where ``training`` holds, each with its text and language."""
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                own = [x.as_py() for x in batch.column(1).filter(pa.array(langs == lang))]
                texts[lang] = texts.get(lang, 0) + len(own)
                if lang not in counts:
                    if len(counts) >= most_languages:
                        raise ValueError(f"more than {most_languages} languages")
                    counts[lang] = np.zeros(grams.buckets, np.int64)
                for buckets, _ in grams.slices(own):
                    counts[lang] += np.bincount(buckets, minlength=grams.buckets)
        for lang, row in counts.items():
            filled = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(filled) + 1), pa.string()),
                    pa.array(np.append(filled, -1)),
                    pa.array(np.append(row[filled], texts[lang])),
                ],
                ["lang", "bucket", "n"],
            )

    cells = (
        rows.mapInArrow(counted, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        # One row a language, so that as many rows as languages come to the driver.
        .groupBy("lang")
        .agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))
        .limit(most_languages + 1)
        .toArrow()
        .to_pylist()
    )
    if len(cells) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    cells.sort(key=lambda row: row["lang"])
    counts = np.zeros((len(cells), grams.buckets))
    texts = np.zeros(len(cells))
    for k, row in enumerate(cells):
        at, n = np.array(row["buckets"]), np.array(row["counts"])
        counts[k, at[at >= 0]] = n[at >= 0]
        texts[k] = n[at < 0].sum()
    counts += smoothing
    return Model(
        tuple(row["lang"] for row in cells),
        np.log(texts / texts.sum()) if cells else texts,
        np.log(counts / counts.sum(axis=1, keepdims=True)),
        grams,
    )


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.drop("lang_pred", "score")
    at = kept.index(text_col)
    # By place, since an extra column may have any name.
    placed = docs.toDF(*(f"c{k}" for k in range(len(kept))))
    schema = StructType(
        [*placed.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return placed.mapInArrow(run, schema).toDF(*kept, "lang_pred", "score")
