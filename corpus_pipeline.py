"""From raw documents to token ids: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes all rows that the one before kept, which are written as Parquet and read again, and
gives the columns of ``documents`` (``n_chars`` follows the text); the last one gives each document's
token count and the digests of its ids and of the text decoded from them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpulse.llm import bpe_codec, decontamination, language_id, line_dedup, near_dup
from weekpulse.llm.tables import SPACE, crc_of_id, read_table, small_batches, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A document whose language is less sure than this is not kept.
LEAST_SCORE = 0.5


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def beside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage that adds columns, which go again; columns of these names that were there stay."""
    own = {c: f"aside {c}" for c in docs.columns if c.lower() in names}
    out = stage(docs.withColumnsRenamed(own)).drop(*names)
    return out.withColumnsRenamed({aside: c for c, aside in own.items()})


def identify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language that is told with enough certainty, from a model of this input if it has labels."""
    small_batches(spark)
    model = language_id.train(docs, crc_of_id("doc_id") % 3 != 1)
    if not model.languages:
        # Without a labelled row nothing can be told; only texts without a letter are surely in no language.
        return docs.where(F.col("text").rlike(r"\p{L}"))
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return beside(docs, ("lang_pred", "score"), lambda rows: language_id.identified(rows, model).where(sure))


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that other documents have, too, stay in the first one only; who lost all its words goes."""
    small_batches(spark)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(f"[^{SPACE}]")
    return with_length(beside(docs, ("n_lines", "n_dropped"), lambda rows: line_dedup.line_dedup(rows).where(~emptied)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    small_batches(spark)
    return near_dup.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return with_length(decontamination.decontaminated(docs, read_table(spark, folder, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    small_batches(spark)
    return bpe_codec.bpe_codec(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("bpe_codec", encode),
]

# Neither naive Bayes over hashed n-grams nor the merges of a BPE vocabulary can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
