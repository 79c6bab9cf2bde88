"""The registered queries: each operator over its whole table, with the settings of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpulse.llm import (
    best_fit, bpe_codec, collocations, decontamination, language_id, line_dedup, near_dup, ngram_lm, pii, quality,
    suffix_dedup, token_counts, whitening,
)
from weekpulse.llm.oracle import ORACLE
from weekpulse.llm.tables import crc_of_id, read_table

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.suffix_dedup(read_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.lm_scores(read_table(spark, folder, "documents"))


# A deployment keeps a key of its own; with another one all pseudonyms differ.
PSEUDONYM_KEY = b"registered query"


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.line_dedup(read_table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_codec.bpe_codec(read_table(spark, folder, "documents"), VOCABULARY, digests=True)


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontamination.benchmark_hits(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    )
    length = lambda span: span["last"] - span["first"] + 1
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + length(span))
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, folder, "documents"), VOCABULARY)


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return pii.pii_pseudonyms(docs, PSEUDONYM_KEY)


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    ruled = quality.quality_rules(read_table(spark, folder, "documents"))
    return ruled.select("doc_id", *quality.FEATURES, "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = crc_of_id("doc_id") % 3 == 1
    model = language_id.train(docs, ~held_out)
    return language_id.identified(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))


def op12_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit.packed(read_table(spark, folder, "documents"), VOCABULARY)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Beyond a long a deviation is NULL here; the decimal has it in any case."""
    rows = whitening.whitened(read_table(spark, folder, "embeddings"))
    exact = F.col("deviation")
    return rows.withColumns({"deviation": exact.try_cast("long"), "deviation_decimal": exact})


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_lm_scores": op2_lm_scores,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_near_dedup": op5_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_best_fit": op12_best_fit,
    "op13_whitening": op13_whitening,
}
