"""The registered language query against naive Bayes written out."""

from __future__ import annotations

import pytest

from tests.comparing import DATA
from tests.llm import brute
from weekpulse.llm.queries import QUERIES

FOLDER = f"{DATA}/sf0.001"


def test_language_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()
    wanted = {i: rest for i, *rest in brute.languages([tuple(r) for r in rows])}
    found = QUERIES["op10_language_id"](spark, FOLDER).collect()
    assert len(found) == len(rows) and {r.doc_id for r in found} == set(wanted)
    for r in found:
        held_out, lang, score = wanted[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held_out, lang)
        assert r.score == pytest.approx(score, rel=1e-6)


def test_language_query_on_odd_rows(spark, tmp_path):
    """Ties, repeats, texts without letters or language, and combining marks."""
    texts = ["the cat and the dog", "der hund und die katze", "le chien et le chat", None, "", "12 34", "É à ́x", "the cat and the dog"]
    langs = ["en", "de", "fr", "en", "de", None, "fr", "en"]
    rows = [(k, texts[k % 8], langs[k % 8]) for k in range(48)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {i: rest for i, *rest in brute.languages(rows)}
    for r in QUERIES["op10_language_id"](spark, str(tmp_path)).collect():
        held_out, lang, score = wanted[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held_out, lang)
        assert r.score == pytest.approx(score, rel=1e-6)
