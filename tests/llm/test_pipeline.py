"""The pipeline against plain versions of its stages, and its stages on odd tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import library, odd  # noqa: F401

DATA = "/root/testdata/sf0.001"


def plain_lines(rows):
    key = lambda line: brute.lower(line.strip(brute.SPACE))
    first = {}
    for doc_id, text in sorted(rows):
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), doc_id)
    return [(i, "\n".join(x for x in t.split("\n") if first.get(key(x), i) == i)) for i, t in rows]


def plain_cut(text, items, window=10):
    """The text without hit words and what stands between them; None if more than half is hit."""
    windows = set()
    for item in items:
        own = brute.item_words(item)
        windows |= {tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1)) if own}
    share = None
    while True:
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))]
        own = [brute.lower(text[a:b]) for a, b in places]
        hit = set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in windows:
                    hit.update(range(i, i + size))
        share = share if share is not None else len(hit) / max(1, len(own))
        if share > 0.5:
            return None
        if not hit:
            return text
        out, done = [], 0
        for i in sorted(hit):
            if i - 1 not in hit:
                out.append(text[done : places[i][0]])
            done = places[i][1]
        text = "".join([*out, text[done:]])


def test_pipeline(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in documents.collect() if re.search(r"[^\W\d_]", r.text)]
    rows = [(i, t) for i, t in plain_lines(rows) if brute.words(t)]
    first = brute.near_components(rows)
    rows = [(i, t) for i, t in rows if first[i] == i]
    cut = [(i, plain_cut(t, items)) for i, t in rows]
    assert cut != rows
    rows = [(i, t) for i, t in cut if t is not None]
    tokens = library([t for _, t in rows])
    wanted = [(i, len(x), brute.sha(",".join(map(str, x))), brute.sha(t)) for (i, t), (x, _) in zip(rows, tokens)]
    found = corpus_pipeline.run(spark, DATA)
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def test_stages_keep_the_columns_of_documents(spark, odd):  # noqa: F811
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_dedup", "decontamination", "bpe_codec",
    ]
    wide = odd.withColumn("n_chars", F.length("text").cast("long"))
    for docs in (wide, wide.where("false"), spark.read.parquet(f"{DATA}/documents.parquet")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert sorted(out.columns) == sorted(docs.columns), name
            assert out.count() <= n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == n


def test_planted_copies_end_as_one_row_and_none_is_left_empty(spark):
    text = lambda k: "\n".join(f"line {j} of text {k} with words of its own like w{k}x{j}" for j in range(12))
    rows = [(10 * k + c, text(k), "en") for k in range(6) for c in range(4)]
    near = " ".join(f"only{j}" for j in range(80))
    rows += [(900, near, "en"), (901, near + " and one more", "en"), (902, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, DATA)
    assert sorted(r.doc_id for r in docs.collect()) == [0, 10, 20, 30, 40, 50, 900, 902]


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("stage", [1, 3])
def test_clean_documents_stay(spark, stage):
    rows = [(k, " ".join(f"clean{k}word{j}" for j in range(40)), "en", "s", 10) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.STAGES[stage][1](spark, docs, DATA)
    assert sorted(r.text for r in found.collect()) == sorted(r[1] for r in rows)


def test_documents_without_labels_stay(spark):
    rows = [(1, "clean words of a text", None), (2, "漢字", None), (3, "12 34 !", None), (4, "", None), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = corpus_pipeline.identify(spark, docs, DATA)
    assert found.columns == docs.columns and sorted(r.doc_id for r in found.collect()) == [1, 2]
