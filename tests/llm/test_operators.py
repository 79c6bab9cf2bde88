"""Each operator against its plain version: driver rows, hand-made rows and odd tables."""

from __future__ import annotations

import math
import random
import threading
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import public_tokenizers
from tests.llm import brute
from weekpulse.llm import (
    bpe_codec, byte_bpe, decontamination, language_id, line_dedup, near_dup, ngram_lm, pii, quality, suffix_dedup, token_counts,
)
from weekpulse.llm.queries import QUERIES
from weekpulse.llm.tables import crc_of_id, written

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{k % 977} other{k % 1013}" for k in range(30_000))
ODD_ROWS = [
    (None, "a row without id that has more than ten words in it, all in all", "en", None),
    (None, "a row without id that has more than ten words in it, all in all", "en", None),
    (1, None, "en", "s"),
    (2, "", None, "s"),
    (3, " \t\n\r\x0b\x0c ", "en", "s"),
    (4, "the same text twice under one id, with enough words to be shingled", "en", "s"),
    (4, "the same text twice under one id, with enough words to be shingled", "en", "s"),
    (5, "one id with two texts, the first of them", "en", "s"),
    (5, "one id with two texts, the second of them", "en", "s"),
    (6, "The Same Line in two documents\nand a line of its own", "en", "s"),
    (7, "  the same line in two documents\t\nshort\nshort", "de", None),
    (8, LONG, "en", "t"),
    (9, LONG + " and a little more", "en", "t"),
    (10, "x", "en", "t"),
    (11, "=" * 3000, "en", "t"),
    (12, "éè ß 漢字 \U0001f600 <|endoftext|> 2²", "fr", "t"),
]
# Names that operators use inside, or that need quoting.
CLASHING = [
    "id", "key", "n", "words", "lines", "score", "lang_pred", "n_lines", "n_dropped", "c0", "c1", "a.b", "n_replaced", "kinds",
    "gone_id", "row", "n_chars",
]


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    yield docs
    docs.unpersist()


@pytest.fixture(scope="module")
def plain(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    kinds = [("doc_id", LongType()), *((c, StringType()) for c in ("text", "lang", "source", *CLASHING))]
    schema = StructType([StructField(c, kind) for c, kind in kinds])
    rows = [(*row, *(f"{c}{k}" if k % 3 else None for c in CLASHING)) for k, row in enumerate(ODD_ROWS)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


PLAIN_ODD = [(i, t) for i, t, _, _ in ODD_ROWS]


def collected(frame, *columns):
    return brute.rows_of(frame.toPandas(), *columns)


def ordered(rows):
    return sorted(rows, key=str)


def exactly(found, wanted):
    """Without the detour over pandas, where a missing id would make all ids floats."""
    assert ordered(tuple(row) for row in found.collect()) == ordered(wanted)


# 1


def digest_1(frame):
    return frame.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))


@pytest.mark.parametrize("most", [20_000, 2])
def test_suffix_dedup(documents, plain, most):
    found = suffix_dedup.suffix_dedup(documents, most_segments=most, task_bytes=100_000)
    exactly(digest_1(found), brute.substrings(plain))


def test_suffix_dedup_odd(odd, empty):
    rows = [r for r in PLAIN_ODD if r[1] != LONG and not (r[1] or "").startswith(LONG)]
    extra = odd.where(~F.coalesce(F.col("doc_id").isin(8, 9), F.lit(False)))
    exactly(digest_1(suffix_dedup.suffix_dedup(extra)), brute.substrings(rows))
    found = {r.doc_id: r for r in suffix_dedup.suffix_dedup(odd).collect()}
    assert found[9].n_removed >= len(LONG) - 200 and found[8].n_removed >= len(LONG) - 200
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_periodic_and_random_bytes(spark):
    draw = random.Random(5)
    base = "".join(draw.choice("ab ") for _ in range(900))
    rows = [(k, base[draw.randrange(600) :][: draw.randrange(150, 500)] * draw.randrange(1, 3)) for k in range(25)]
    rows += [(100, "ab" * 400), (101, "ba" * 150), (102, "a" * 199), (103, "a" * 200), (104, "a" * 201)]
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), task_bytes=3000)
    exactly(digest_1(found), brute.substrings(rows))


# 2


def assert_lm(found, wanted):
    for row in found.collect():
        held, n, known, total, base = wanted[row.doc_id]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held, n, known, total)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(row.score) and row.score <= 0


def test_lm_scores(documents, plain):
    wanted = brute.lm_base(plain)
    assert_lm(ngram_lm.lm_scores(documents), wanted)
    found = ngram_lm.lm_scores(documents, batch_bytes=20_000, range_grams=2_000).cache()
    assert_lm(found, wanted)
    held = found.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_lm_scores_are_the_mixture(documents, plain):
    """All of it once more in plain Python, EM on the single held-out tokens instead of the histogram."""
    wanted = brute.lm_mixture(plain)
    found = {r.doc_id: r.score for r in ngram_lm.lm_scores(documents, batch_bytes=50_000, range_grams=5_000).collect()}
    assert found == pytest.approx(wanted, rel=5e-3)


@pytest.mark.parametrize("fan", [2, 5])
def test_lm_scores_in_steps(documents, plain, fan):
    """Ranges asked by way of merged nodes: the same scores."""
    wanted = {r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.lm_scores(documents).collect()}
    found = ngram_lm.lm_scores(documents, batch_bytes=50_000, range_grams=10_000, fan=fan).collect()
    assert len(found) == len(wanted)
    for r in found:
        assert (r.n_known, r.train_tokens) == wanted[r.doc_id][:2]
        assert (r.base_score, r.score) == pytest.approx(wanted[r.doc_id][2:], rel=1e-9)


def test_lm_rows_grow_with_the_input(documents, monkeypatch):
    """Four times the texts: about four times the rows a step, though batches and ranges both grow."""
    sent = []

    def counting(frame, purpose):
        out = written(frame, purpose)
        sent.append((purpose, out.count()))
        return out

    monkeypatch.setattr(ngram_lm, "written", counting)
    per_step = []
    for copies in (1, 4):
        sent.clear()
        texts = documents.select("doc_id", F.explode(F.array_repeat("text", copies)).alias("text"))
        ngram_lm.lm_scores(texts, batch_bytes=40_000, range_grams=8_000, fan=4).count()
        per_step.append(max(n for purpose, n in sent if purpose in ("asked", "merged", "counts", "answers")))
    assert per_step[1] < 5 * per_step[0]


@pytest.mark.parametrize("steps, share", [({}, 0.8), ({"range_grams": 100_000, "fan": 2}, 1.3)])
def test_lm_disk_holds_one_pass(spark, steps, share):
    """Texts are on disk once beside one pass's questions: 0.5 of the text in one step (before: 1.1), 1.0 in two (1.6)."""
    draw = random.Random(3)
    frequent = lambda: f"word{int(draw.paretovariate(0.6)) % 50_000}"
    rows = [(k, " ".join(frequent() for _ in range(2_000))) for k in range(300)]
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(spark.conf.get("spark.checkpoint.dir"))

    def files():
        paths = [path for folder in folders for path in Path(folder.removeprefix("file:")).rglob("*")]
        return {path: size_of(path) for path in paths}

    def size_of(path):
        try:
            return path.stat().st_size if path.is_file() else 0
        except FileNotFoundError:
            return 0

    before, most, ended = files(), 0, threading.Event()

    def watch():
        nonlocal most
        while not ended.wait(0.02):
            most = max(most, sum(size for path, size in files().items() if path not in before))

    texts = spark.createDataFrame(rows, "doc_id long, text string")
    watching = threading.Thread(target=watch)
    watching.start()
    try:
        scored = ngram_lm.lm_scores(texts, batch_bytes=1_000_000, **steps)
        assert scored.where("score < 0").count() == len(rows)
    finally:
        ended.set()
        watching.join()
    assert most < share * sum(len(text) for _, text in rows)


def test_lm_odd(odd, empty):
    found = ngram_lm.lm_scores(odd)
    assert found.count() == len(ODD_ROWS)
    assert {r.held_out for r in found.where("doc_id IS NULL").collect()} == {True}
    assert {r.n_tokens for r in found.where("doc_id IN (1, 2, 3)").collect()} == {1}
    assert ngram_lm.lm_scores(empty).count() == 0
    none = ngram_lm.lm_scores(odd.where("doc_id IS NULL")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in none] == [(0, 0, 0.0)] * 2


# 3


def digest_3(frame):
    return frame.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))


def test_line_dedup(documents, plain):
    exactly(digest_3(line_dedup.line_dedup(documents)), brute.shared_lines(plain))


def test_line_dedup_odd(odd, empty):
    found = line_dedup.line_dedup(odd)
    exactly(digest_3(found), brute.shared_lines(PLAIN_ODD))
    assert set(found.columns) == set(odd.columns)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_of_more_documents(spark):
    rows = [(k, "this line is in three\nthis line is in two" if k < 2 else "this line is in three") for k in range(3)]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), documents=3).orderBy("doc_id")
    assert [r.text for r in found.collect()] == ["this line is in three\nthis line is in two", "this line is in two", ""]


# 5


def test_near_duplicates(documents, plain):
    wanted = brute.near_components(plain)
    sizes = {i: len(brute.shingle_set(t)) for i, t in plain}
    exactly(near_dup.near_duplicates(documents), [(i, sizes[i], c, i == c) for i, c in wanted.items()])


def test_near_duplicates_at_the_threshold(spark):
    """Sets of 3 in 4 shingles alike are linked, those just under are not; chains are one component."""
    rows = []
    for k in range(30):
        own = [f"w{k}x{j}" for j in range(64)]
        # 60 shingles, 52 and 51 of which the others share: 52/68 and 51/69 of the union.
        rows += [(10 * k + 1, " ".join(own)), (10 * k + 2, " ".join([*own[:56], *(f"y{k}x{j}" for j in range(8))]))]
        rows += [(10 * k + 3, " ".join([*own[:55], *(f"z{k}x{j}" for j in range(9))]))]
    wanted = brute.near_components(rows)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == wanted
    assert len(set(wanted.values())) < len(rows)


@pytest.mark.parametrize("few", [0, 4, 10**6])
def test_near_duplicates_of_one_family(spark, monkeypatch, few):
    """Variants with few to many edits: some linked, some not, whichever way components are met."""
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    draw = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(120):
        own = list(base)
        for at in draw.sample(range(150), draw.randrange(0, 12)):
            own[at] = f"e{draw.randrange(40)}" if draw.random() < 0.5 else f"u{k}x{at}"
        rows.append((1000 - k, " ".join(own)))
    wanted = brute.near_components(rows)
    assert 2 < len(set(wanted.values())) < 110
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == wanted


def test_near_duplicates_odd(odd, empty):
    found = near_dup.near_duplicates(odd).collect()
    wanted = brute.near_components([r for r in PLAIN_ODD if r[0] is not None])
    assert len(found) == len(ODD_ROWS)
    for row in found:
        assert row.component_id == (None if row.doc_id is None else wanted[row.doc_id])
        assert row.kept == (row.doc_id is None or row.doc_id == row.component_id)
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 9").count() == 0


# 6


def hits(docs, items, **more):
    return [
        (
            r.doc_id, r.n_words, sum(s.last - s.first + 1 for s in r.spans), len(r["items"]),
            brute.sha(",".join(r["items"])), bool(r.spans),
        )
        for r in decontamination.benchmark_hits(docs, items, **more).collect()
    ]


def test_benchmark_hits(spark, documents, plain):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    wanted = brute.item_hits(plain, [(r.item_id, r.text) for r in items.collect()])
    assert any(row[5] for row in wanted)
    assert ordered(hits(documents, items)) == ordered(wanted)


def test_benchmark_hits_of_random_words(spark, monkeypatch):
    draw = random.Random(3)
    some = lambda n: " ".join(draw.choice("abc") for _ in range(n))
    items = [(k, some(draw.randrange(0, 14))) for k in range(25)] + [(None, "a b c a b"), (3, "c c c c"), (98, None), (99, " . ")]
    docs = [(k, some(draw.randrange(0, 60))) for k in range(60)] + [(77, None), (78, "")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (4, 10):
        wanted = ordered(brute.item_hits(docs, items, window))
        assert ordered(hits(*frames, window=window)) == wanted
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40)
        monkeypatch.setattr(decontamination, "PART_WORDS", 5)
        assert ordered(hits(*frames, window=window)) == wanted
        monkeypatch.undo()


def test_each_block_is_built_once_for_a_batch(spark, monkeypatch):
    """However many texts there are, and whether they are only looked at or cut."""
    built = []

    class Counted(decontamination.Automaton):
        def __init__(self, items, window):
            built.append(1)
            super().__init__(items, window)

    monkeypatch.setattr(decontamination, "Automaton", Counted)
    run = lambda k: " ".join(f"item{k}word{j}" for j in range(10))
    blocks = [((str(k), run(k).encode()),) for k in range(5)]
    clean = " ".join(f"clean{j}" for j in range(20))
    texts = [f"{clean} {run(k % 5)} end" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    batch = pa.table({"doc_id": list(range(40)), "text": texts}).to_batches()[0]
    monkeypatch.setattr(decontamination, "blocks_of", lambda *_: blocks)
    monkeypatch.setattr(decontamination, "by_batch", lambda rows, to_batch, schema: to_batch(batch))
    decontamination.automaton.cache_clear()
    found = decontamination.benchmark_hits(docs, docs, item_id="doc_id")
    assert found.column(3).to_pylist() == [[str(k % 5)] for k in range(40)] and len(built) == 5
    built.clear()
    decontamination.automaton.cache_clear()
    monkeypatch.undo()
    monkeypatch.setattr(decontamination, "Automaton", Counted)
    assert decontamination.cleaned([*texts, None, run(0)], blocks, 10, 0.5) == [f"{clean}  end"] * 40 + ["", None]
    assert len(built) == 10  # once more to see that nothing is left
    decontamination.automaton.cache_clear()


def test_decontamination_odd(odd, empty, spark):
    items = spark.createDataFrame([(1, "enough words to be shingled")], "item_id long, text string")
    found = decontamination.decontaminated(odd, items)
    assert found.columns == odd.columns
    texts = {r.text for r in found.where("doc_id = 4").collect()}
    assert texts == {"the same text twice under one id, with "}
    assert found.count() == len(ODD_ROWS)
    assert decontamination.decontaminated(odd, items, most_share=0.3).count() == len(ODD_ROWS) - 2
    assert decontamination.decontaminated(empty, items).count() == 0
    assert not any(row[5] for row in hits(odd, items.where("false")))
    # What is cut must not bring a new hit together.
    text = "keep enough words enough words to be shingled to be shingled keep and this is a longer rest of it"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    left = decontamination.decontaminated(docs, items)
    assert [" ".join(r.text.split()) for r in left.collect()] == ["keep keep and this is a longer rest of it"]


# 4 and 7


def library(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [(x.ids, tokenizer.decode(x.ids, skip_special_tokens=False)) for x in found]


def test_bpe_codec_and_counts(documents, odd, empty):
    for frame in (documents, odd):
        rows = frame.select("doc_id", "text").collect()
        wanted = library([r.text for r in rows])
        exactly(
            bpe_codec.bpe_codec(frame, PATH, digests=True),
            [(r.doc_id, len(i), brute.sha(",".join(map(str, i))), brute.sha(t)) for r, (i, t) in zip(rows, wanted)],
        )
        exactly(bpe_codec.bpe_codec(frame, PATH), [(r.doc_id, i, t) for r, (i, t) in zip(rows, wanted)])
        exactly(
            token_counts.token_counts(frame, PATH),
            [(r.doc_id, len((r.text or "").encode()), len(i), len(i) > 1024) for r, (i, _) in zip(rows, wanted)],
        )
    assert bpe_codec.bpe_codec(empty, PATH).count() == token_counts.token_counts(empty, PATH).count() == 0


def test_bpe_of_random_texts():
    draw = random.Random(11)
    letters = [*map(chr, range(0x250)), " ", "　", "​", "﻿", "\U0001f600", "漢", "́", "’"]
    texts = ["".join(draw.choice(letters if draw.random() < 0.5 else " '\nsretvlmd09<|endoftext|>-=") for _ in range(80)) for _ in range(3000)]
    texts += ["".join(draw.choice(own) for _ in range(3000)) for own in ("ab", "-=", "0", " ", "éè", "the", "\n ")]
    content = bpe_codec.read_vocabulary(PATH)
    for text, (ids, back) in zip(texts, library(texts)):
        assert list(bpe_codec.encode(text, content)) == ids
        assert token_counts.count_tokens(text, content) == len(ids)
        assert "".join(bpe_codec.decode(ids, bpe_codec.parsed(content))) == back


def test_bpe_window_never_changes_tokens():
    """Windows as small as the lookahead allows against all merges at once."""
    vocabulary = bpe_codec.parsed(bpe_codec.read_vocabulary(PATH))
    draw = random.Random(2)
    for own in ("ab", "aeiourstln", "=-", "*", "the and", "éèà"):
        piece = "".join(draw.choice(own) for _ in range(4000)).encode()
        whole = bpe_codec.merged([vocabulary.ids[b] for b in piece], vocabulary.merges)
        assert list(bpe_codec.transduce(piece, vocabulary, 2 * vocabulary.lookahead)) == whole


# 8


def test_codec_holds_no_list_of_a_long_text():
    """Ids and text leave in runs; the memory at the peak does not grow with the text."""
    content = bpe_codec.read_vocabulary(PATH)
    peaks = []
    for kind in ("".join(f"w{k}," for k in range(3000)), "x" * 12_000, "an, ordinary text. " * 900):
        for times in (8, 64):
            text = kind * times
            bpe_codec.encoder(content).forget()
            bpe_codec.digested(kind, content)
            tracemalloc.start()
            n, ids, back = bpe_codec.digested(text, content)
            peaks.append(tracemalloc.get_traced_memory()[1] - len(text))
            tracemalloc.stop()
            assert back == brute.sha(text) and n == token_counts.count_tokens(text, content)
            assert max(map(len, bpe_codec.encoded(text, content))) <= 4 * byte_bpe.STRETCH
        assert peaks[-1] < 1.5 * peaks[-2] + 4 * len(kind)


def test_memo_keeps_what_is_frequent():
    worked = []
    memo = byte_bpe.Memo(lambda piece: worked.append(piece) or piece.upper(), most=10)
    for k in range(1000):
        assert memo["often"] == "OFTEN" and memo[f"once {k}"] == f"ONCE {k}"
        assert len(memo) + len(memo.old) <= 20
    assert worked.count("often") == 1
    assert memo["x" * 41] == "X" * 41 and "x" * 41 not in memo
    memo.forget()
    assert not memo and not memo.old and memo["often"] == "OFTEN"


def test_pseudonyms():
    key = b"key"
    valid = {
        "card": ["4111 1111 1111 1111", "5555-5555-5555-4444", "378282246310005"],
        "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
        "phone": ["+1 (217) 555-7713", "(217) 555-7713", "+44 20 7946 0958"],
        "ip": ["97.51.17.173"],
        "ssn": ["123-45-6789"],
        "date": ["2024-02-29", "31.12.1999", "3/4/2020", "12/31/1999"],
        "email": ["jane.doe7@mail.example.com"],
    }
    for kind, values in valid.items():
        for value in values:
            new, kinds = pii.pseudonymised(f"see {value} here", key)
            assert kinds == [kind] and value not in new and new.startswith("see ") and new.endswith(" here")
            # Still of that format and valid, and the same everywhere.
            again, kinds = pii.pseudonymised(new, key)
            assert kinds == [kind] and again != new
            assert pii.pseudonymised(f"({value})", key)[0] == f"({new[4:-5]})"
    linked = {pii.digits_of(pii.card(x, key)) for x in ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111")}
    assert len(linked) == 1
    for invalid in ("4111 1111 1111 1112", "DE88 3704 0044 0532 0130 00", "300.1.1.1", "000-12-3456", "2023-02-29", "1234567890123"):
        assert pii.pseudonymised(invalid, key) == (invalid, [])


@pytest.mark.parametrize(
    "value, behind, kinds",
    [
        ("+1 217 555 7713", " 2024-01-15", ["date", "phone"]),
        ("+1 217 555 7713", " 2024", ["phone"]),
        ("+44 20 7946 0958", " 1234 5678", ["phone"]),
        ("+49 30 9018 2044", " 2024-01-15", ["date", "phone"]),
        ("+49 30 9018 20", " 123-45-6789", ["phone", "ssn"]),
        ("+49 30 9018 20", " 12@example.org", ["email", "phone"]),
        ("BE68 5390 0754 7034", " EUR", ["iban"]),
        ("AT61 1904 3002 3457 3201", " BIC", ["iban"]),
        ("NL91 ABNA 0417 1643 00", " IBAN 4111 1111 1111 1111", ["card", "iban"]),
    ],
)
def test_values_run_into_the_next_token(value, behind, kinds):
    alone, _ = pii.pseudonymised(value, b"key")
    new, found = pii.pseudonymised(f"see {value}{behind}", b"key")
    assert sorted(found) == kinds and new.startswith(f"see {alone}") and value not in new
    assert new[len(f"see {alone}") :] == pii.pseudonymised(behind, b"key")[0]


def test_search_goes_on_inside_invalid_candidates():
    for before in ("1234 ", "+99 12 ", "AB12 ", "AB"):
        value = "4111 1111 1111 1111" if before != "AB" else "4111111111111111"
        new, kinds = pii.pseudonymised(f"{before}{value}", b"key")
        assert kinds[-1:] == ["card"] and new.endswith(pii.pseudonymised(value, b"key")[0])
    assert pii.pseudonymised("+45 12.34.56.78", b"key")[1] == ["phone"]
    # Time stays linear on candidates that all fail.
    text = "+1 21 55 " * 20_000
    assert pii.pseudonymised(text, b"key") == (text, [])


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    found = [pii.permuted(x, size, b"k", "t") for x in range(size)]
    assert sorted(found) == list(range(size))
    assert size < 97 or found != [pii.permuted(x, size, b"other", "t") for x in range(size)]


def test_pii_odd(odd, empty, documents):
    found = pii.pii_pseudonyms(odd, b"k")
    assert set(found.columns) == set(odd.columns) and found.count() == len(ODD_ROWS)
    assert pii.pii_pseudonyms(empty, b"k").count() == 0
    assert [r.text for r in found.where("doc_id = 1").collect()] == [None]
    rows = documents.select("doc_id", "text").collect()
    wanted = {r.doc_id: pii.pseudonymised(r.text, b"k")[0] for r in rows}
    assert {r.doc_id: r.text for r in pii.pii_pseudonyms(documents, b"k").collect()} == wanted


# 9


def test_quality_features(documents, plain):
    found = quality.quality_rules(documents).select("doc_id", *quality.FEATURES, "base_failed")
    exactly(found, [(i, *brute.quality_base(t)) for i, t in plain])


def test_quality_odd(odd, empty):
    found = quality.quality_rules(odd)
    exactly(found.select("doc_id", *quality.FEATURES, "base_failed"), [(i, *brute.quality_base(t)) for i, t in PLAIN_ODD])
    assert found.where("base_failed AND kept").count() == 0
    assert quality.quality_rules(empty).count() == 0


def test_quality_thresholds_follow_their_group(spark):
    """What is usual in one source is an outlier in another; small groups use their language's limits."""
    draw = random.Random(1)
    words = lambda n: " ".join(f"{draw.randrange(10**6):06d}" for _ in range(n))
    rows = [(k, words(40), "en", "prose") for k in range(150)]
    rows += [(1000 + k, " ".join(f"| {w}" for w in words(40).split()), "en", "tables") for k in range(150)]
    table = " ".join(f"| {w}" for w in words(40).split())
    rows += [(5000, table, "en", "prose"), (5001, table, "en", "tables"), (5002, words(40), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert not kept[5000] and kept[5001] and kept[5002]
    assert sum(kept.values()) == len(rows) - 1


def test_quality_limits_differ_where_rates_do(spark):
    """A share of repeated lines, symbols and repeated words that is usual in one source is not in another."""
    word = lambda k, j: f"w{k:04d}x{j:03d}"

    def text(k, n_same, n_marks, n_again):
        lines = [" ".join(word(k, 12 * j + i) for i in range(12)) for j in range(20)]
        again = " ".join(word(k, 900 + i) for i in range(6))
        return "\n".join([*lines, *["one and the same line"] * (n_same + 1), "#" * n_marks + "x", *[again] * n_again])

    rows = [(k, text(k, 1, 3, 0), "en", "strict") for k in range(200)]
    rows += [(1000 + k, text(k, 6, 30, 3), "en", "loose") for k in range(200)]
    rows += [(5000, text(5000, 6, 30, 3), "en", "strict"), (5001, text(5000, 6, 30, 3), "en", "loose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: (r.kept, r.failed) for r in quality.quality_rules(docs).collect()}
    assert found[5001][0] and {"symbol_rate", "dup_line_rate"} <= set(found[5000][1])
    rows = quality.features(docs, "doc_id", "text", "lang", "source")
    limits = {r.of_source: r for r in quality.thresholds(rows, 100, 4).collect()}
    for name in ("symbol_rate_most", "dup_line_rate_most", "repeat_rate_most"):
        assert limits["strict"][name] < limits["loose"][name], name


def test_quality_runs_no_python(documents):
    plan = quality.quality_rules(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 10


def test_language_of_held_out_texts(documents):
    held_out = crc_of_id("doc_id") % 3 == 1
    model = language_id.train(documents, ~held_out)
    found = language_id.identified(documents, model).where(held_out).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_model_counts(spark, documents):
    """The matrix from one pass over tasks against counts text by text."""
    import numpy as np

    grams = language_id.Grams((1, 2), 1 << 8)
    model = language_id.train(documents, F.lit(True), grams)
    for k, lang in enumerate(model.languages):
        texts = [r.text for r in documents.where(F.col("lang") == lang).collect()]
        counts = sum(np.bincount(b, minlength=grams.buckets) for t in texts for b, _ in grams.slices([t])) + 0.5
        assert np.allclose(model.weights[k], np.log(counts / counts.sum()))


def test_language_odd(odd, empty, monkeypatch):
    model = language_id.train(odd, F.lit(True))
    found = language_id.identified(odd, model)
    assert set(found.columns) == set(odd.columns) and found.count() == len(ODD_ROWS)
    assert {(r.lang_pred, r.score) for r in found.where("doc_id IN (1, 2, 3, 11)").collect()} == {("und", 0.0)}
    assert language_id.identified(empty, model).count() == 0
    none = language_id.identified(odd, language_id.train(empty, F.lit(True)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    whole = {r.text: r.score for r in found.collect()}
    monkeypatch.setattr(language_id, "SLICE", 50)
    assert model.predict(list(whole))[1] == pytest.approx(list(whole.values()))


# All queries


# The others return phrases, pieces and components.
A_ROW_A_DOCUMENT = sorted(set(QUERIES) - {"op11_collocations", "op12_best_fit", "op13_whitening"})


@pytest.mark.parametrize("name", A_ROW_A_DOCUMENT)
def test_registered_query(spark, name):
    found = QUERIES[name](spark, DATA).toPandas()
    assert sorted(found.doc_id) == list(range(200))
