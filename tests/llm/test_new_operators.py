"""Collocations, best-fit packing and whitening against plain versions, on driver rows and odd ones."""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tests.llm.brute import lower
from weekpulse.llm import best_fit, collocations, whitening
from weekpulse.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


# Collocations


def plain_collocations(rows: list[tuple[str | None, str | None]], least: int, top: int) -> set[tuple]:
    counts: dict[str, Counter] = defaultdict(Counter)
    n: Counter = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        ranked = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase)))
            longer = [
                (b, other)
                for other, b in f.items()
                if len(other) > len(phrase) and b >= least
                and any(other[i : i + len(phrase)] == phrase for i in range(len(other) - len(phrase) + 1))
            ]
            if any(100 * b >= 80 * a for b, _ in longer):
                continue
            ranked.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def found_collocations(frame) -> set[tuple]:
    rows = frame.drop("n_left", "n_right").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_collocations_of_random_words_in_many_small_shards(spark):
    rng = random.Random(3)
    words = ["a", "B", "bb", "é", "漢字", "x-y", "#", "\x1c"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!", " ?"]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice(marks[:3] * 4 + marks) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "de", "und", None]), rng.choice([text, text, text, None, ""])))
    rows += [("en", "same words again and again " * 40)] * 3 + [("x", "only once"), ("y", " .. \n")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    docs = docs.withColumns({"n": F.lit("own"), "phrase": F.lit(1), "words": F.lit(2)})
    for least, top, shard in ((5, 2000, 1 << 20), (5, 7, 50), (30, 2000, 1)):
        found = collocations.collocations(docs, least, top, shard=shard)
        assert found_collocations(found) == plain_collocations(rows, least, top)


def test_collocations_count_their_extensions(spark):
    rows = [("en", "new york city")] * 30 + [("en", "new york state")] * 30 + [("en", "old new york")] * 30
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = {r.phrase: (r.a, r.n_left, r.n_right) for r in collocations.collocations(docs).collect()}
    assert found["new york"] == (90, 1, 2)
    assert found["old new york"] == (30, 0, 0)
    assert "york city" not in found


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    nulls = spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")
    assert collocations.collocations(nulls).collect() == []


def test_a_filter_without_hits_or_with_all_of_them_changes_nothing_but_work():
    symbols = np.random.default_rng(1).integers(0, 5, 400).astype(np.int32)
    symbols[0] = 0
    index = collocations.Index(
        [b"a", b"b", b"c", b"d"], collocations.transform(symbols), collocations.transform(symbols[::-1])
    )
    wanted = Counter()
    for k in range(1, 5):
        wanted.update(tuple(symbols[i : i + k]) for i in range(len(symbols) - k + 1) if symbols[i : i + k].all())
    for k in range(1, 5):
        phrases, size = collocations.grams(index, lambda rows: np.ones(len(rows), bool), k)
        found = {tuple(map(int, p)): int(n) for p, n in zip(phrases, size)}
        assert found == {tuple(map(int, p)): n for p, n in wanted.items() if len(p) == k}
        if k > 1:
            assert len(collocations.grams(index, lambda rows: np.zeros(len(rows), bool), k)[1]) == 0


class Driven:
    """Stands for a DataFrame; gives back what would run over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_collocations_hand_over_small_pieces(monkeypatch):
    rng = random.Random(5)
    texts = [[f"w{rng.randint(0, 400)}" for _ in range(300)] for _ in range(40)]
    docs = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * 40), pa.array([" ".join(t).encode() for t in texts], pa.binary())], ["lang", "text"]
    )
    (index,) = collocations.shards(Driven(), 1 << 20)(iter([docs]))
    symbols = 40 * 301 + 1
    assert max(len(index.column(name)[0].as_buffer()) for name in ("bwt", "reverse_bwt")) < 2 * symbols
    monkeypatch.setattr(collocations, "ROWS_OUT", 100)
    every = {n: SimpleNamespace(value=b"\xff" * (1 << (collocations.FILTER_BITS - 3))) for n in (1, 2)}
    rows = index.select(["lang", "words", "bwt"])
    wanted = Counter(pair for text in texts for pair in pairwise(text))
    for as_keys in (True, False):
        pieces = list(collocations.counted(Driven(), 2, every, as_keys)(iter([rows])))
        assert max(piece.num_rows for piece in pieces) <= 100
        found = [n for piece in pieces for n in piece.column("n").to_pylist()]
        assert sorted(found) == sorted(wanted.values())


def test_packed_ids_come_back():
    for ids in ([], [0], [0, 1, 255, 256, 65_535, 65_536, 2**31 - 1]):
        cell = pa.py_buffer(collocations.packed_ids(np.array(ids, np.int32)))
        assert collocations.unpacked_ids(cell).tolist() == ids


# Packing


@functools.cache
def tokenizer() -> Tokenizer:
    read = Tokenizer.from_file(PATH)
    read.no_truncation()
    read.no_padding()
    return read


def plain_pieces(text: str | None, size: int) -> list[tuple]:
    ids = np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    first = len(ids) % size
    starts = ([0] if first else []) + list(range(first, len(ids), size))
    return [
        (k, start, len(part := ids[start : start + (first if not start and first else size)]), zlib.crc32(part.tobytes()))
        for k, start in enumerate(starts)
    ]


def fewest_by_best_fit(lengths: list[int], size: int) -> int:
    room: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= length]
        if fits:
            room[room.index(min(fits))] -= length
        else:
            room.append(size - length)
    return len(room)


def check_packing(rows: list, texts: list[tuple], size: int) -> None:
    wanted = Counter((doc_id, *piece) for doc_id, text in texts for piece in plain_pieces(text, size))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for inside in sequences.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= size
    assert len(sequences) == fewest_by_best_fit([r.length for r in rows], size)


def test_packing_query(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    check_packing(QUERIES["op12_best_fit"](spark, DATA).collect(), texts, 1024)


def test_packing_of_odd_rows(spark):
    long = " ".join(f"word{k % 977}é other{k % 1013}" for k in range(12_000))
    texts = [(None, "no id"), (None, "no id"), (1, None), (2, ""), (3, long), (3, long + " "), (4, "<|endoftext|> twice <|endoftext|>")]
    texts += [(k, "word " * (k % 11)) for k in range(5, 90)] + [(100, " " * 5000), (101, "é漢\U0001f600" * 300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    docs = docs.withColumns({"rank": F.lit("own"), "piece": F.lit(9), "task": F.lit(1), "length": F.lit(None)})
    for size in (64, 1024):
        check_packing(best_fit.packed(docs, PATH, size).collect(), texts, size)
    named = best_fit.packed(spark.createDataFrame([("a", "text")], "doc_id string, text string"), PATH)
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() == 1
    assert best_fit.packed(docs.limit(0), PATH).collect() == []


@pytest.mark.parametrize("size", [8, 20, 64])
def test_a_plan_uses_as_few_sequences_as_best_fit(size):
    rng = random.Random(size)
    for _ in range(60):
        top = rng.choice([size, size // 2, 3])
        lengths = [rng.randint(1, top) for _ in range(rng.randint(0, 200))]
        slots = best_fit.plan(Counter(lengths), size)
        held = Counter()
        for length in set(lengths):
            own = sorted(s for s in slots if s[0] == length)
            ends = [s[1] for s in own[1:]] + [lengths.count(length)]
            for (_, rank, first, each, _), end in zip(own, ends):
                held.update(first + k // each for k in range(end - rank))
        assert len(held) == fewest_by_best_fit(lengths, size)


def test_slots_do_not_grow_with_the_number_of_documents():
    few = best_fit.plan({n: 1_000 for n in range(1, 1025)}, 1024)
    many = best_fit.plan({n: 1_000_000_007 for n in range(1, 1025)}, 1024)
    assert len(many) < 3 * len(few) < 135_168


# Whitening


def plain_whitening(vectors: list[list[float]]) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    z = [[n * a - s for a, s in zip(row, sums)] for row in x]
    d = len(sums)
    cov = np.array([[sum(r[i] * r[j] for r in z) / n**3 for j in range(d)] for i in range(d)])
    return np.array([[a / n for a in r] for r in z]), [sum(a * a for a in r) for r in z], cov, np.linalg.eigvalsh(cov)[::-1]


def check_whitening(rows: list, vectors: dict, components: int = 32) -> None:
    ids = sorted(vectors)
    centred, deviation, cov, values = plain_whitening([vectors[i] for i in ids])
    components = min(components, len(values))
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(found) == len(rows) == len(ids) * components
    whitened = np.array([[found[i, k + 1].whitened for k in range(components)] for i in ids], float)
    for at, i in enumerate(ids):
        assert found[i, 1].deviation == deviation[at] and found[i, 1].n == len(ids)
    for k in range(components):
        assert found[ids[0], k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-6, abs=1e-9)
    live = [k for k in range(components) if values[k] > 1e-9 * values[0]]
    measured = whitened[:, live].T @ whitened[:, live] / len(ids) - np.eye(len(live))
    assert np.abs(measured).max() < 1e-6 and rows[0].identity_error < 1e-6
    # Each component is an eigenvector: the covariance of rows with the scores points along it.
    along = centred.T @ whitened[:, live] / len(ids)
    assert np.allclose(cov @ along, along * values[live], rtol=1e-6, atol=1e-6 * values[0])


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    usable = {r.vec_id: r.embedding for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)}
    check_whitening(QUERIES["op13_whitening"](spark, DATA).collect(), usable)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = {k: [float(c) for c in rng.normal(size=6) * [1, 2, 4, 0.1, 8, 1000]] for k in range(200)}
    good[7] = good[8] = [-2.5, 1e3, 3.0, 0.0, 1e4, -1e4]
    bad = [(900, None), (901, [1.0, None, 0, 0, 0, 0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5)]
    bad += [(904, []), (905, [1.0, 2.0]), (906, [1e300] * 6)]
    bad = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in bad]
    docs = spark.createDataFrame([*good.items(), *bad], "vec_id long, embedding array<double>").repartition(3)
    docs = docs.withColumns({"n": F.lit("own"), "vector": F.lit(0), "component": F.lit(1)})
    check_whitening(whitening.whitened(docs).collect(), good)
    assert {r.component for r in whitening.whitened(docs, components=2).collect()} == {1, 2}


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)] + [(None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = whitening.whitened(same).collect()
    assert len(rows) == 8
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(4, 0, None, None, None)}
    line = spark.createDataFrame([(k, [float(k), 5.0]) for k in range(4)], "vec_id long, embedding array<float>")
    second = [r for r in whitening.whitened(line).collect() if r.component == 2]
    assert {(r.whitened, r.explained) for r in second} == {(None, 0.0)}
    none = whitening.whitened(same.limit(0))
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert none.collect() == []


def test_cross_products_are_exact_for_wide_numbers():
    rng = np.random.default_rng(2)
    for bits, n in ((1, 200), (8, 3000), (24, 65), (46, 130)):
        x = rng.integers(-(1 << bits), 1 << bits, (n, 5))
        x[:, 3] = 7
        sums, products = whitening.scatter(x)
        exact = x.astype(object)
        assert list(sums) == list(exact.sum(axis=0))
        assert (products == exact.T @ exact).all()


def test_a_deviation_beyond_a_long_is_exact():
    fitted = whitening.Fit(1 << 40, [0, 0], np.ones(2), np.eye(2))
    x = np.array([[1_000_000, -3]])
    assert fitted.deviation(fitted.centred(x)) == [(1_000_000**2 + 9) << 80]
