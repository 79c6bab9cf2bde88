"""MinHash near-dedup by a multi-index Hamming join, confirmed on full shingle sets.

A text's set holds its distinct shingles of five words (64-bit hashes). Its signature has ``SYMBOLS``
symbols of 16 bits of MinHash values. Two sets of Jaccard similarity 0.75 differ in 16 of 64 symbols on
average; the join finds every pair that differs in up to ``MOST_DIFFER`` = 31 (a set pair at 0.75 has
more with a chance of about 1 in 100,000). The signature is split into 16 chunks of 4 symbols: by the
pigeonhole principle a pair with at most 31 differences has a chunk with at most one, and the keys of
a chunk are its four choices of three symbols, one allowed error each.

1. Equal sets are one class, named by its smallest id; only classes go on.
2. In each key's bucket the smallest id is the centre. Each class is compared, on full sets, with the
   centre that it shares most keys with. Links found this way are joined to components.
3. Pairs inside a component need no look: they cannot change it. For the classes of buckets that still hold
   different components, the shingles that no other of them has are counted: they are in no
   intersection and in every union, so that most classes, and pairs, that are not similar enough are
   known by two numbers. The other pairs across components, if within the signature distance, are
   compared on full sets, too; a class that met a larger component is compared with it in blocks. So no link between components is lost, while a large group of near
   copies costs about one comparison a member, not all pairs.

All steps are joins and aggregations by key; hot buckets are reduced by partial minima, or are hot keys of
joins that adaptive execution splits. Tables that are used again are written to the shared folder.

NULL and empty texts, or texts without words, have an empty set and are linked with nothing. A row
without id is linked with nothing: its component is NULL and it is kept. Rows that repeat an id are one
document with the links of all of them. Ties go to the smaller id. An empty table gives no rows. Extra
columns are not read by ``near_duplicates`` and kept by ``without_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpulse.llm.components import components
from weekpulse.llm.tables import by_batch, written

WORDS = 5
SYMBOLS, CHUNK = 64, 4
MOST_DIFFER = 2 * SYMBOLS // CHUNK - 1
SEED = np.random.default_rng(20240115)
FACTORS = SEED.integers(0, 1 << 63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = SEED.integers(0, 1 << 63, SYMBOLS, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
AT_ONCE = 2048
# Members up to which a bucket's main component is met pair by pair; sets and shingles compared at once.
FEW, BLOCK, COLUMNS = 4, 256, 8192


def shingles(text: str) -> np.ndarray:
    """The sorted hashes of the text's distinct shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), WORDS - len(words))], np.uint64)
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(words) - WORDS + 1
    mixed = of_word[:last].copy()
    for at in range(1, WORDS):
        mixed ^= mixed >> np.uint64(31)
        mixed *= MIX
        mixed += of_word[at : at + last]
    mixed ^= mixed >> np.uint64(29)
    mixed *= MIX
    return np.unique(mixed)


def signature(own: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), AT_ONCE):
        part = own[start : start + AT_ONCE, None]
        np.minimum(least, ((part ^ MASKS) * FACTORS).min(axis=0), out=least)
    return ((least ^ (least >> np.uint64(32))) * MIX >> np.uint64(48)).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature its keys: chunk, symbol left out, and the chunk's other symbols."""
    chunks = signatures.astype(np.uint64).reshape(len(signatures), -1, CHUNK)
    keys = []
    for out in range(CHUNK):
        kept = [k for k in range(CHUNK) if k != out]
        key = np.arange(chunks.shape[1], dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(out)
        for k in kept:
            key = (key << np.uint64(16)) ^ chunks[:, :, k] if k == kept[0] else (key * MIX) ^ chunks[:, :, k]
        key ^= key >> np.uint64(31)
        keys.append(key * MIX)
    return np.concatenate(keys, axis=1).astype(np.int64)


def sketched(rows: DataFrame) -> DataFrame:
    """id, n_shingles, set_hash and symbols of (id, text) rows; no hash for an empty set."""

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, hashes, symbols = [], [], []
        for text in batch.column(1):
            own = shingles(text.as_py() or "")
            sizes.append(len(own))
            hashes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            symbols.append(signature(own).astype(np.int32) if len(own) else None)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(hashes, pa.binary()),
                pa.array(symbols, pa.list_(pa.int32())),
            ],
            ["id", "n_shingles", "set_hash", "symbols"],
        )

    return by_batch(rows, to_batch, "id long, n_shingles long, set_hash binary, symbols array<int>")


def keyed(classes: DataFrame) -> DataFrame:
    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        symbols = batch.column(1).flatten().to_numpy().reshape(-1, SYMBOLS)
        keys = index_keys(symbols)
        rows = np.repeat(np.arange(len(keys)), keys.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(rows))], ["key", "id"])

    return by_batch(classes.select("id", "symbols"), to_batch, "key long, id long")


def differing(left: str, right: str) -> Column:
    unlike = F.zip_with(left, right, lambda x, y: (x != y).cast("int"))
    return F.aggregate(unlike, F.lit(0), lambda n, x: n + x)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for left, right in zip(batch.column(2), batch.column(3)):
            one, other = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
            common = len(np.intersect1d(one, other, assume_unique=True))
            kept.append(100 * common >= percent * (len(one) + len(other) - common))
        return batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    first = sets.select(F.col("id").alias("a"), F.col("own").alias("set_a"))
    second = sets.select(F.col("id").alias("b"), F.col("own").alias("set_b"))
    return by_batch(pairs.join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b"), to_batch, "a long, b long")


def mixed_buckets(members: DataFrame) -> DataFrame:
    """The keys that have several components, each with the one that has most members."""
    counts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    found = counts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("most"))
    return found.where("parts > 1").select("key", F.col("most.component").alias("main"), F.col("most.n").alias("n_main"))


def linkable(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """With the number of shingles that no other candidate has; those with too many of them go."""

    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        at = np.repeat(np.arange(len(own)), [len(x) for x in own])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(own))], ["id", "shingle"])

    full = sets.join(candidates.select("id"), "id", "left_semi")
    single = by_batch(full.select("id", "own"), to_batch, "id long, shingle long").groupBy("shingle")
    single = single.agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    alone = single.groupBy("id").agg(F.count("*").alias("alone"))
    candidates = candidates.join(alone, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    return candidates.where(f"100 * (n - alone) >= {percent} * n")


def pairs_across(left: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket across components that can be similar enough, but for large main components.

    One of a pair is outside the bucket's main component, so that this need not meet itself. Shingles
    that only one candidate has are in no intersection, but in every union with it. A pair that meets in
    several buckets is made in the first of them: the least key that both bring.
    """
    own = ("id", "n", "symbols", "component", "alone")
    classes = left.groupBy(*own).agg(F.collect_list(F.struct("key", "main", "n_main")).alias("places"))

    def side(condition: str) -> DataFrame:
        rows = classes.withColumn("places", F.expr(f"filter(places, p -> {condition})"))
        return rows.select(*own, F.col("places.key").alias("keys"), F.explode("places").alias("place")).select(
            *own, "keys", "place.key", "place.main"
        )

    asking = side("component != p.main")
    right = side(f"component != p.main OR p.n_main <= {FEW}")
    right = right.toDF(*(f"{c}_b" for c in right.columns))
    most, least = "least(n - alone, n_b - alone_b)", "greatest(n + alone_b, n_b + alone)"
    # Where the first key is one at which id_b asks itself, the pair is made there, from id_b's side.
    return (
        asking.join(right, F.col("key") == F.col("key_b"))
        .where("component != component_b AND (component_b = main OR id < id_b)")
        .where(f"100 * {most} >= {percent} * {least}")
        .where(F.array_min(F.array_intersect("keys", "keys_b")) == F.col("key"))
        .where(differing("symbols", "symbols_b") <= MOST_DIFFER)
        .select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))
        .distinct()
    )


def linked_to_component(left: DataFrame, able: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links into the larger main components of the classes that met them in a bucket.

    The classes asked and the component's members go, in blocks, to one task for each pair of blocks,
    which counts all intersections as a product of two matrices and gives the links only.
    """
    asked = left.where(f"component != main AND n_main > {FEW}").select("id", F.col("main").alias("of")).distinct()
    asked = written(asked, "asked")
    of = able.select("id", F.col("component").alias("of")).join(asked.select("of").distinct(), "of", "left_semi")
    sides = asked.select("id", "of", F.lit(0).alias("side")).union(of.select("id", "of", F.lit(1).alias("side")))
    sizes = asked.groupBy("of").agg(F.count("*").alias("n_asked")).join(of.groupBy("of").agg(F.count("*").alias("n_of")), "of")
    blocks = lambda n: F.expr(f"CAST(ceil({n} / {BLOCK}) AS int)")
    own = F.when(F.col("side") == 0, blocks("n_asked")).otherwise(blocks("n_of"))
    others = F.when(F.col("side") == 0, blocks("n_of")).otherwise(blocks("n_asked"))
    dealt = (
        sides.join(sizes, "of")
        .withColumn("own", F.pmod(F.xxhash64("id"), own))
        .withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        .select(
            "id", "of", "side",
            F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("asking"),
            F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("answering"),
        )
    )

    def compare(table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()]
        size = np.array([len(x) for x in own], np.int64)
        values, at = np.unique(np.concatenate(own), return_inverse=True)
        row = np.repeat(np.arange(len(own)), size)
        one, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        common = np.zeros((len(one), len(other)), np.float32)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        for start in range(0, len(values), COLUMNS):
            part = slice(*np.searchsorted(at, (start, start + COLUMNS)))
            has = np.zeros((len(own), COLUMNS), np.float32)
            has[row[part], at[part] - start] = 1
            common += has[one] @ has[other].T
        union = size[one][:, None] + size[other][None, :] - common
        left, right = np.nonzero(100 * common.astype(np.int64) >= percent * union.astype(np.int64))
        a, b = ids[one[left]], ids[other[right]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.join(sets, "id").groupBy("of", "asking", "answering").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row."""
    if percent < 75:
        raise ValueError("the signature distance is set for similarities of 75 percent and more")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(sketched(texts), "signatures")
    filled = rows.where(F.col("id").isNotNull() & F.col("set_hash").isNotNull())
    classes = written(
        filled.groupBy("set_hash").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("symbols").alias("symbols")),
        "classes",
    )
    keys = keyed(classes)

    # Each bucket's centre, and for each class the centre that it shares most keys with.
    centres = written(
        keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("key", "a"),
        "centres",
    )
    together = keys.join(centres, "key")
    shared = together.where("id != a").groupBy("id", "a").count()
    nearest = shared.groupBy("id").agg(F.max(F.struct("count", (-F.col("a")).alias("a"))).alias("best"))
    first = written(nearest.select((-F.col("best.a")).alias("a"), F.col("id").alias("b")), "nearest")

    # Full sets, of the classes that share a bucket only.
    met = first.select("b").union(first.select("a")).union(centres.select("a")).distinct().toDF("met")
    sets = written(full_sets(texts.where("id IS NOT NULL").join(met, F.col("id") == F.col("met"), "left_semi")), "sets")
    links = written(linked(first, sets, percent), "links")
    part = components(links)

    placed = classes.select("id", "n", "symbols").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = written(placed, "placed")
    members = keys.join(centres.select("key"), "key", "left_semi").join(placed.select("id", "component"), "id")
    members = written(members.join(mixed_buckets(members), "key", "left_semi"), "members")
    able = written(linkable(members.select("id").distinct().join(placed, "id"), sets, percent), "linkable")
    left = members.select("key", "id").join(able, "id")
    left = written(left.join(written(mixed_buckets(left), "mixed"), "key"), "members")
    more = linked(written(pairs_across(left, percent), "across"), sets, percent)
    more = written(more.union(linked_to_component(left, able, sets, percent)), "links")

    # Ids that stand in several rows with different sets hold these sets' classes together.
    of_class = classes.select("set_hash", F.col("id").alias("class"))
    owners = filled.select("id", "set_hash").join(of_class, "set_hash")
    several = owners.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("last"), F.collect_set("class").alias("all"))
    same_id = several.where("a < last").select("a", F.explode("all").alias("b"))
    final = components(links.union(more).union(same_id).union(several.where("a < id AND a < last").select("a", F.col("id").alias("b"))))
    final = final.select(F.col("id").alias("class"), "component")

    named = of_class.join(final, "class", "left").select("set_hash", F.coalesce("component", "class").alias("component_id"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "set_hash").join(named, "set_hash", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def full_sets(texts: DataFrame) -> DataFrame:
    def to_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = pa.array([shingles(x.as_py() or "").tobytes() for x in batch.column(1)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), own], ["id", "own"])

    return by_batch(texts, to_batch, "id long, own binary")


def without_near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that are kept."""
    found = near_duplicates(docs, percent, id_col, text_col)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    ids = docs.columns
    placed = docs.toDF(*(f"c{k}" for k in range(len(ids))))
    return placed.join(gone, F.col(f"c{ids.index(id_col)}") == F.col("gone_id"), "left_anti").toDF(*ids)
