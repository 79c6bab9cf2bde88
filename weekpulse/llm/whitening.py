"""Whitened vectors from an exact scatter matrix.

Entries become whole numbers (``floor(64 c) + 1,000,000``). Each task takes blocks of rows, shifts every
dimension by its least value in the block and packs the bit planes of what is left, a row a bit, into
64-bit words. The sum of products of two dimensions is then the sum, over their planes a and b, of
``2^(a+b)`` times the set bits of the planes' AND; the shifts are put back as whole numbers. A task sends
one partial sum for each pair of dimensions, and these add up exactly in any order. The driver gets the
sums of all pairs (``d (d + 1) / 2`` of them, whatever the number of rows), centres them as whole numbers
(``n XX - S S'``) and only then divides and takes eigenvectors. A second pass projects the rows, and its
covariance is measured in one more, before the result.

Rows go whose vector is NULL or holds NULL, NaN, infinite or absurd (2^40 or more) entries, and those whose
vector has not as many entries as most have (the longer, if two lengths are equally frequent). Repeated
rows and NULL ids are rows of their own. Components without variance (a multiple of rounding) have NULL in
``whitened`` and stay out of the identity error; if there is no variance at all, ``explained`` and the
error are NULL, too. An empty table, or one without usable vectors, gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, OFFSET = 64, 1_000_000
MOST_ENTRY = 2.0**40
# Rows whose planes are packed together: 47 bits of an entry and 14 of these fit a long.
BLOCK = 1 << 14
COMPONENTS = 32
SUMS = "i int, j int, total decimal(38,0)"


def usable(vector: Column) -> Column:
    """NULL for a NULL vector; NaN is greater than any number."""
    return F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < MOST_ENTRY))


def whole(vectors: pa.Array, dimension: int) -> np.ndarray:
    """A row of whole numbers for each vector."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).astype(np.int64).reshape(-1, dimension) + OFFSET


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes by dimension and bit, the bit of each, and where each dimension's planes start."""
    n, d = y.shape
    bits = [max(int(top).bit_length(), 1) for top in y.max(axis=0)]
    starts = np.concatenate([[0], np.cumsum(bits)])
    planes = np.zeros((starts[-1], -(-n // 64) * 8), np.uint8)
    for bit in range(max(bits)):
        has = [i for i in range(d) if bits[i] > bit]
        packed = np.packbits(((y[:, has] >> bit) & 1).astype(np.uint8).T, axis=1)
        planes[starts[has] + bit, : packed.shape[1]] = packed
    return planes.view(np.uint64), np.concatenate([np.arange(b) for b in bits]), starts


def cross_products(y: np.ndarray) -> np.ndarray:
    """Sums of products of each two dimensions of numbers that are not negative, as Python numbers."""
    n, d = y.shape
    planes, bit, starts = bit_planes(y)
    # Within 62 bits the weighted counts are added as longs.
    narrow = 2 * int(bit.max() + 1) + n.bit_length() <= 62
    weight = np.left_shift(np.int64(1), bit) if narrow else np.array([1 << int(b) for b in bit], object)
    products = np.zeros((d, d), object)
    for i in range(d):
        row = 0
        others = planes[starts[i] :]
        for own in range(starts[i], starts[i + 1]):
            set_bits = np.bitwise_count(others & planes[own]).sum(axis=1, dtype=np.int64)
            row = row + set_bits * weight[starts[i] :] * weight[own]
        by_dimension = np.add.reduceat(row, starts[i:-1] - starts[i])
        products[i, i:] = products[i:, i] = by_dimension.astype(object)
    return products


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products, exact."""
    least = x.min(axis=0)
    y = x - least
    of_y, shift = y.sum(axis=0).astype(object), least.astype(object)
    products = cross_products(y) + len(x) * np.outer(shift, shift) + np.outer(shift, of_y) + np.outer(of_y, shift)
    return of_y + len(x) * shift, products


@dataclass(frozen=True)
class Fit:
    """Of the rows: their number, sums, eigenvalues and vectors (columns), largest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def with_variance(self) -> np.ndarray:
        rounding = self.dimension * np.finfo(float).eps * max(self.values[0], 0.0)
        return self.values > rounding

    def projection(self, components: int) -> np.ndarray:
        """Columns that whiten a centred row; NaN where there is no variance."""
        root = np.sqrt(np.where(self.with_variance(), self.values, np.nan))
        return (self.vectors / root)[:, :components]

    def explained(self, components: int) -> list[float | None]:
        total = float(self.values.sum())
        return [max(float(e), 0.0) / total if total > 0 else None for e in self.values[:components]]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact; as Python numbers where longs are too short."""
        shift = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - self.n * int(m) for s, m in zip(self.sums, shift)]
        near = x - shift
        if (int(np.abs(near).max(initial=0)) + 1) * self.n < 1 << 62:
            return self.n * near - np.array(rest, np.int64)
        return self.n * near.astype(object) - np.array(rest, object)

    def deviation(self, centred: np.ndarray) -> list[Decimal]:
        if centred.dtype == np.int64 and len(centred):
            top = int(np.abs(centred).max())
            if top * top * self.dimension >= 1 << 63:
                centred = centred.astype(object)
        return [Decimal(int(total)) for total in (centred * centred).sum(axis=1)]

    def whitened(self, centred: np.ndarray, components: int) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.projection(components)


def most_frequent_length(rows: DataFrame) -> int:
    """0 if there are no rows."""
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return top[0].d if top else 0


def fit(rows: DataFrame, dimension: int) -> Fit:
    """From rows of one column ``vector``, all of this length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, 0, 0
        for x in blocks(batches, dimension):
            own, pairs = scatter(x)
            n, total, products = n + len(x), total + own, products + pairs
        if n:
            i, j = np.triu_indices(dimension)
            exact = [Decimal(int(v)) for v in (*products[i, j], *total, n)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*i, *range(dimension), -1], pa.int32()),
                    pa.array([*j, *[-1] * dimension, -1], pa.int32()),
                    pa.array(exact, pa.decimal128(38, 0)),
                ],
                ["i", "j", "total"],
            )

    added = rows.mapInArrow(sums, SUMS).groupBy("i", "j").agg(F.sum("total").alias("total"))
    found = {(r.i, r.j): int(r.total) for r in added.collect()}
    n, total = found[-1, -1], [found[i, -1] for i in range(dimension)]
    covariance = np.empty((dimension, dimension))
    for i in range(dimension):
        for j in range(i, dimension):
            covariance[i, j] = covariance[j, i] = (n * found[i, j] - total[i] * total[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    return Fit(n, total, values[::-1], np.ascontiguousarray(vectors[:, ::-1]))


def blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    """Rows of several Arrow batches together, ``BLOCK`` at most."""
    held, n = [], 0
    for batch in batches:
        x = whole(batch.column(0), dimension)
        for start in range(0, len(x), BLOCK):
            part = x[start : start + BLOCK]
            if n + len(part) > BLOCK:
                yield np.concatenate(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if n:
        yield np.concatenate(held)


def identity_error(rows: DataFrame, fitted: Fit, components: int) -> float | None:
    """Measured on the whitened rows themselves: their covariance against the identity."""
    kept = np.flatnonzero(fitted.with_variance()[:components])
    if not len(kept):
        return None
    i, j = np.triu_indices(len(kept))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(len(kept)), np.zeros((len(kept), len(kept)))
        for x in blocks(batches, fitted.dimension):
            whitened = fitted.whitened(fitted.centred(x), components)[:, kept]
            total += whitened.sum(axis=0)
            products += whitened.T @ whitened
        names = pa.array([*i, *range(len(kept))], pa.int32()), pa.array([*j, *[-1] * len(kept)], pa.int32())
        yield pa.RecordBatch.from_arrays([*names, pa.array([*products[i, j], *total])], ["i", "j", "total"])

    added = rows.mapInArrow(sums, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    found = {(r.i, r.j): r.total / fitted.n for r in added.collect()}
    covariance = np.array([found[a, b] - found[a, -1] * found[b, -1] for a, b in zip(i, j)])
    return float(np.abs(covariance - (i == j)).max())


def whitened(docs: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error of each usable row."""
    rows = docs.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    dimension = most_frequent_length(rows)
    schema = T.StructType(
        [
            T.StructField("vec_id", rows.schema["vec_id"].dataType),
            *T._parse_datatype_string(
                "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
            ).fields,
        ]
    )
    if not dimension:
        return docs.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == dimension)
    vectors = rows.select("vector")
    fitted = fit(vectors, dimension)
    components = min(components, dimension)
    error = identity_error(vectors, fitted, components)
    explained = fitted.explained(components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            centred = fitted.centred(whole(batch.column(1), dimension))
            of_row = pa.array(np.repeat(np.arange(n), components))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(of_row),
                    pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * components, fitted.n)),
                    pa.array(fitted.deviation(centred), pa.decimal128(38, 0)).take(of_row),
                    pa.array(fitted.whitened(centred, components).ravel(), from_pandas=True),
                    pa.array(explained * n, pa.float64()),
                    pa.array([error] * (n * components), pa.float64()),
                ],
                schema.names,
            )

    return rows.mapInArrow(project, schema)
