"""Whitened embeddings from an exact, bit-sliced scatter matrix.

Components are scaled to whole numbers, ``x = floor(64 c) + 1000000``, and every distinct vector of whole numbers is fitted
once. A task shifts each dimension by its least value, cuts the rest into bit planes and packs the planes of 64 rows into
one word. The sum over rows of ``x_i x_j`` is then the sum over planes a of i and b of j of ``2^(a + b)`` times the
number of rows with both bits, which is the popcount of the AND of two packed planes. Tasks return the counts per pair of
dimensions and weight; Spark adds them. So the scatter is exact for any number of rows, whatever the order. The driver
puts the shift back, centres in whole numbers (``n C - S S'``) and only then divides, for one eigenvalue problem in
double precision.

What reaches the driver depends on dimensions and planes (the bits between least and greatest value), never on the rows:
``dimensions^2 (2 planes - 1) / 2`` counts. Rows are whitened in a second narrow pass, with the model in the closure.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped; repeated rows are
whitened one by one and fitted once; a null ``vec_id`` is carried along; vectors of different length are different spaces,
each fitted on its own; entries beyond 2^50 count as 2^50; components without variance (eigenvalue below 1e-12 of the
trace, so all of a single vector) have no row; a deviation beyond 64 bits is null; an empty table gives an empty result.
Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilframe.llm.common import written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Whole numbers stay below this, so that 64 bits hold them and their differences.
BOUND = float(1 << 50)
#: Rows whose planes are counted at once: 64 words a plane.
BLOCK = 4096
#: Eigenvalues below this part of the trace are rounding.
FLOOR = 1e-12

WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


@dataclass
class Model:
    """What a fit knows: row count, sums, whitening directions (one column each) and their shares."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: np.ndarray
    largest: int  # of the absolute values of n x - S
    identity_error: float = 0.0


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.abs(c) < float("inf")), F.lit(False))


def whole(vector: Column) -> Column:
    """The scaled vector."""
    return F.transform(vector, lambda c: F.floor(
        F.greatest(F.least(F.lit(SCALE) * c, F.lit(BOUND)), F.lit(-BOUND))) + F.lit(SHIFT).cast("long"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def planes(block: np.ndarray, least: np.ndarray, bits: list[int]) -> np.ndarray:
    """Packed bit planes of the shifted rows: one row of words per dimension and bit."""
    shifted = (block - least).astype(np.uint64).T
    cut = np.concatenate([(shifted[dim] >> np.arange(wide, dtype=np.uint64)[:, None]) & np.uint64(1)
                          for dim, wide in enumerate(bits) if wide])
    packed = np.packbits(cut.astype(np.uint8), axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def counted(rows: DataFrame, least: list[int], bits: list[int]) -> DataFrame:
    """``i, j, weight, amount``: how many rows have both bits, by pair of dimensions and sum of bit numbers."""
    dims = np.repeat(np.arange(len(bits)), bits)
    weights = np.concatenate([np.arange(wide) for wide in bits]).astype(np.int64)
    low = np.array(least, dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(dims), len(dims)), dtype=np.int64)
        for batch in batches:
            values = matrix(batch.column(0))
            for first in range(0, len(values), BLOCK):
                packed = planes(values[first:first + BLOCK], low, bits)
                for plane in range(len(dims)):
                    both[plane, plane:] += np.bitwise_count(packed[plane] & packed[plane:]).sum(axis=1, dtype=np.int64)
        first, second = np.nonzero(both)
        # Planes a < b of one dimension meet twice in its square; pairs of dimensions are counted once.
        twice = 1 + ((dims[first] == dims[second]) & (first != second))
        spread = 2 * (weights.max(initial=0) + 1)
        cell = (dims[first] * len(bits) + dims[second]) * spread + weights[first] + weights[second]
        cells, place = np.unique(cell, return_inverse=True)
        amount = np.zeros(len(cells), dtype=np.int64)
        np.add.at(amount, place, both[first, second] * twice)
        pair, weight = np.divmod(cells, spread)
        i, j = np.divmod(pair, len(bits))
        yield pa.record_batch([pa.array(part.astype(np.int64)) for part in (i, j, weight, amount)],
                              names=["i", "j", "weight", "amount"])

    found = rows.select("x").mapInArrow(count, "i long, j long, weight long, amount long")
    return found.groupBy("i", "j", "weight").agg(F.sum("amount").alias("amount"))


def scatter(rows: DataFrame, least: list[int], bits: list[int]) -> list[list[int]]:
    """Exact sums of the products of the shifted columns."""
    sums = [[0] * len(bits) for _ in bits]
    if any(bits):
        for row in counted(rows, least, bits).collect():  # bounded by dimensions and planes
            sums[row["i"]][row["j"]] += row["amount"] << row["weight"]
    for i in range(len(bits)):
        for j in range(i):
            sums[i][j] = sums[j][i]
    return sums


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Model:
    """The model of a table ``x`` of distinct vectors of ``dim`` whole numbers."""
    at = [F.col("x")[place] for place in range(dim)]
    known = rows.select(
        F.count(F.lit(1)), F.array([F.min(value) for value in at]), F.array([F.max(value) for value in at]),
        F.array([F.try_sum(value) for value in at])).first()
    n, least, most, sums = known
    if None in sums:  # beyond 64 bits
        sums = [int(total) for total in rows.select(*[F.sum(value.cast("decimal(38,0)")) for value in at]).first()]
    bits = [(high - low).bit_length() for low, high in zip(least, most)]
    # Of the shifted columns; shifting changes no centred product.
    shifted = [total - n * low for total, low in zip(sums, least)]
    products = scatter(rows, least, bits)
    centred = [[n * products[i][j] - shifted[i] * shifted[j] for j in range(dim)] for i in range(dim)]
    covariance = np.array([[value / (n * n) for value in line] for line in centred])
    trace = sum(centred[i][i] for i in range(dim)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = [place for place in np.argsort(-values, kind="stable") if values[place] > FLOOR * trace][:components]
    largest = max(max(n * high - total, total - n * low) for low, high, total in zip(least, most, sums))
    model = Model(n, sums, vectors[:, order] / np.sqrt(values[order]), values[order] / trace if trace else values[order], largest)
    model.identity_error = deviation_from_identity(rows, model)
    return model


def centred_rows(block: np.ndarray, model: Model) -> np.ndarray:
    """``n x - S``, exact: in 64 bits where those hold it, else in Python's whole numbers."""
    wide = np.int64 if max(model.largest, *map(abs, model.sums)) < 1 << 62 and model.n * int(
        np.abs(block).max(initial=0)) < 1 << 62 else object
    return block.astype(wide) * model.n - np.array(model.sums, dtype=wide)


def projected(centred: np.ndarray, model: Model) -> np.ndarray:
    return (centred / model.n).astype(np.float64) @ model.directions


def deviations(centred: np.ndarray, model: Model) -> list[int | None]:
    """Squared lengths of the centred rows, exact."""
    if model.largest ** 2 * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    sums = ((line * line).sum() for line in centred.astype(object))
    return [value if value < 1 << 63 else None for value in sums]


def deviation_from_identity(rows: DataFrame, model: Model) -> float:
    """Largest entry of the whitened fit rows' covariance minus the identity, measured on the rows."""
    count = model.directions.shape[1]
    if not count:
        return 0.0

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            values = matrix(batch.column(0))
            for first in range(0, len(values), BLOCK):
                made = projected(centred_rows(values[first:first + BLOCK], model), model)
                total += made.T @ made
                held += made.sum(axis=0)
        flat = np.concatenate((total.ravel(), held))
        yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "amount"])

    parts = rows.select("x").mapInArrow(summed, "place long, amount double")
    flat = np.zeros(count * count + count)
    for row in parts.groupBy("place").agg(F.sum("amount").alias("amount")).collect():  # components ** 2 rows
        flat[row["place"]] = row["amount"]
    mean = flat[count * count:] / model.n
    covariance = flat[:count * count].reshape(count, count) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(count)).max())


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: `WHITENED`."""
    vector = F.col("embedding").cast("array<double>")
    # Filtered on the vector, not on what is made of it: a filter on x would have it made twice.
    rows = df.where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole(vector).alias("x"), F.size("embedding").alias("dim"))
    distinct = written(rows.groupBy("x", "dim").agg(F.count(F.lit(1)).alias("copies")), "whitening-fit")
    lengths = [row["dim"] for row in distinct.select("dim").distinct().collect()]  # one row per vector length
    models = {dim: fit(distinct.where(F.col("dim") == dim), dim, components) for dim in sorted(lengths)}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for dim in np.unique(lengths):
                model = models[int(dim)]
                chosen = pa.array(np.flatnonzero(lengths == dim))
                ids, vectors = batch.column(0).take(chosen), batch.column(1).take(chosen)
                for first in range(0, len(ids), BLOCK):
                    yield scored(ids.slice(first, BLOCK), matrix(vectors.slice(first, BLOCK)), model)

    return rows.select("vec_id", "x", "dim").mapInArrow(apply, WHITENED)


def scored(ids: pa.Array, block: np.ndarray, model: Model) -> pa.RecordBatch:
    centred = centred_rows(block, model)
    made = projected(centred, model)
    count = made.shape[1]
    each = np.repeat(np.arange(len(block)), count)
    columns = {
        "vec_id": ids.take(pa.array(each)),
        "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(block))),
        "n": pa.array(np.full(len(each), model.n, dtype=np.int64)),
        "deviation": pa.array(deviations(centred, model), pa.int64()).take(pa.array(each)),
        "whitened": pa.array(made.ravel()),
        "explained": pa.array(np.tile(model.explained, len(block))),
        "identity_error": pa.array(np.full(len(each), model.identity_error)),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))
