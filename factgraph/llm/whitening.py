"""Embedding whitening: two passes for the covariance, an eigendecomposition, and a broadcast projection.

Vectors become integers, x = floor(64 c) + 1000000, and the fit list holds each distinct x once. The first pass over the list sums the integers
exactly, which gives the mean; the second centres each vector, multiplies (one matrix product a batch) and adds up. Either pass leaves one
partial result a partition, merged by `treeAggregate`, so the driver sees a few matrices of dimension x dimension and no vector. LAPACK's
symmetric solver gives the components, numbered by falling eigenvalue, their largest entry positive; a last pass over the list measures the
covariance of what was whitened. The projection alone is broadcast: it grows with the dimension, not with the rows.

Cases: a vector that is null, or has a null or non-finite entry, leaves its row out, and so does a length other than the commonest one (of equally
common ones the longest), as such a vector has no place in the space. Entries beyond 2^34 count as 2^34, signed. Repeated rows and ties all stay
and get equal values; a null key stays. A component without variance (less than rounding: fewer distinct vectors than dimensions, a
constant dimension) gives null for `whitened` and is left out of identity_error; `explained` is null where nothing varies at all. A deviation
that doesn't fit in 64 bits is null. An empty table, or one without a usable vector, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm._spark import materialise

SCALE, SHIFT, COMPONENTS, FURTHEST = 64, 1_000_000, 16, float(2**40)
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Whitening:
    """What whitening needs of the fit list. mean = base + rest, base whole; projection: dimension x components, null columns as NaN."""

    n: int
    sums: tuple[int, ...]
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    projection: np.ndarray


def quantised(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, x) of the rows whose vector is whole."""
    wide = F.col(column).cast("array<double>")
    broken = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    inside = lambda c: F.greatest(F.lit(-FURTHEST), F.least(F.lit(FURTHEST), c * SCALE))
    whole = rows.select(F.col(key).alias("key"), wide.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~broken)
    return whole.select("key", F.transform("v", lambda c: F.floor(inside(c)).cast("long") + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, size)


def _tree(rows: DataFrame, part: Callable[[Iterator[np.ndarray]], np.ndarray], add: Callable, size: int):
    """part() of every partition's vectors, merged by `add` in a tree; None where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(_matrix(b.column(0), size) for b in batches if b.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(found).tobytes()], pa.binary())], names=["part"])

    merge = lambda a, b: b if a is None else a if b is None else add(a, b)
    parts = rows.select("x").mapInArrow(run, "part binary").rdd.map(lambda r: bytes(r.part))
    return parts.treeAggregate(None, merge, merge, 2)


def exact_sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and their sums by dimension, exact whatever their size."""

    def part(batches: Iterator[np.ndarray]) -> np.ndarray | None:
        total = np.zeros((2, size + 1), np.int64)  # high and low halves; the last column counts
        for x in batches:
            total[0, :size] += (x >> 32).sum(0)
            total[1, :size] += (x & _LOW).sum(0)
            total[1, size] += len(x)
            total[0] += total[1] >> 32
            total[1] &= _LOW
        return total if total.any() else None

    def add(a: bytes, b: bytes) -> bytes:
        total = np.frombuffer(a, np.int64).reshape(2, -1) + np.frombuffer(b, np.int64).reshape(2, -1)
        total[0] += total[1] >> 32
        total[1] &= _LOW
        return total.tobytes()

    found = _tree(rows, part, add, size)
    if found is None:
        return 0, [0] * size
    high, low = np.frombuffer(found, np.int64).reshape(2, -1)
    sums = [(int(h) << 32) + int(w) for h, w in zip(high, low)]
    return sums[-1], sums[:-1]


def _products(rows: DataFrame, size: int, width: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the outer products of centred(x), with the sums of the vectors themselves as a last row."""

    def part(batches: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in batches:
            total = np.zeros((width + 1, width)) if total is None else total
            for at in range(0, len(x), 8192):
                z = centred(x[at : at + 8192])
                total[:width] += z.T @ z
                total[width] += z.sum(0)
        return total

    found = _tree(rows, part, lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes(), size)
    return np.frombuffer(found).reshape(width + 1, width)


def dimension(rows: DataFrame) -> int | None:
    """The commonest length."""
    found = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("rows")).agg(F.max(F.struct("rows", "size")).alias("m")).first()
    return found.m["size"] if found and found.m else None


def fit(distinct: DataFrame, size: int, most: int = COMPONENTS) -> Whitening:
    """The whitening of a list of distinct vectors x, all of `size` entries."""
    n, sums = exact_sums(distinct, size)
    base = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, base)])
    covariance = _products(distinct, size, size, lambda x: (x - base) - rest)[:size] / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    flat = values <= max(trace, 0.0) * size * np.finfo(float).eps
    with np.errstate(invalid="ignore", divide="ignore"):
        projection = np.where(flat, np.nan, vectors / np.sqrt(np.where(flat, 1.0, values)))
    explained = np.maximum(values, 0.0) / trace if trace > 0 else np.full(len(values), np.nan)
    return Whitening(n, tuple(sums), base, rest, values, vectors, explained, projection)


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list) - identity, over the components that have variance."""
    held = np.flatnonzero(~np.isnan(model.projection).any(0))
    if not len(held):
        return None
    projection, base, rest = model.projection[:, held], model.base, model.rest
    # the mean is taken off before the projection; what rounding leaves of it is in the last row
    found = _products(distinct, len(base), len(held), lambda x: ((x - base) - rest) @ projection)
    mean = found[-1] / model.n
    return float(np.abs(found[:-1] / model.n - np.outer(mean, mean) - np.eye(len(held))).max())


def deviations(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Sum over dimensions of (n x - S)^2 of each row, and whether it fits in 64 bits."""
    far = np.array([s - model.n * int(m) for s, m in zip(model.sums, model.base)], np.int64)
    near = x - model.base
    rough = model.n * near.astype(np.float64) - far
    fits = (rough**2).sum(1) < 2.0**63 * (1 - 1e-12)
    y = np.where(fits[:, None], near, 0) * np.int64(model.n) - np.where(fits[:, None], far, 0)
    return (y * y).sum(1), fits


def whiten(rows: DataFrame, model: Whitening, error: float | None, key: str = "vec_id") -> DataFrame:
    """A row for each (key, x) and component."""
    spark, size, many = rows.sparkSession, len(model.base), model.projection.shape[1]
    held = spark.sparkContext.broadcast((model, error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, error = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                x = _matrix(batch.column(1), size)
                deviation, fits = deviations(x, model)
                white = (((x - model.base) - model.rest) @ model.projection).ravel()
                each = np.repeat(np.arange(len(x)), many)
                again = lambda v: np.tile(v, len(x))
                explained = again(model.explained)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(each)), pa.array(again(np.arange(1, many + 1, dtype=np.int32))), pa.array(np.full(len(each), model.n, np.int64)),
                     pa.array(deviation[each], mask=~fits[each]), pa.array(white, mask=np.isnan(white)), pa.array(explained, mask=np.isnan(explained)),
                     pa.array([error] * len(each), pa.float64())],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.where(F.size("x") == size).select("key", "x").mapInArrow(run, _schema(rows, key))


def _schema(rows: DataFrame, key: str) -> T.StructType:
    more = T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")
    return T.StructType([T.StructField(key, rows.schema["key"].dataType), *more.fields])


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with a whole vector, for each component up to `most`."""
    rows = quantised(vectors, key, column)
    distinct = materialise(rows.select("x").distinct(), "vectors")
    size = dimension(rows)
    if size is None:
        return vectors.sparkSession.createDataFrame([], _schema(rows, key))
    distinct = distinct.where(F.size("x") == size)
    model = fit(distinct, size, most)
    return whiten(rows, model, identity_error(distinct, model), key)
