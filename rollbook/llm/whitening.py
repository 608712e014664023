"""Whitening of embeddings by their principal components.

Entries become whole numbers, ``x = floor(256 c)``, so that what is distinct, counted and
summed is exact. The covariance of the distinct vectors, centred before it is multiplied,
is factored by Cholesky with pivots; one-sided Jacobi rotations make the columns of the
triangular factor orthogonal: their squared norms are the eigenvalues of the covariance
and the normalised columns its components. No square of a small eigenvalue is ever formed,
so the small ones keep their relative precision.

Spark counts, sums and multiplies; the driver gets sums by dimension and one matrix, which
are as large as a vector and its square whatever the number of rows.

Defined results: rows whose vector is null, empty, holds null or non-finite entries or one
that is no long after scaling (2^55 and more) take no part. Where vectors differ in length,
the most frequent length counts (of two the smaller) and the others take no part. Repeated
rows count once in the fit and have a result each. Components are those that the factor has
rank for: a table of equal vectors has none, so no rows, as has a table without rows. Each
component's largest entry is positive. ``deviation`` from 10^38 on is null. Other columns
are left out, whatever their names.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.sources.staging import stage

#: Fixed by the contract.
SCALE, COMPONENTS = 256, 4

_WIDE = pa.decimal128(38, 0)


@dataclasses.dataclass(frozen=True)
class Model:
    """What projects a vector: the count and sums of the fit, axes and their eigenvalues."""

    count: int
    sums: tuple[int, ...]
    axes: np.ndarray  # dimension x components
    values: np.ndarray
    total: float  # trace of the covariance

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.count for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.axes / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sums of (count * x - sums)^2, exact."""
        reach = self.count * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if len(self.sums) * reach**2 < 2**63:
            away = self.count * x - np.array(self.sums, dtype=np.int64)
            return pa.array((away * away).sum(axis=1)).cast(_WIDE)
        away = self.count * x.astype(object) - np.array(self.sums, dtype=object)
        exact = ((away * away).sum(axis=1)).tolist()
        return pa.array([Decimal(v) if v < 10**38 else None for v in exact], type=_WIDE)


# ------------------------------------------------------------------ the factors


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower triangular factor with the columns of its rank, and the order of its rows:
    ``matrix[order][:, order] = factor @ factor.T``."""
    size = len(matrix)
    left = np.diag(matrix).astype(float).copy()
    least = size * np.finfo(float).eps * left.max(initial=0.0)
    factor, order = np.zeros((size, size)), []
    for k in range(size):
        rest = np.setdiff1d(np.arange(size), order)
        pivot = rest[np.argmax(left[rest])]
        if left[pivot] <= least:
            break
        order.append(int(pivot))
        rest = rest[rest != pivot]
        factor[pivot, k] = math.sqrt(left[pivot])
        factor[rest, k] = (matrix[rest, pivot] - factor[rest, :k] @ factor[pivot, :k]) / factor[pivot, k]
        left[rest] -= factor[rest, k] ** 2
    rank = len(order)
    order = np.array(order + [i for i in range(size) if i not in order], dtype=int)
    return factor[order, :rank], order


def _rounds(count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of pairs that share no column."""
    places = list(range(count + count % 2))  # the last one is nobody if the count is odd
    half = len(places) // 2
    for _ in range(len(places) - 1):
        pairs = [(a, b) for a, b in zip(places[:half], reversed(places[half:])) if max(a, b) < count]
        yield np.array([a for a, _ in pairs], dtype=int), np.array([b for _, b in pairs], dtype=int)
        places = [places[0], places[-1], *places[1:-1]]


def jacobi(factor: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """The factor times a rotation that makes its columns orthogonal."""
    columns = factor.copy()
    close = max(len(factor), 1) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for a, b in _rounds(columns.shape[1]):
            left, right = columns[:, a], columns[:, b]
            p, q = (left * left).sum(axis=0), (right * right).sum(axis=0)
            cross = (left * right).sum(axis=0)
            off = np.abs(cross) > close * np.sqrt(p * q)
            if not off.any():
                continue
            turned = True
            slope = (q - p)[off] / (2 * cross[off])
            tangent = np.where(slope < 0, -1.0, 1.0) / (np.abs(slope) + np.hypot(1.0, slope))
            cosine = 1 / np.hypot(1.0, tangent)
            sine = cosine * tangent
            one, two = left[:, off], right[:, off]
            columns[:, a[off]] = cosine * one - sine * two
            columns[:, b[off]] = sine * one + cosine * two
        if not turned:
            return columns
    raise ArithmeticError(f"columns are not orthogonal after {sweeps} sweeps")


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and their unit vectors as columns."""
    factor, order = pivoted_cholesky(covariance)
    turned = jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    falling = np.argsort(-norms, kind="stable")
    axes = np.empty_like(turned)
    axes[order] = (turned / norms)[:, falling]
    largest = np.abs(axes).argmax(axis=0)
    axes *= np.sign(axes[largest, np.arange(axes.shape[1])])
    return norms[falling] ** 2, axes


# ------------------------------------------------------------------ whole tables


def whole(embeddings: DataFrame) -> DataFrame:
    """Rows with a usable vector as whole numbers ``x``."""
    size = 2.0**63 / SCALE
    usable = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < size, F.lit(False)))
    rows = embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(usable)
    return rows.select(
        "vec_id",
        F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("bigint")).alias("x"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and exact sums by dimension of one task's vectors."""
    count, sums = 0, None
    for batch in batches:
        x = _matrix(batch.column(0))
        if not len(x):
            continue
        small = len(x) * int(np.abs(x).max()) < 2**63 and x.min() > -(2**63)
        part = (x if small else x.astype(object)).sum(axis=0).tolist()
        count += len(x)
        sums = part if sums is None else [a + b for a, b in zip(sums, part)]
    if count:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(sums)), type=pa.int32()),
                pa.array([Decimal(s) for s in sums], type=_WIDE),
                pa.array([count] * len(sums), type=pa.int64()),
            ],
            names=["i", "total", "count"],
        )


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of products of one task's centred vectors, for i <= j."""
    total, empty = np.zeros((len(mean), len(mean))), True
    for batch in batches:
        if batch.num_rows:
            away = _matrix(batch.column(0)) - mean
            total += away.T @ away
            empty = False
    if not empty:
        i, j = np.triu_indices(len(mean))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, type=pa.int32()), pa.array(j, type=pa.int32()), pa.array(total[i, j])],
            names=["i", "j", "product"],
        )


def fit(vectors: DataFrame, limit: int = COMPONENTS) -> Model | None:
    """The model of distinct vectors ``x``, all of one length; None without any."""
    sums = vectors.mapInArrow(_sums, "i INT, total DECIMAL(38,0), count BIGINT")
    sums = sums.groupBy("i").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    sums = sorted(sums.collect())
    if not sums:
        return None
    count, size = sums[0]["count"], len(sums)
    totals = tuple(int(s["total"]) for s in sums)
    mean = np.array([s / count for s in totals])
    products = vectors.mapInArrow(lambda b: _products(b, mean), "i INT, j INT, product DOUBLE")
    products = products.groupBy("i", "j").agg(F.sum("product").alias("product")).toPandas()
    covariance = np.zeros((size, size))
    i, j = products["i"].to_numpy(), products["j"].to_numpy()
    covariance[i, j] = covariance[j, i] = products["product"].to_numpy() / count
    values, axes = components(covariance)
    return Model(count, totals, axes[:, :limit], values[:limit], float(np.trace(covariance)))


def _projected(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(1))
        if len(x):
            rows = pa.FixedSizeListArray.from_arrays(
                pa.array(model.project(x).ravel()), model.axes.shape[1]
            ).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), model.deviations(x), rows], names=["vec_id", "deviation", "whitened"]
            )


def project(rows: DataFrame, model: Model) -> DataFrame:
    """Each row's exact deviation and its whitened coordinates."""
    key = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(
        lambda b: _projected(b, model), f"vec_id {key}, deviation DECIMAL(38,0), whitened ARRAY<DOUBLE>"
    )


def identity_error(vectors: DataFrame, model: Model) -> float:
    """How far the covariance of the whitened vectors is from the identity at most."""
    count = model.axes.shape[1]
    flat = project(vectors.select(F.lit(0).alias("vec_id"), "x"), model)
    flat = flat.select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(count)])
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    found = flat.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def whitened(embeddings: DataFrame, limit: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component, of the largest eigenvalues ``limit``."""
    rows = whole(embeddings)
    length = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = rows.filter(F.size("x") == (length["length"] if length else 0))
    vectors = stage(rows.select("x").distinct(), "vectors")
    model = fit(vectors, limit)
    if model is None or not len(model.values):
        nothing = rows.filter("false").select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"))
        return nothing.select(
            "vec_id",
            F.lit(0).alias("component"),
            F.lit(0).cast("bigint").alias("n"),
            "deviation",
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
        )
    shares = F.array(*[F.lit(float(v / model.total)) for v in model.values])
    found = project(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.count).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(identity_error(vectors, model)).alias("identity_error"),
    )
