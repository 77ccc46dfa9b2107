"""Whitening of embeddings: float32 eigenvectors refined by matrix products.

One pass over the vectors gives their number, exact sums and the covariance, centred before
multiplying: each task centres about its own mean, and moments are merged pairwise, the
difference of two means in exact integers. Merging is a tree of tasks; the driver gets one
record, whose size is the square of the dimension.

The covariance is decomposed in float32. Each Ogita-Aishima iteration then corrects the
eigenvectors X by X + X E, where E comes from the residuals I - X'X and X'VX, computed in
extended precision; the error falls with its square. Eigenvalues too close for the residuals
to tell apart form clusters. A cluster's part of X'VX, shifted by its mean eigenvalue, is
decomposed by itself in float32 and its eigenvectors are rotated by the result, which the next
iteration refines; so even clusters far below the resolution of float32 come apart, and equal
eigenvalues keep an orthonormal basis.

A second pass centres and multiplies the whitened values in the same way; how far that
covariance is from the identity is reported beside them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import pieces

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**46  # beyond it floor(64 * c) has no exact double
STEPS = 40
FAN_IN = (64, 8, 1)  # tasks per level of the tree that merges moments
HELD = 1 << 21  # entries of vectors taken at once


# -- eigenvectors ------------------------------------------------------------------------


def _rounding(dim: int) -> float:
    """What rounding leaves in products of matrices of this dimension, with a margin."""
    return 8 * float(np.finfo(np.longdouble).eps) * dim


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """One iteration: eigenvectors, eigenvalues, the distance below which two eigenvalues
    could not be told apart, and whether the residuals were nothing but rounding."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # or a difference in rounding, over a small gap, spoils the angles
    values = np.diag(s) / (1 - np.diag(r))
    rest = (s - np.diag(values)).astype(np.float64)
    most, rounding = np.abs(values).max(), _rounding(len(a))
    close = 2 * (np.linalg.norm(rest, 2) + np.linalg.norm(r.astype(np.float64), 2) * most)
    if close <= most * rounding:
        return x, values, float(most * rounding), True
    gap = values[None, :] - values[:, None]
    residual = s + values[None, :] * r
    told = (np.abs(gap) > max(close, most * rounding)) & (np.abs(residual) > most * rounding / 32)
    e = np.where(told, residual / np.where(told, gap, 1), r / 2)
    return x + x @ e, values, float(max(close, most * rounding)), False


def _clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Positions of eigenvalues, in runs in which each is within ``close`` of the next."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > close) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def _turn(inner: np.ndarray) -> np.ndarray:
    """The float32 eigenvectors of a cluster's part, made orthonormal beyond float32."""
    scaled = (inner + inner.T) / (2 * np.abs(inner).max())
    turn = np.linalg.eigh(scaled.astype(np.float32))[1].astype(np.longdouble)
    for _ in range(3):
        turn = turn @ (1.5 * np.eye(len(turn), dtype=turn.dtype) - turn.T @ turn / 2)
    return turn


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    matrix = np.asarray(matrix, np.float64)
    size = np.abs(matrix).max(initial=0.0)
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = (matrix / size).astype(np.longdouble)
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    tiny = _rounding(len(a))
    for _ in range(STEPS):
        x, values, close, exact = _refined(a, x)
        turned = False
        for own in _clusters(values, close):
            part = x[:, own]
            middle = values[own].mean()
            inner = part.T @ (a @ part - middle * part)
            beside = np.abs(inner - np.diag(np.diag(inner))).max()
            if beside > tiny:
                x[:, own] = part @ _turn(inner)
                turned = True
        if exact and not turned:
            break
    values = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x * x).sum(axis=0))[order]
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


# -- moments -----------------------------------------------------------------------------


@dataclass
class Moments:
    """Count, sum and centred products of rows; sums of integers stay exact."""

    n: int
    total: np.ndarray  # Python integers, or doubles
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        if rows.dtype == np.int64:
            low = rows[0].copy()
            near = (rows - low).astype(np.float64)
            whole = low.astype(object) * len(rows) + [sum(c) for c in _halves(rows - low)]
        else:
            near, whole = rows, rows.sum(axis=0)
        near = near - near.mean(axis=0)
        near -= near.mean(axis=0)
        return cls(len(rows), whole, near.T @ near)

    def add(self, other: Moments) -> Moments:
        n = self.n + other.n
        between = other.total * self.n - self.total * other.n  # n a * n b times the difference
        between = (between / (self.n * other.n)).astype(np.float64)
        products = self.products + other.products
        products += np.outer(between, between * (self.n * other.n / n))
        return Moments(n, self.total + other.total, products)

    def record(self) -> tuple[int, list[str], list[float]]:
        return self.n, [repr(v.item() if hasattr(v, "item") else v) for v in self.total], self.products.ravel().tolist()

    @classmethod
    def read(cls, n: int, total: list[str], products: np.ndarray, whole: bool) -> Moments:
        sums = np.array([int(v) if whole else float(v) for v in total], object if whole else np.float64)
        return cls(n, sums, np.asarray(products, np.float64).reshape(len(total), -1))


def _halves(near: np.ndarray) -> list[tuple[int, int]]:
    """Exact column sums of non-wrapping 64-bit integers, from two parts that can't overflow."""
    high, low = near >> 24, near & 0xFFFFFF
    return [(int(h) << 24, int(b)) for h, b in zip(high.sum(axis=0), low.sum(axis=0))]


MOMENTS = "n bigint, total array<string>, products array<double>"


def _moments(rows: DataFrame, matrix: Callable[[pa.RecordBatch], np.ndarray], whole: bool, wide: int) -> Moments | None:
    """The moments of all rows of a DataFrame whose batches ``matrix`` turns into numbers."""

    def packed(held: Moments | None) -> Iterator[pa.RecordBatch]:
        if held:
            n, total, products = held.record()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n], pa.int64()),
                    pa.array([total], pa.list_(pa.string())),
                    pa.array([products], pa.list_(pa.float64())),
                ],
                ["n", "total", "products"],
            )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in pieces(batches, wide):
            if batch.num_rows:
                own = Moments.of(matrix(batch))
                held = held.add(own) if held else own
        yield from packed(held)

    def read(rows: list) -> Moments | None:
        held = None
        for n, total, products in rows:
            own = Moments.read(n, total, products, whole)
            held = held.add(own) if held else own
        return held

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in pieces(batches, 1):
            n, total, products = (c[0] for c in batch.columns)
            own = Moments.read(n.as_py(), total.as_py(), products.values.to_numpy(), whole)
            held = held.add(own) if held else own
        yield from packed(held)

    found = rows.mapInArrow(first, MOMENTS)
    for many in FAN_IN:
        found = found.repartition(many).mapInArrow(merge, MOMENTS)
    return read([tuple(r) for r in found.collect()])


# -- the operator ------------------------------------------------------------------------


def complete(vector: Column) -> Column:
    """There, not empty, every entry there, finite and small enough to be exact."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < LARGEST)), F.lit(False))


def _entries(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as integers, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(-1, dim) * SCALE).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Whitening:
    """What the fit has learned: count, exact sums, eigenvalues and unit eigenvectors."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """How many eigenvalues are above what rounding leaves of zero."""
        return int((self.values > self.values[:1] * len(self.values) * 2.0**-50).sum()) if self.trace > 0 else 0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the whole part of the mean, and what the mean has beyond it, times n."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return x - whole, np.array([s % self.n for s in self.sums], np.int64)

    def project(self, x: np.ndarray, count: int) -> np.ndarray:
        """Whitened values of at most ``count`` components that vary."""
        near, rest = self.centred(x)
        count = min(count, self.rank)
        axes = self.vectors[:, :count] / np.sqrt(self.values[:count])
        return (near - rest / self.n) @ axes

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n x - S) squared."""
        near, rest = self.centred(x)
        widest = int(np.abs(near).max(initial=0)) * self.n + self.n
        kind = np.int64 if widest * widest * len(rest) < 2**63 else object
        off = near.astype(kind) * self.n - rest.astype(kind)
        return (off * off).sum(axis=1).tolist()


def vectors_of(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, vector) of the complete vectors of the most frequent length, and that length."""
    rows = table.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(complete(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    dim = most["dim"] if most else 0
    return rows.filter(F.size("vector") == dim), dim


def fit(rows: DataFrame, dim: int) -> Whitening | None:
    """The whitening of all rows (key, vector), None without rows."""
    found = _moments(
        rows.select("vector"), lambda b: _entries(b.column(0), dim), True, max(1, HELD // max(1, dim))
    )
    if found is None:
        return None
    covariance = found.products / found.n
    values, axes = eigen(covariance)
    return Whitening(found.n, tuple(int(s) for s in found.total), values, axes, float(np.trace(covariance)))


def identity_error(rows: DataFrame, dim: int, model: Whitening, count: int) -> float | None:
    """The largest entry of the whitened values' covariance less the identity, by a pass over
    all rows; None where no component varies."""
    count = min(count, model.rank)
    if not count:
        return None
    found = _moments(
        rows.select("vector"),
        lambda b: model.project(_entries(b.column(0), dim), count),
        False,
        max(1, HELD // max(1, dim)),
    )
    return float(np.abs(found.products / found.n - np.eye(count)).max())


WHITENED = (
    "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def whiten(
    table: DataFrame, count: int = COMPONENTS, *, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every vector.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; so are
    entries of 2 ** 46 or more, which have no exact scaled integer, and vectors of another
    length than the most frequent one (of two, the longer), as a covariance has one dimension.
    Repeated rows count and come back as often as they are; a null key is a key like any other.
    Components are at most the dimension. A component without variance (equal vectors, a
    constant dimension, fewer vectors than dimensions) has whitened null and explained 0, and
    identity_error is over the others, null if there are none. An empty table gives no rows.
    Other columns are not looked at.
    """
    rows, dim = vectors_of(table, key, vector)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"{key} {kind}, {WHITENED}"
    model = fit(rows, dim) if dim else None
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    shown = min(count, dim)
    error = identity_error(rows, dim, model, shown)
    share = np.zeros(shown)
    live = min(shown, model.rank)
    share[:live] = model.values[:live] / model.trace if live else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, max(1, min(HELD // dim, HELD // (8 * shown)))):
            x = _entries(batch.column(1), dim)
            if not len(x):
                continue
            each = np.repeat(np.arange(len(x)), shown)
            values = np.full((len(x), shown), np.nan)
            values[:, :live] = model.project(x, live)
            off = pa.array(model.deviations(x), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n, np.int64)),
                    off.take(pa.array(each)),
                    pa.array(values.ravel(), mask=np.isnan(values.ravel())),
                    pa.array(np.tile(share, len(x))),
                    pa.array([error] * len(each), pa.float64()),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def digest(table: DataFrame) -> DataFrame:
    """The contract's columns; a deviation beyond a long fails, as it must be exact."""
    return whiten(table).withColumn("deviation", F.col("deviation").cast("bigint"))
