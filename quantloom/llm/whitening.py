"""Whitening of embeddings by their leading components, found by spectrum slicing.

Entries become integers (x = floor(SCALE * c) + SHIFT), so counts, sums and deviations are exact. The covariance is that of the fit list,
which has each distinct vector once, so copies don't weigh. Tasks centre their vectors exactly and add up products; the sums
of all tasks, one d x d matrix, come to the driver.

Components are found by slicing the spectrum. The LDL' factorisation of the covariance less a shift has as many positive pivots as there
are eigenvalues above the shift (Sylvester's law of inertia). Bisection on that count isolates each leading eigenvalue in an
interval of its own; inverse iteration from its middle and then Rayleigh quotient iteration, which converges cubically, find
the eigenvector; and two counts close to the value, one on each side, certify its number. An eigenvalue that shares its
interval down to the last digits is one of several equal ones; its vector is taken at right angles to those already found.

Defined cases: rows whose vector is null or has null or non-finite entries are dropped; so are rows of another length than
most distinct vectors have (the longer one if two lengths are as frequent), and empty vectors; entries beyond LARGEST count
as LARGEST; fewer than COMPONENTS components come out where the vectors span fewer dimensions, so a single distinct vector gives no
rows; a null id is kept like any other, rows that repeat are whitened alike; an empty table gives no rows. A deviation that
does not fit a long is null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.store import in_arrow, landed

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Integers up to here are exact in doubles too.
LARGEST = 1 << 52
#: Eigenvalues below this share of the trace are taken for zero.
FLAT = 1e-12


def integers(vector: str) -> Column:
    """The vector as integers; null where it is null or has an entry that is no finite number."""
    values = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = float(LARGEST)
    whole = F.transform(values, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(bound)), F.lit(-bound))) + SHIFT)
    return F.when(sound, whole)


# ---- the spectrum of one symmetric matrix, on the driver ----


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above a shift: positive pivots of LDL', with symmetric pivoting in blocks of one or two."""
    a = matrix - shift * np.eye(len(matrix))
    left, positive = len(a), 0

    def to_end(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while left:
        r = int(np.abs(np.diag(a)[:left]).argmax())
        pivot, others = a[r, r], np.abs(a[r, :left])
        others[r] = 0.0
        if abs(pivot) >= 0.64 * others.max():  # bounds the growth of the entries
            to_end(r, left - 1)
            left -= 1
            if pivot != 0:
                positive += int(pivot > 0)
                side = a[:left, left].copy()
                a[:left, :left] -= np.outer(side / pivot, side)
        else:  # the block of the largest entry has a negative determinant, so one eigenvalue of each sign
            off = np.abs(a[:left, :left])
            np.fill_diagonal(off, 0.0)
            p, q = sorted(divmod(int(off.argmax()), left))
            to_end(q, left - 1)
            to_end(p, left - 2)
            left, positive = left - 2, positive + 1
            side = a[:left, left:left + 2].copy()
            a[:left, :left] -= side @ np.linalg.solve(a[left:left + 2, left:left + 2], side.T)
    return positive


class Spectrum:
    """Leading eigenvalues and eigenvectors of a symmetric matrix without negative eigenvalues."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.norm = float(np.abs(matrix).sum(1).max(initial=0.0))
        self.counts = {-self.norm: len(matrix), 2 * self.norm: 0}
        self.values: list[float] = []
        self.vectors: list[np.ndarray] = []

    def count(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.matrix, shift)
        return self.counts[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """The closest counted shifts with the k-th largest eigenvalue between them."""
        return max(s for s, n in self.counts.items() if n >= k), min(s for s, n in self.counts.items() if n < k)

    def without_found(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for v in self.vectors:
                x = x - (v @ x) * v
        return x / np.linalg.norm(x)

    def step(self, shift: float, x: np.ndarray) -> np.ndarray:
        shifted = self.matrix - shift * np.eye(len(x))
        try:
            y = np.linalg.solve(shifted, x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(shifted + np.eye(len(x)) * self.norm * 1e-16, x)
        return self.without_found(y / np.abs(y).max())

    def find(self, k: int) -> None:
        """Append the k-th largest eigenvalue and its vector."""
        narrow = 1e-13 * self.norm
        while True:
            low, high = self.bracket(k)
            alone = self.counts[low] == k and self.counts[high] == k - 1
            if not alone and high - low > narrow:
                self.count((low + high) / 2)
                continue
            x = self.without_found(np.random.default_rng(k).standard_normal(len(self.matrix)))
            value = (low + high) / 2
            for _ in range(3):
                x = self.step(value, x)
            value = float(x @ self.matrix @ x)
            for _ in range(8 if alone else 0):
                if not low <= value <= high or np.linalg.norm(self.matrix @ x - value * x) <= 1e-15 * self.norm:
                    break
                x = self.step(value, x)
                value = float(x @ self.matrix @ x)
            if high - low <= narrow or (low <= value <= high and self.certified(k, value)):
                self.values.append(value)
                self.vectors.append(x)
                return
            self.count((low + high) / 2)

    def certified(self, k: int, value: float) -> bool:
        """Whether the k-th largest eigenvalue, by count, lies within a hair of the value."""
        hair = 1e-12 * self.norm
        return self.count(value - hair) >= k > self.count(value + hair)


def leading(matrix: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and a column of the unit eigenvector of each; those that are nearly zero are left out."""
    trace = float(np.trace(matrix))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    spectrum = Spectrum(matrix / trace)
    for k in range(1, min(components, spectrum.count(FLAT)) + 1):
        spectrum.find(k)
    vectors = np.array([v * np.sign(v[np.abs(v).argmax()]) for v in spectrum.vectors]).reshape(-1, len(matrix)).T
    return np.array(spectrum.values) * trace, vectors


# ---- sums over all vectors ----


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact; of Python integers where 64 bits would not do."""
    biggest = max(int(np.abs(x).max(initial=0)) * n, *(abs(s) for s in sums))
    if biggest < 1 << 61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(y: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exact; null beyond 64 bits."""
    if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 62:
        return pa.array((y * y).sum(1))
    return pa.array([s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in y)], pa.int64())


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _vectors(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        yield _matrix(batch.column("x"), dims)


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dims + 1)
        for x in _vectors(batches, dims):
            small = float(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            total = [a + int(b) for a, b in zip(total, [*(x if small else x.astype(object)).sum(0), len(x)])]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(total, pa.decimal128(38))], names=["i", "s"])

    parts = in_arrow(fit, add, "i int, s decimal(38,0)")
    found = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return found.get(dims, 0), [found.get(i, 0) for i in range(dims)]


def summed_products(fit: DataFrame, dims: int, rows, width: int) -> np.ndarray:
    """Sum over all vectors of the outer product of ``rows(x)`` (a row of ``width`` numbers for each vector) with itself."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for x in _vectors(batches, dims):
            y = rows(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = in_arrow(fit, add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


@dataclass(frozen=True)
class Whitening:
    """What was fitted: vectors in the fit list, their sums, eigenvalues, a column for each component, trace, and how far the
    covariance of the whitened fit list is from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors in ``x``, all of the same length; None if there are none."""
    first = vectors.first()
    if first is None:
        return None
    dims = len(first["x"])
    n, sums = exact_sums(vectors, dims)
    covariance = summed_products(vectors, dims, lambda x: centred(x, n, sums).astype(np.float64) / n, dims) / n
    values, columns = leading(covariance, components)
    found = Whitening(n, sums, values, columns, float(np.trace(covariance)))
    if not len(values):
        return found
    # The whitened vectors' own covariance; their mean is that of the exactly centred vectors, which is zero.
    own = summed_products(vectors, dims, lambda x: found.project(centred(x, n, sums)), len(values)) / n
    return Whitening(n, sums, values, columns, found.trace, float(np.abs(own - np.eye(len(values))).max()))


def whiten(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(id, deviation, whitened array) of each vector, and what was fitted."""
    rows = table.select(F.col(id_column).alias("id"), integers(vector).alias("x")).where("x IS NOT NULL AND size(x) > 0")
    distinct = landed(rows.select("x").distinct(), "vectors")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("best"))
    best = lengths.first()["best"]
    kind = table.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, deviation long, whitened array<double>"
    if best is None:
        return table.sparkSession.createDataFrame([], schema), None
    dims = int(best["d"])
    fitted = fit(distinct.where(F.size("x") == dims), components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = centred(_matrix(batch.column("x"), dims), fitted.n, fitted.sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), deviations(y), pa.array(list(fitted.project(y)), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    return in_arrow(rows.where(F.size("x") == dims), project, schema), fitted


def components_of(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector and component, with what was fitted."""
    rows, fitted = whiten(table, id_column, vector)
    n, error = (fitted.n, fitted.identity_error) if fitted else (0, 0.0)
    shares = [float(e / fitted.trace) for e in fitted.values] if fitted else []
    rows = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col("id").alias(id_column), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(F.lit(shares or [0.0]), F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
