"""Embedding whitening by incremental eigendecomposition.

1. *Partitions.* Each partition keeps the eigendecomposition of its scatter matrix and its running mean.
   A vector ``x`` adds the rank-one term ``(n - 1) / n (x - mean)(x - mean)'``; the new eigenvalues
   are the roots of the secular equation ``1 + rho sum z_i^2 / (d_i - t) = 0``, after deflation of
   negligible ``z_i`` and of (nearly) equal ``d_i``. Roots are held as offsets from their nearest pole and ``z``
   is recomputed from them, so the eigenvectors stay orthogonal.
2. *Merging.* Two spectra merge by one rank-one update for the difference of their means and one for each
   eigenpair of the second. Partitions merge in groups, level by level (``_LEVELS``), never all in one task.
3. *Refinement.* One distributed Rayleigh-Ritz pass: every partition projects its exactly centred vectors
   onto the merged basis and sums the products; the small eigenproblem of the sum (as wide as a
   vector, whatever the number of rows) turns the basis into the eigenvectors of the covariance.
4. *Whitening.* Rows are projected and scaled; one more pass measures the covariance of the result.

What goes through the driver or to all tasks is one basis: dimension x dimension numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.llm.common import ship

_EPS = np.finfo(float).eps
_LEVELS = (4096, 64, 1)  # groups left after each level of a merge


# --------------------------------------------------------------------------- rank-one updates


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho sum z2 / (d - t) = 0`` for ascending distinct ``d``, positive ``z2`` and ``rho``:
    the number of each root's nearest pole and its offset from there. Root i lies between d[i] and d[i + 1]."""
    k = len(d)
    top = np.append(d[1:], d[-1] + rho * z2.sum())
    at = np.arange(k)
    middle = d + (top - d) / 2
    value = 1 + rho * (z2 / (d - middle[:, None])).sum(1)
    pole = np.where((value > 0) | (at == k - 1), at, at + 1)
    delta = d - d[pole][:, None]
    low, high = d - d[pole], top - d[pole]
    a, b = low.copy(), high.copy()  # the poles on both sides; the last root has none above
    half = middle - d[pole]
    low, high = np.where(value > 0, low, half), np.where(value > 0, half, high)
    t = (low + high) / 2
    below = (at[:, None] >= at).astype(float)
    weight = rho * z2
    for _ in range(60):
        gap = delta - t[:, None]
        term = weight / gap
        slope = term / gap
        psi, dpsi = np.einsum("ij,ij->i", term, below), np.einsum("ij,ij->i", slope, below)
        phi, dphi = term.sum(1) - psi, slope.sum(1) - dpsi  # terms below are negative, above positive
        f = 1 + psi + phi
        open_ = np.abs(f) > 64 * _EPS * (1 + phi - psi)
        if not open_.any():
            break
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        x, y = a - t, b - t
        with np.errstate(all="ignore"):
            # both sums as a constant and one pole, right in value and slope at t
            c = 1 + psi - dpsi * x + phi - dphi * y
            s = c * (x + y) + dpsi * x * x + dphi * y * y
            e = f * x * y
            root = np.sqrt(s * s - 4 * c * e)
            step = np.where(s <= 0, (s - root) / (2 * c), 2 * e / (s + root))
            last = x[-1] + dpsi[-1] * x[-1] ** 2 / (1 + psi[-1] - dpsi[-1] * x[-1])
        step[-1] = last
        new = t + step
        good = (new > low) & (new < high)
        new = np.where(good, new, (low + high) / 2)
        if (new == t)[open_].all():
            break
        t = np.where(open_, new, t)
    return pole, t


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors diag(values) vectors' + rho v v'`` (rho >= 0)."""
    z = vectors.T @ v
    norm = float(z @ z)
    rho = rho * norm
    if not rho > 0:
        return values, vectors
    z = z / np.sqrt(norm)
    d, u = values.copy(), vectors
    tol = 8 * _EPS * max(abs(d[-1]), abs(d[0]), rho)
    keep = rho * np.abs(z) > tol
    kept = np.flatnonzero(keep)
    if not len(kept):
        return values, vectors
    close = np.diff(d[kept]) * np.abs(z[kept[1:]] * z[kept[:-1]]) <= tol * (z[kept[1:]] ** 2 + z[kept[:-1]] ** 2)
    if close.any():  # a rotation gives the weight of one of two (nearly) equal values to the other
        u = u.copy()
        i = kept[0]
        for j in kept[1:]:
            tau = np.hypot(z[i], z[j])
            c, s = z[j] / tau, -z[i] / tau
            if abs((d[j] - d[i]) * c * s) <= tol:
                z[i], z[j] = 0.0, tau
                u[:, i], u[:, j] = c * u[:, i] + s * u[:, j], c * u[:, j] - s * u[:, i]
                d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                keep[i] = False
            i = j
        kept = np.flatnonzero(keep)
    order = kept[np.argsort(d[kept], kind="stable")]
    p, w = d[order], z[order]
    pole, t = secular_roots(p, w * w, rho)
    gap = p - p[pole][:, None] - t[:, None]  # [root, pole]
    # the weights whose exact roots these are
    k = len(p)
    apart = np.abs(p[:, None] - p)
    below = np.ones((k, k))
    below[:-1] = apart[1:]
    share = np.abs(gap) / np.where(np.arange(k)[:, None] < np.arange(k), apart, below)
    weight = np.sqrt(share.prod(0) / rho) * np.where(w < 0, -1.0, 1.0)
    own = weight / gap
    own /= np.sqrt((own * own).sum(1))[:, None]
    d[order] = p[pole] + t
    if len(order) == len(d):
        return d[order], u[:, order] @ own.T
    u = u.copy() if u is vectors else u
    u[:, order] = u[:, order] @ own.T
    up = np.argsort(d, kind="stable")
    return d[up], u[:, up]


@dataclass
class Spectrum:
    """Count, mean and eigenpairs of the scatter matrix of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.n += 1
        self.mean = self.mean + off / self.n
        self.values, self.vectors = rank_one(self.values, self.vectors, (self.n - 1) / self.n, off)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        n = self.n + other.n
        off = other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / n, off)
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, value, vector)
        self.n, self.mean = n, self.mean + off * (other.n / n)


# --------------------------------------------------------------------------- distributed


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column, all of ``size`` entries (long or double as the column is)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if len(batch):
            yield batch, _matrix(batch.column(1), size)


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums by column: Python integers for integers, else floats."""
    if x.dtype.kind != "i":
        return x.sum(0)
    if not len(x) or int(np.abs(x).max()) * len(x) < 1 << 62:
        return np.array([int(v) for v in x.sum(0)], object)
    return x.astype(object).sum(0)


_PARTIAL = "part long, n long, sums array<string>, cells array<double>"


def _partial(part: int, n: int, sums, cells: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string())), pa.array([cells.tolist()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["part", "n", "sums", "cells"])


def _part() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _number(text: str, exact: bool):
    return int(text) if exact else float(text)


def _merged(parts: DataFrame, combine: Callable[[list[np.ndarray], list[int]], np.ndarray], exact: bool) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(n, sums, cells) of all partial rows, combined in groups, level by level; None without rows."""

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["n"]))
        counts = [r["n"] for r in rows]
        cells = combine([np.array(r["cells"]) for r in rows], counts)
        sums = np.array([[_number(s, exact) for s in r["sums"]] for r in rows], object if exact else float).sum(0) if rows[0]["sums"] else []
        return pa.Table.from_batches([_partial(rows[0]["group"], sum(counts), sums, cells)])

    for groups in _LEVELS:
        parts = parts.withColumn("group", F.pmod("part", F.lit(groups))).groupBy("group").applyInArrow(merge, _PARTIAL)
    row = parts.first()
    return None if row is None else (row.n, np.array([_number(s, exact) for s in row.sums], object if exact else float), np.array(row.cells))


def _pack(s: Spectrum) -> np.ndarray:
    return np.concatenate([s.mean, s.values, s.vectors.ravel()])


def _unpack(n: int, cells: np.ndarray, size: int) -> Spectrum:
    return Spectrum(n, cells[:size], cells[size : 2 * size], cells[2 * size :].reshape(size, size))


def _spectra(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = Spectrum.empty(size), 0
        for _, x in _chunks(batches, size):
            sums = sums + _exact_sums(x)
            for row in x.astype(np.float64):
                held.add(row)
        if held.n:
            yield _partial(_part(), held.n, sums, _pack(held))

    return scan


def _combined_spectra(size: int) -> Callable[[list[np.ndarray], list[int]], np.ndarray]:
    def combine(cells: list[np.ndarray], counts: list[int]) -> np.ndarray:
        held = Spectrum.empty(size)
        for n, c in zip(counts, cells, strict=True):
            held.merge(_unpack(n, c, size))
        return _pack(held)

    return combine


def _sum(cells: list[np.ndarray], counts: list[int]) -> np.ndarray:
    return np.sum(cells, axis=0)


@dataclass
class Whitening:
    """A fitted whitening: the count, exact sums by dimension, eigenpairs of the covariance (falling) and its trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.vectors)

    @property
    def kept(self) -> np.ndarray:
        """Components whose eigenvalue is not zero to double precision."""
        return self.values > max(self.size, 1) * _EPS * self.values.max(initial=0)

    def off(self, x: np.ndarray) -> np.ndarray:
        """n x - sums; integers stay exact."""
        if x.dtype.kind != "i":
            return self.n * x - self.sums
        most = max(int(np.abs(x).max(initial=0)) * self.n, max((abs(s) for s in self.sums), default=0))
        if most < 1 << 61:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.off(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.centred(x) @ self.vectors[:, :components] / np.sqrt(self.values[:components])
        return np.where(self.kept[:components], out, np.nan)

    def deviation(self, x: np.ndarray) -> list:
        """Squared length of n x - sums: exact (null beyond a long) for integers."""
        off = self.off(x)
        if off.dtype.kind == "f":
            return (off * off).sum(1).tolist()
        if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * self.size < 1 << 63:
            return (off * off).sum(1).tolist()
        wide = off.astype(object)
        return [s if s < 1 << 63 else None for s in (wide * wide).sum(1).tolist()]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, bool]:
    """(id, vector) of the rows that can be used, the vectors' length, and whether they are integers.

    Vectors that are null or hold null or non-finite entries go. So do those of another length than
    most have (of equally frequent lengths the longer one counts)."""
    kind = vectors.schema[vec_col].dataType.elementType
    exact = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<long>" if exact else "array<double>").alias("vector"))
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & (F.lit(True) if exact else ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    top = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = top["size"] if top else 0
    return rows.where(F.size("vector") == size), size, exact


def fit_whitening(rows: DataFrame, size: int, exact: bool) -> Whitening | None:
    """The whitening of ``usable`` rows; None if there are none."""
    vectors = rows.select("id", "vector")
    found = _merged(vectors.mapInArrow(_spectra(size), _PARTIAL), _combined_spectra(size), exact) if size else None
    if found is None:
        return None
    n, sums, cells = found
    basis = np.linalg.qr(_unpack(n, cells, size).vectors)[0]
    model = Whitening(n, sums, np.zeros(size), basis, 0.0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size)), 0
        for batch, x in _chunks(batches, size):
            y = model.centred(x) @ basis
            total += y.T @ y
            seen += len(batch)
        if seen:
            yield _partial(_part(), seen, [], total.ravel())

    _, _, cells = _merged(vectors.mapInArrow(products, _PARTIAL), _sum, exact)
    projected = cells.reshape(size, size) / n
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    found_vectors = basis @ turn[:, ::-1]
    sign = np.sign(found_vectors[np.abs(found_vectors).argmax(0), np.arange(size)])  # the largest entry is positive
    return Whitening(n, sums, np.maximum(values[::-1], 0.0), found_vectors * np.where(sign < 0, -1.0, 1.0), float(np.trace(projected)))


def identity_error(rows: DataFrame, model: Whitening, components: int, exact: bool) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over components that have a variance."""
    size, k = model.size, int(model.kept[:components].sum())

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros(k + k * k), 0
        for batch, x in _chunks(batches, size):
            w = model.whitened(x, k)
            mean = w.mean(0)
            off = w - mean
            held = together([held, np.concatenate([mean, (off.T @ off).ravel()])], [seen, len(batch)])
            seen += len(batch)
        if seen:
            yield _partial(_part(), seen, [], held)

    def together(cells: list[np.ndarray], counts: list[int]) -> np.ndarray:
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for c, m in zip(cells, counts, strict=True):
            if m:
                off = c[:k] - mean
                scatter = scatter + c[k:].reshape(k, k) + np.outer(off, off) * (n * m / (n + m))
                n, mean = n + m, mean + off * (m / (n + m))
        return np.concatenate([mean, scatter.ravel()])

    if not k:
        return 0.0
    n, _, cells = _merged(rows.select("id", "vector").mapInArrow(moments, _PARTIAL), together, exact)
    return float(np.abs(cells[k:].reshape(k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per usable vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    ``usable`` says which rows are used. Components are numbered from 1 by falling eigenvalue of the
    covariance (divisor n); there are as many as a vector has dimensions if those are fewer. ``deviation`` is the squared
    length of ``n x - sums`` (exact for integer vectors, null beyond a long), ``explained`` the
    eigenvalue's share of the trace (null if nothing varies), ``identity_error`` the measured error of the whitened rows. A component
    without variance (one vector, equal vectors, fewer vectors than components) has null ``whitened``
    and counts for no error. Ids may be null or repeated and vectors equal; other columns are not
    read; without usable rows the result is empty."""
    spark = vectors.sparkSession
    ship(spark)
    rows, size, exact = usable(vectors, id_col, vec_col)
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType() if exact else T.DoubleType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    model = fit_whitening(rows, size, exact)
    if model is None:
        return spark.createDataFrame([], schema)
    k = min(components, size)
    error = identity_error(rows, model, k, exact)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = pa.array(np.tile(model.values[:k] / model.trace, 1) if model.trace > 0 else [None] * k, pa.float64())
        for batch, x in _chunks(batches, size):
            m = len(batch)
            each = pa.array(np.repeat(np.arange(m), k))
            w = model.whitened(x, k).ravel()
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                pa.array(model.deviation(x), pa.int64() if exact else pa.float64()).take(each),
                pa.array(w, mask=np.isnan(w)),
                share.take(pa.array(np.tile(np.arange(k), m))),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(apply, schema)
