"""Embedding whitening by incremental eigendecomposition.

Every partition holds the spectrum of the scatter matrix of its vectors (count,
mean, eigenvalues, eigenvectors) and takes each vector in as a centred rank-one
update: the eigenvalues after ``D + rho z z'`` are the roots of the secular
equation, one between every two old ones, and the eigenvectors follow from the
roots (with ``z`` computed anew from them, so that they stay orthogonal).
Entries of ``z`` that are zero, and all but one of those that meet equal
eigenvalues, are deflated first. Two spectra are combined in the same way: one
rank-one update for each eigenpair of the second and one for the distance of the
means. The spectra of the partitions meet in a tree of Spark groups of ``FAN_IN``.

The result is the basis of a last, distributed Rayleigh-Ritz step: every
partition projects its centred vectors on the basis and sums their products; the
small matrix of these sums gives the eigenvalues and turns the basis into the
components, exact to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed by the contract: a vector's entry c becomes the integer floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this bound (either sign) count as the bound, so that integers and doubles stay exact.
LARGEST = float(1 << 44)
#: Spectra that meet in one group.
FAN_IN = 16
#: Components of a result, unless told otherwise.
COMPONENTS = 32
#: Halvings of an interval between two eigenvalues.
HALVINGS = 46
_EPS = np.finfo(np.float64).eps


def _reflect(q: np.ndarray, z: np.ndarray, at: np.ndarray) -> None:
    """Turn the columns ``at`` of ``q``, which share an eigenvalue, so that only the last of them meets ``z``."""
    v = z[at].copy()
    norm = np.linalg.norm(v)
    if norm == 0 or len(at) < 2:
        return
    sign = 1.0 if v[-1] >= 0 else -1.0
    v[-1] += sign * norm
    v /= np.linalg.norm(v)
    q[:, at] -= 2.0 * np.outer(q[:, at] @ v, v)
    z[at] = 0.0
    z[at[-1]] = -sign * norm


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) = 0 for rising ``d`` and positive ``z2``: (index of the nearer
    pole, distance from it) for each, found by halving."""
    k = len(d)
    right = np.append(d[1:], d[-1] + z2.sum())
    gap = right - d
    middle = d + gap / 2
    f = 1.0 + (z2 / (d - middle[:, None])).sum(1)
    near = np.arange(k)
    left = f >= 0
    left[-1] = True
    near[~left] += 1
    lo = np.where(left, 0.0, -gap / 2)
    hi = np.where(left, gap / 2, 0.0)
    hi[-1] = gap[-1]
    delta = d - d[near][:, None]
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        up = 1.0 + (z2 / (delta - mid[:, None])).sum(1) < 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return near, (lo + hi) / 2


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising eigenvalues, eigenvectors in columns) of ``q diag(d) q' + rho v v'``, rho >= 0."""
    z = (v @ q) * np.sqrt(max(rho, 0.0))
    q = q.copy()
    tol = 8 * _EPS * max(float(np.abs(d).max(initial=0.0)), float(z @ z))
    if tol == 0.0:
        return d, q
    first = np.flatnonzero(np.concatenate([[True], np.diff(d) > tol]))
    for lo, hi in zip(first, np.append(first[1:], len(d)), strict=True):
        if hi - lo > 1:
            _reflect(q, z, np.arange(lo, hi))
    live = np.flatnonzero(z * z > tol)
    if not len(live):
        return d, q
    p, z2 = d[live], z[live] ** 2
    near, tau = _roots(p, z2)
    # differences root_j - p_i, each exact to the last bits
    diff = (p[near] - p[:, None]) + tau
    apart = p - p[:, None]
    np.fill_diagonal(apart, 1.0)
    # the z for which these roots are exact: prod_j (root_j - p_i) / prod_{j != i} (p_j - p_i), root by root
    zhat = np.sqrt(np.abs(np.prod(diff / apart, axis=1))) * np.where(z[live] < 0, -1.0, 1.0)
    u = zhat[:, None] / -diff
    u /= np.sqrt((u * u).sum(0))
    out = d.copy()
    out[live] = p[near] + tau
    q[:, live] = q[:, live] @ u
    order = np.argsort(out, kind="stable")
    return out[order], q[:, order]


class Spectrum:
    """Count, mean and scatter matrix (as eigenvalues and eigenvectors) of the vectors seen."""

    def __init__(self, dim: int, n: int = 0, mean: np.ndarray | None = None, d: np.ndarray | None = None, q: np.ndarray | None = None):
        self.n, self.mean = n, np.zeros(dim) if mean is None else mean
        self.d, self.q = (np.zeros(dim), np.eye(dim)) if d is None else (d, q)

    def add(self, x: np.ndarray) -> None:
        v = x - self.mean
        self.n += 1
        self.mean = self.mean + v / self.n
        if self.n > 1:
            self._update(v, (self.n - 1) / self.n)
        if self.n % 256 == 0:
            self.q = np.linalg.qr(self.q)[0]

    def combine(self, other: "Spectrum") -> None:
        if not other.n:
            return
        n = self.n + other.n
        v = other.mean - self.mean
        for k in range(len(other.d)):
            if other.d[k] > 0:
                self._update(other.q[:, k], other.d[k])
        if self.n:
            self._update(v, self.n * other.n / n)
        self.mean = self.mean + v * (other.n / n)
        self.n = n
        self.q = np.linalg.qr(self.q)[0]

    def _update(self, v: np.ndarray, rho: float) -> None:
        size = float(np.abs(v).max(initial=0.0))
        if size > 0:
            self.d, self.q = rank_one(self.d, self.q, v / size, rho * size * size)


_SPECTRUM = "part long, n long, mean array<double>, d array<double>, q array<double>"


def _told(part: int, s: Spectrum) -> pa.RecordBatch:
    lists = [pa.array([a.ravel().tolist()], pa.list_(pa.float64())) for a in (s.mean, s.d, s.q)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), *lists],
                                      names=["part", "n", "mean", "d", "q"])


def _read(table, i: int) -> Spectrum:
    mean, d, q = (np.asarray(table.column(c)[i].as_py()) for c in ("mean", "d", "q"))
    return Spectrum(len(mean), table.column("n")[i].as_py(), mean, d, q.reshape(len(mean), len(mean)))


def _matrix(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def integers(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``key``, ``x``): the rows whose vector is whole and finite, as integers."""
    bound = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double")))
    whole = vectors.select(F.col(key), F.col(vector).alias("v")).where(F.col("v").isNotNull()).where(
        ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return whole.select(F.col(key), F.transform("v", lambda c: F.floor(bound(c) * SCALE) + F.lit(OFFSET).cast("long")).alias("x"))


def spectrum(xs: DataFrame, dim: int) -> Spectrum:
    """The spectrum of all vectors of ``xs`` (column ``x``, ``dim`` entries each)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, part = Spectrum(dim), 0
        for b in batches:
            part = b.column(0)[0].as_py() if b.num_rows else part
            for x in _matrix(b, "x", dim).astype(np.float64) - OFFSET:
                s.add(x)
        if s.n:
            yield _told(part, s)

    def joined(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("part").to_numpy())
        own = [_read(group, int(i)) for i in order]
        total = Spectrum(dim)
        for s in own:
            total.combine(s)
        return pa.Table.from_batches([_told(group.column("part")[int(order[0])].as_py() // FAN_IN, total)])

    level = stored(xs.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(local, _SPECTRUM), "spectra")
    left = level.count()
    while left > 1:  # a tree: FAN_IN spectra become one
        level = stored(level.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInArrow(joined, _SPECTRUM), "spectra")
        left = level.count()
    row = pa.Table.from_pylist([r.asDict() for r in level.collect()])  # one row: dim * dim numbers
    return _read(row, 0) if row.num_rows else Spectrum(dim)


def _sums(xs: DataFrame, dim: int, project, width: int) -> np.ndarray:
    """Sum of y'y over all rows, y = ``project(x)``: each partition sends one matrix, the driver gets their sum."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                y = project(_matrix(b, "x", dim))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    rows = (xs.select("x").mapInArrow(local, "m array<double>").select(F.posexplode("m").alias("at", "v"))
            .groupBy("at").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(width * width)
    for r in rows:
        out[r["at"]] = r["v"]
    return out.reshape(width, width)


class Whitening:
    """``n``, exact sums ``total``, components (columns, falling eigenvalue), eigenvalues, trace of the covariance."""

    def __init__(self, n: int, total: list[int], components: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.total, self.components, self.values, self.trace = n, total, components, values, trace

    def scale(self, keep: int) -> np.ndarray:
        """Columns that whiten; a component without variance (rounding apart) whitens to 0."""
        e = self.values[:keep]
        real = e > 1e-13 * max(self.values.max(initial=0.0), 0.0)
        return self.components[:, :keep] * np.where(real, 1.0 / np.sqrt(np.where(real, e, 1.0)), 0.0)


def fit(xs: DataFrame, dim: int, n: int, total: list[int]) -> Whitening:
    """Components of the vectors ``x``: incremental spectra, then one Rayleigh-Ritz step."""
    basis = np.linalg.qr(spectrum(xs, dim).q)[0]
    near, rest = _centre(n, total)
    # centred before multiplying: integers minus the integer nearest to the mean are exact, the rest is below one
    h = _sums(xs, dim, lambda x: ((x - near) - rest) @ basis, dim) / n
    values, turn = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-values, kind="stable")
    q = basis @ turn[:, order]
    q *= np.where(q[np.abs(q).argmax(0), np.arange(dim)] < 0, -1.0, 1.0)
    return Whitening(n, total, q, np.maximum(values[order], 0.0), float(np.trace(h)))


def _centre(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    near = [(2 * s + n) // (2 * n) for s in total]
    return np.array(near, dtype=np.int64), np.array([(s - n * m) / n for s, m in zip(total, near, strict=True)])


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every whole, finite vector on the leading components.

    Returns one row for each remaining row and component: ``key``, ``component`` (from 1), ``n`` (fitted
    vectors), ``deviation`` (decimal: sum over dimensions of (n x - S)^2, exact), ``whitened``,
    ``explained`` (share of the trace), ``identity_error``. Rows whose vector is null, or holds a null or
    non-finite entry, are dropped; so are vectors of another length than the commonest (of equally common
    ones the longest). Entries beyond 2^44 count as 2^44. Null and repeated keys are rows like any other;
    vectors without entries give no component and no row; a component without variance whitens to 0 and is
    left out of ``identity_error``; an empty table gives an empty result. Other columns are not looked at.

    Plan: four narrow scans of the integers (spectra, Rayleigh-Ritz, identity check, result). A partition
    sends dim * dim numbers; nothing is shuffled but these.
    """
    kind = vectors.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    every = stored(integers(vectors, key=key, vector=vector), "integers")
    lengths = every.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if lengths is None or lengths["d"] == 0:
        return spark.createDataFrame([], out)
    dim, n = lengths["d"], lengths["count"]
    xs = every.where(F.size("x") == dim)
    sums = xs.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    total = [int(r["s"]) for r in sorted(sums, key=lambda r: r["at"])]
    model = fit(xs, dim, n, total)
    keep = min(components, dim)
    near, rest = _centre(n, total)
    w = model.scale(keep)
    share = (model.values[:keep] / model.trace if model.trace > 0 else np.zeros(keep)).tolist()
    gram = _sums(xs, dim, lambda x: ((x - near) - rest) @ w, keep) / n
    real = np.flatnonzero(np.abs(w).sum(0) > 0)
    error = float(np.abs(gram - np.eye(keep))[np.ix_(real, real)].max(initial=0.0))

    off = [s - n * int(m) for s, m in zip(total, near, strict=True)]  # n x - S = n (x - near) - off, both small

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, "x", dim) - near
            y = (x - rest) @ w
            if (int(np.abs(x).max()) + 1) * n < 1 << 28 and dim <= 64:  # fits in 64 bits
                dev = pa.array(((x * n - np.array(off, dtype=np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                dev = pa.array([Decimal(sum((n * int(a) - o) ** 2 for a, o in zip(r, off, strict=True))) for r in x], pa.decimal128(38, 0))
            k = b.num_rows
            each = pa.array(np.repeat(np.arange(k), keep))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(np.tile(np.arange(1, keep + 1), k), pa.int32()),
                 pa.array(np.full(k * keep, n), pa.int64()), dev.take(each),
                 pa.array(y.ravel()), pa.array(np.tile(share, k)), pa.array(np.full(k * keep, error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return xs.select(key, "x").mapInArrow(run, out)
