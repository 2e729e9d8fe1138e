"""Embedding whitening: a distributed exact covariance, float32 eigenvectors, refined in higher precision.

Entries become integers, so the covariance is exact: tasks add integer products of vectors centred on the rounded mean,
Spark adds the tasks' sums, and the remainder of the mean is taken off as a fraction. The driver gets ``dims`` squared
numbers, whatever the rows.

The eigenvectors are first taken in float32 and then corrected by Ogita and Aishima's iteration: from ``R = I - X'X`` and
``S = X'AX``, formed in extended precision, each step adds ``X E`` and squares the error. Eigenvalues closer than the
present error bound form a cluster. Inside one the iteration only restores orthogonality; its vectors are turned by the
eigenvectors of the small matrix ``X_J' A X_J`` less its mean eigenvalue, which keeps the digits that the full matrix
hides (a sub-solve), and as the bound falls, clusters come apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.vectors import finite_vectors

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Steps of the refinement: the error squares each time, so float32 needs four; clusters inside clusters take more.
STEPS = 30
#: Vectors handled at once inside a task.
ROWS = 4096
#: Entries beyond this stand for it, far above where doubles have a fraction left.
LIMIT = 1 << 53
WIDE = np.longdouble


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` of integers as Python integers: by floats or 64 bits where nothing can be rounded or overflow."""
    most = len(a) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return (a.T.astype(float) @ b.astype(float)).astype(np.int64).astype(object)
    if most < 1 << 63:
        return (a.T @ b).astype(object)
    return a.T.astype(object) @ b.astype(object)


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors' entries as integers; a vector with fewer entries is filled up with zeros."""
    size = column.value_lengths().to_numpy()
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    out = np.full((len(column), dims), SHIFT, np.int64)
    lead = np.concatenate([[0], np.cumsum(size)])[:-1]
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - lead[row]] += np.clip(flat, -LIMIT, LIMIT).astype(np.int64)
    return out


def _added(df: DataFrame, vec: str, part: Callable[[pa.Array], np.ndarray], kind: str = "decimal(38,0)") -> dict[tuple[int, int], int | float]:
    """Sum over all rows of the matrices that ``part`` gives for batches of vectors: one matrix a task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                got = part(batch.column(0).slice(a, ROWS))
                total = got if total is None else total + got
        if total is not None:
            i, j = (x.reshape(-1) for x in np.indices(total.shape))
            values = pa.array([repr(v) for v in total.reshape(-1).tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), values], ["i", "j", "v"])

    sums = df.select(vec).mapInArrow(run, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v"))
    return {(r.i, r.j): r.v for r in sums.collect()}  # as many as the matrix has entries


def _square(entries: dict, rows: int, cols: int, kind: type) -> np.ndarray:
    out = np.zeros((rows, cols), kind)
    for (i, j), v in entries.items():
        out[i, j] = int(v) if kind is object else v
    return out


def _ratio(top: np.ndarray, below: int) -> np.ndarray:
    """Exact fractions, rounded to extended precision."""
    bits = 80 + below.bit_length()
    return np.array([WIDE((int(t) << bits) // below) / WIDE(2) ** bits for t in top.reshape(-1)], WIDE).reshape(top.shape)


def clusters(values: np.ndarray, gap: WIDE) -> list[np.ndarray]:
    """Index sets of eigenvalues that hang together by gaps of at most ``gap``."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision."""
    n = len(a)
    scale = np.abs(a).max(initial=0)
    if not n or not scale:
        return np.zeros(n, WIDE), np.eye(n, dtype=WIDE)
    a = a.astype(WIDE) / scale
    norm = np.sqrt((a * a).sum())
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    tiny = 8 * n * np.finfo(WIDE).eps
    for _ in range(STEPS):
        r, s = np.eye(n, dtype=WIDE) - x.T @ x, x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding, over a small gap, spoils the angles
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        gap = max(2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())), tiny * norm)
        apart = np.abs(values[None, :] - values[:, None])
        far = apart > gap
        step = np.where(far, (s + values * r) / np.where(far, values[None, :] - values[:, None], 1), r / 2)
        x = x + x @ step
        turned = False
        for group in clusters(values, gap):
            part = x[:, group]
            small = part.T @ a @ part
            small = (small + small.T) / 2 - np.eye(len(group), dtype=WIDE) * np.trace(small) / len(group)
            rest = np.abs(small - np.diag(np.diag(small))).max()
            if rest > tiny * norm:  # else the eigenvalues agree in all digits and any basis will do
                x[:, group] = part @ np.linalg.eigh((small / np.abs(small).max()).astype(float))[1].astype(WIDE)
                turned = True
        if not turned and np.abs(step).max() <= tiny:
            break
    for _ in range(2):  # what rounding over small gaps has left of the angles
        x = x + x @ (np.eye(n, dtype=WIDE) - x.T @ x) / 2
    values = np.einsum("ij,ik,kj->j", x, a, x) / (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    return values[order] * scale, x * np.where(x[np.abs(x).argmax(0), np.arange(n)] < 0, -1, 1)


@dataclass
class Whitening:
    """What ``fit_whitening`` learns: counts, integer sums, the rounded mean, components as columns, their eigenvalues."""

    n: int
    dims: int
    sums: list[int]
    middle: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections of integer vectors over the root of the eigenvalue; not a number where that is zero."""
        rest = np.array([float(_ratio(np.array(s - self.n * int(m), object), self.n)) for s, m in zip(self.sums, self.middle)])
        root = np.sqrt(np.where(self.values > self.trace * 1e-15, self.values, np.nan))
        return ((x - self.middle) - rest) @ self.vectors / root

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n x - S) squared."""
        rest = [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]
        y = x - self.middle
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
        if most * most * max(self.dims, 1) < 1 << 63:
            z = self.n * y - np.array(rest, np.int64)
            return pa.array((z * z).sum(1)).cast(pa.decimal128(38, 0))
        z = self.n * y.astype(object) - np.array(rest, object)
        return pa.array([str(v) for v in (z * z).sum(1)]).cast(pa.decimal128(38, 0))


def fit_whitening(df: DataFrame, vec: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fits on every usable row of ``df``; None if there is none. Reads the rows three times: length, mean, covariance."""
    rows = finite_vectors(df, vec)
    dims = rows.agg(F.max(F.size(vec))).first()[0]
    if dims is None:
        return None

    def ones_and_sums(column: pa.Array) -> np.ndarray:
        return exact_product(np.ones((len(column), 1), np.int64), np.concatenate([np.ones((len(column), 1), np.int64), integers(column, dims)], 1))

    first = _square(_added(rows, vec, ones_and_sums), 1, dims + 1, object)[0]
    n, sums = int(first[0]), [int(s) for s in first[1:]]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def squares_of(column: pa.Array) -> np.ndarray:
        y = integers(column, dims) - middle
        return exact_product(y, y)

    squares = _square(_added(rows, vec, squares_of), dims, dims, object)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle)], object)
    cov = _ratio(n * squares - np.outer(rest, rest), n * n)
    values, vectors = refined_eigen(cov)
    k = min(components, dims)
    return Whitening(n, dims, sums, middle, vectors[:, :k].astype(float), values[:k].astype(float), float(np.trace(cov)))


def identity_error(df: DataFrame, model: Whitening, vec: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, over components with a spread."""

    def products(column: pa.Array) -> np.ndarray:
        w = model.whiten(integers(column, model.dims))
        w = np.concatenate([np.ones((len(w), 1)), w], 1)
        return w.T @ w

    k = model.vectors.shape[1] + 1
    got = _square(_added(finite_vectors(df, vec), vec, products, "double"), k, k, float)
    mean = got[0, 1:] / model.n
    off = np.abs(got[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(k - 1))
    return float(np.nanmax(off)) if np.isfinite(off).any() else 0.0


def whiten_embeddings(df: DataFrame, keep: tuple[str, ...] = ("vec_id",), vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``keep`` and ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` for each usable row and component.

    Rows with a null vector or a null or non-finite entry are left out. A shorter vector counts as filled up with zeros; an
    empty one is all zeros. Entries beyond 2^43 stand for it. Ties: equal eigenvalues keep one basis of their space, the
    same for all rows; repeated rows count each time. A component without spread (one row, equal rows, more components than
    rank) has a null ``whitened``, and ``explained`` is null if nothing has a spread. ``deviation`` is decimal(38,0), as it
    grows with the square of the row count. An empty table gives an empty one. Texts and other columns are not read.
    """
    names = [f"_c{i}" for i in range(len(keep))]
    rows = df.select(*[df["`" + c.replace("`", "``") + "`"].alias(n) for n, c in zip(names, keep)], df[vec].cast("array<double>").alias("_vec"))
    fields = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names])
    fields += ", component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit_whitening(rows, "_vec", components)
    error = identity_error(rows, model, "_vec") if model else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.vectors.shape[1]
        share = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                x = integers(part.column(len(names)), model.dims)
                each = pa.array(np.repeat(np.arange(len(part)), k))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i).take(each) for i in range(len(names))], pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                     pa.array(np.full(len(each), model.n)), model.deviations(x).take(each), pa.array(model.whiten(x).reshape(-1), from_pandas=True),
                     pa.array(np.tile(share, len(part)), from_pandas=True), pa.array(np.full(len(each), error))],
                    [*names, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    out = (finite_vectors(rows, "_vec") if model else rows.limit(0)).mapInArrow(run, fields)
    return out.withColumnsRenamed(dict(zip(names, keep)))
