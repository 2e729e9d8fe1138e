"""Similarity of two size channels: cosine, Jaro-Winkler, 1 - Wasserstein, and their softmax fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowloom.functions.arrays import bind, dot


def drop_joint_padding(a: Column, b: Column) -> Column:
    """Positions where the two differ from (0, 0), as an array of structs x, y."""
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.filter(both, lambda s: ~((s["x"] == 0) & (s["y"] == 0)))


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def wasserstein_sim(a: Column, b: Column) -> Column:
    """1 minus the first Wasserstein distance of two equally long value lists."""
    def apart(x: Column, y: Column) -> Column:
        return F.abs(x.cast("double") - y.cast("double"))

    total = F.aggregate(F.zip_with(F.array_sort(a), F.array_sort(b), apart), F.lit(0.0), lambda acc, d: acc + d)
    return 1.0 - total / F.greatest(F.size(a), F.lit(1))


#: Values of a list up to which rows are compared as a matrix.
MATRIX = 64


class _Lists:
    """Value lists as one array, with the start and length of each."""

    def __init__(self, lists: pd.Series):
        self.length = np.fromiter(map(len, lists), np.int64, len(lists))
        self.start = np.cumsum(self.length) - self.length
        self.values = np.concatenate(list(lists), dtype=float, casting="unsafe") if self.length.any() else np.zeros(0)

    def padded(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[some]
        out = np.full((len(some), max(int(length.max(initial=0)), 1)), np.nan)
        at = np.arange(out.shape[1])
        inside = at < length[:, None]
        out[inside] = self.values[(self.start[some][:, None] + at)[inside]]
        return out, length

    def one(self, k: int) -> np.ndarray:
        return self.values[self.start[k] : self.start[k] + self.length[k]]


def _front(values: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Kept values of each row moved to the front, in order."""
    order = np.argsort(~keep, axis=1, kind="stable")
    return np.take_along_axis(np.where(keep, values, np.nan), order, axis=1)


def _winkler(jaro: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Jaro-Winkler: the bonus for up to four equal first values, only above a Jaro score of 0.7."""
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1.0 - jaro), jaro)


def _short_rows(left: _Lists, right: _Lists, some: np.ndarray) -> np.ndarray:
    """Rows of about one length at once."""
    a, la = left.padded(some)
    b, lb = right.padded(some)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used_a, used_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i in range(a.shape[1]):
        for j in range(max(0, i - int(reach.max(initial=0))), min(b.shape[1], i + int(reach.max(initial=0)) + 1)):
            hit = (np.abs(i - j) <= reach) & ~used_a[:, i] & ~used_b[:, j] & (a[:, i] == b[:, j])
            used_a[:, i] |= hit
            used_b[:, j] |= hit
    m = used_a.sum(axis=1)
    width = max(int(m.max(initial=0)), 1)
    fa, fb = _front(a, used_a)[:, :width], _front(b, used_b)[:, :width]
    moved = ((fa != fb) & (np.arange(fa.shape[1]) < m[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3.0, 0.0)
    jaro = np.where((la == 0) & (lb == 0), 1.0, jaro)
    same = min(a.shape[1], b.shape[1])
    return _winkler(jaro, np.cumprod((a[:, :same] == b[:, :same])[:, :4], axis=1).sum(axis=1))


def _long_row(a: np.ndarray, b: np.ndarray) -> float:
    """One pair in time that grows with its length: each value's places in ``b`` are used from the first on."""
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    places: dict[float, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    met, used = [], []
    for i, v in enumerate(a.tolist()):
        free = places.get(v)
        while free and free[-1] < i - reach:  # no later value reaches it
            free.pop()
        if free and free[-1] <= i + reach:
            met.append(v)
            used.append(free.pop())
    m = len(met)
    if not m:
        return 0.0
    moved = int((np.array(met) != b[np.sort(used)]).sum()) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3.0
    prefix = np.cumprod(a[:4][: len(b)] == b[:4][: len(a)]).sum() if len(a) and len(b) else 0
    return float(_winkler(np.float64(jaro), prefix))


def jaro_winkler_batch(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Jaro-Winkler of value lists. Rows are taken in classes of about one length, so padding at most doubles a row; long rows one by one."""
    a, b = _Lists(left), _Lists(right)
    longest = np.maximum(a.length, b.length)
    out = np.zeros(len(longest))
    level = np.ceil(np.log2(np.maximum(longest, 1))).astype(int)
    for k in np.unique(level[longest <= MATRIX]):
        some = np.flatnonzero((level == k) & (longest <= MATRIX))
        out[some] = _short_rows(a, b, some)
    for k in np.flatnonzero(longest > MATRIX).tolist():
        out[k] = _long_row(a.one(k), b.one(k))
    return out


@F.pandas_udf(DoubleType())
def jaro_winkler(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series(jaro_winkler_batch(left, right))


def fused(sims: Column, temperature: float = 0.1) -> Column:
    """Average of an array of similarities with softmax(sim / temperature) weights."""
    def weigh(top: Column) -> Column:
        weights = F.transform(sims, lambda s: F.struct(s.alias("s"), F.exp((s - top) / temperature).alias("w")))
        sums = F.aggregate(
            weights,
            F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")),
            lambda acc, x: F.struct((acc["n"] + x["w"] * x["s"]).alias("n"), (acc["d"] + x["w"]).alias("d")),
        )
        return sums["n"] / sums["d"]

    return bind(F.array_max(sims), weigh)
