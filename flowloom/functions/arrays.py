"""Fixed-width flow channels as array expressions.

Inner lambdas never capture a computed array: Spark would evaluate it again for every element. ``bind``
evaluates a value once and hands it to the lambda as a variable.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.schemas import WIDTH


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def pad_clip(a: Column, n: int | Column = WIDTH, fill: float = 0) -> Column:
    """Exactly ``n`` entries: the first ones of ``a``, then ``fill``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(F.slice(a, F.lit(1), n), F.array_repeat(F.lit(fill), n)), F.lit(1), n)


def size_channel(a: Column) -> Column:
    """Squash sizes into [0, 1): (2/pi) * atan(log2(size) / 8). The padding size 1 becomes 0."""
    def squash(s: Column) -> Column:
        return F.when(s > 0, F.atan(F.log2(s) / 8.0) * (2.0 / math.pi)).otherwise(-1.0).cast("float")

    return F.transform(a, squash)


def direction_channel(a: Column, backward: float = 0.5) -> Column:
    return F.transform(a, lambda d: F.when(d == -1, F.lit(backward)).otherwise(d).cast("float"))


def gap_channel(ts: Column, n: int = WIDTH, min_gap: float = 0.1, step: float = 0.05, top: float = 10.0,
                time_dtype: str = "float") -> Column:
    """Gaps between packets: below ``min_gap`` 0, else rounded to ``step`` (half even), clipped to ``top``, over ``top``.

    With ``time_dtype='float'`` times are single precision before subtracting. Epoch seconds near 1.5e9 then
    sit on a 128-second grid, and later rules rely on the repeated values this gives.
    """
    t = F.transform(F.slice(ts, 1, n + 1), lambda x: x.cast(time_dtype))

    def quantise(later: Column, earlier: Column) -> Column:
        gap = F.coalesce(later - earlier, F.lit(0.0)).cast("float").cast("double")
        small = F.when(gap < float(min_gap), 0.0)
        return small.otherwise(F.least(F.bround(gap / step) * step, F.lit(top)) / top).cast("float")

    gaps = bind(t, lambda v: F.zip_with(F.slice(v, 2, n), F.slice(v, 1, n), quantise))
    return pad_clip(gaps, n, 0.0)


def start_offset(first_ts: Column, origin: Column, time_dtype: str = "float") -> Column:
    """log1p(first - origin) / 12."""
    since = (first_ts.cast(time_dtype) - origin.cast(time_dtype)).cast("float").cast("double")
    return (F.log1p(since) / 12.0).cast("float")


def shift(a: Column, by: Column) -> Column:
    return bind(by, lambda b: F.transform(a, lambda x: (x.cast("double") + b.cast("double")).cast("float")))


def signed_size(size: Column, dirs: Column) -> Column:
    return F.zip_with(size, dirs, lambda s, d: (s * d).cast("float"))


def effective_len(dirs: Column, n: int = WIDTH) -> Column:
    """Packets before the padding. Zero directions occur only as padding."""
    return F.least(F.size(dirs), F.lit(n))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(v: Column, eps: float = 1e-8) -> Column:
    """v / max(norm, eps)."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return bind(norm, lambda n: F.transform(v, lambda x: x.cast("double") / n))


def differences(v: Column) -> Column:
    """Each entry minus the one before it; the first minus 0."""
    zero = F.array(F.lit(0.0))
    wide = F.transform(v, lambda x: x.cast("double"))
    return bind(wide, lambda w: F.zip_with(w, F.concat(zero, F.slice(w, F.lit(1), F.size(w) - 1)), lambda x, p: x - p))
