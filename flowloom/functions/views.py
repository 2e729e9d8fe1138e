"""Perturbed views of a size channel. Positions are drawn by ranking md5(seed, tag, id, position)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.arrays import bind, pad_clip


def drawn_positions(id_: Column, length: Column, tag: str, rate: float = 0.3, seed: int = 42) -> Column:
    """max(1, floor(rate * length)) distinct positions in [0, length), in draw order."""
    count = F.greatest(F.lit(1), F.floor(length * F.lit(rate)).cast("int"))
    name = F.concat(F.lit(f"{seed}|{tag}|"), id_.cast("string"), F.lit("|"))

    def ranked(prefix: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), length - 1),
            lambda i: F.struct(F.md5(F.concat(prefix, i.cast("string"))).alias("h"), i.cast("int").alias("i")),
        )

    return F.slice(F.transform(F.array_sort(bind(name, ranked)), lambda s: s["i"]), F.lit(1), count)


def masked(size: Column, positions: Column, value: float = -0.1) -> Column:
    return bind(
        positions,
        lambda p: F.transform(size, lambda v, i: F.when(F.array_contains(p, i), F.lit(value).cast("float")).otherwise(v)),
    )


def reordered(size: Column, positions: Column) -> Column:
    """From the highest position down, swap each with its predecessor; position 0 acts as 1."""
    order = F.sort_array(F.transform(positions, lambda p: F.greatest(p, F.lit(1))), asc=False)

    def swap(acc: Column, p: Column) -> Column:
        return F.transform(acc, lambda v, i: F.when(i == p, acc[p - 1]).when(i == p - 1, acc[p]).otherwise(v))

    return F.aggregate(order, size, swap)


def missing(size: Column, positions: Column) -> Column:
    kept = bind(positions, lambda p: F.filter(size, lambda v, i: ~F.array_contains(p, i)))
    return pad_clip(kept, F.size(size), 0.0)


def duplicated(size: Column, length: Column, positions: Column) -> Column:
    again = bind(size, lambda s: F.transform(positions, lambda p: s[p]))
    return pad_clip(F.concat(F.slice(size, F.lit(1), length), again), F.size(size), 0.0)
