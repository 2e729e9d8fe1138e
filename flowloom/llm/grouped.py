"""Whole groups out of sorted Arrow batches, and links inside groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import broadcast_if_small, cut_lineage, spread


def group_links(
    members: DataFrame, key: str, item: str, sizes: DataFrame, attach: Callable[[DataFrame], DataFrame], fn: Callable[[pa.Table], list[tuple]]
) -> DataFrame:
    """Links (``u``, ``v``) that connect, inside every group of equal ``key``, all items that ``fn`` finds linked.

    ``members`` has ``key`` and ``item`` (and what else ``attach`` needs), ``sizes`` has ``key`` and ``_blocks``, in how many
    blocks to cut the group, for the groups that need more than one. ``attach`` adds what is compared to rows of ``members``
    that are dealt out with ``lo``, ``hi`` and ``side``. ``fn`` gets the tables of equal (``key``, ``lo``, ``hi``) and returns
    stars from the smallest item of each tree; where ``lo`` and ``hi`` differ only links between the sides are asked for.

    A cut group is first compared inside its blocks, each of which also gets the group's smallest item, its hub: n rows and
    one more for each block. Items that hang together with the hub there are settled. Only the others, if any, are
    then compared, with each other and with the settled ones, block against block. So rows grow with the group as long as
    the hub's links cover it; each item that they leave out is sent once for each block of the group.
    """
    sizes = cut_lineage(sizes.select(key, F.col("_blocks").cast("int").alias("_blocks")))
    if sizes.isEmpty():
        one = members.withColumns({"lo": F.lit(0), "hi": F.lit(0), "side": F.lit(0)})
        return map_groups(attach(one), [key, "lo", "hi"], fn, "u bigint, v bigint", ["u", "v"])
    large = cut_lineage(members.join(broadcast_if_small(sizes), key))
    hubs = cut_lineage(large.groupBy(key, "_blocks").agg(F.min(item).alias("_hub")))
    dealt = members.join(broadcast_if_small(hubs), key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(7), item), F.col("_blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("_blocks") - 1)
    first = dealt.withColumn("lo", F.explode(F.when(F.col(item) == F.col("_hub"), everywhere).otherwise(F.array(own))))
    first = first.withColumns({"hi": F.col("lo"), "side": F.lit(0)}).drop("_blocks", "_hub")

    def named(group: pa.Table) -> list[tuple]:
        at = group[key][0].as_py()
        return [(at, u, v) for u, v in fn(group)]

    inside = cut_lineage(map_groups(attach(first), [key, "lo", "hi"], named, f"`{key}` bigint, u bigint, v bigint", [key, "u", "v"]))
    links = inside.select("u", "v")
    settled = inside.join(broadcast_if_small(hubs), key).where(F.col("u") == F.col("_hub")).select(key, F.col("v").alias(item)).distinct()
    large = large.join(broadcast_if_small(hubs.drop("_blocks")), key)
    open_ = large.where(F.col(item) != F.col("_hub")).drop("_hub").join(settled, [key, item], "left_anti").withColumn("_open", F.lit(True))
    closed = large.where(F.col(item) == F.col("_hub")).drop("_hub").unionByName(large.drop("_hub").join(settled, [key, item], "left_semi"))
    both = cut_lineage(open_.unionByName(closed.withColumn("_open", F.lit(False))))
    share = lambda n: F.greatest(F.ceil(F.first("_blocks") * n / F.count("*")), F.lit(1)).cast("int")
    parts = both.groupBy(key).agg(share(F.count_if("_open")).alias("_ub"), share(F.count_if(~F.col("_open"))).alias("_sb"), F.bool_or("_open").alias("_some"))
    parts = cut_lineage(parts.where("_some").drop("_some"))
    if parts.isEmpty():
        return links
    mine = lambda n: F.pmod(F.xxhash64(F.lit(11), item), F.col(n)).cast("int")
    place = lambda lo, hi, side: F.struct(lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    ub, sb = F.sequence(F.lit(0), F.col("_ub") - 1), F.sequence(F.lit(0), F.col("_sb") - 1)
    among = F.transform(ub, lambda o: place(F.least(o, mine("_ub")), F.greatest(o, mine("_ub")), (mine("_ub") > o).cast("int")))
    asks = F.transform(sb, lambda o: place(mine("_ub"), -1 - o, F.lit(0)))
    meets = F.transform(ub, lambda o: place(o, -1 - mine("_sb"), F.lit(1)))
    across = both.join(broadcast_if_small(parts), key).withColumn("_at", F.explode(F.when(F.col("_open"), F.concat(among, asks)).otherwise(meets)))
    across = across.select(*members.columns, "_at.lo", "_at.hi", "_at.side")
    return links.unionByName(map_groups(attach(across), [key, "lo", "hi"], fn, "u bigint, v bigint", ["u", "v"]))


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.RecordBatch], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    """Applies ``fn`` to each group of equal ``keys`` (bigint), dealt by key and streamed in key order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            cut = np.append(_starts(table, keys), len(table))
            rows = [r for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) if b - a > 1 for r in fn(table.slice(a, b - a))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return spread(df, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 0) -> Iterator[pa.Table]:
    """Tables that end where a group of equal ``keys`` ends, from batches in key order; a next one begins after ``rows`` rows."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        if kept and size >= rows and any(kept[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(kept).combine_chunks()
            kept, size = [], 0
        last = int(_starts(pa.Table.from_batches([batch]), keys)[-1])
        if last and size + last >= rows:
            yield pa.Table.from_batches([*kept, batch.slice(0, last)]).combine_chunks()
            kept, size, batch = [], 0, batch.slice(last)
        kept.append(batch)
        size += len(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


class Forest:
    """Union-find over the members of one group; the first member of a tree is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)

    def links(self, ids: np.ndarray) -> list[tuple]:
        """A star for each tree: its first member's id with every other's."""
        roots = [self.root(i) for i in range(len(self.up))]
        return [(int(ids[r]), int(ids[i])) for i, r in enumerate(roots) if r != i]
