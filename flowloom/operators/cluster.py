"""Density clustering and neighbour counts inside groups, exact, with an index of its own for every group.

Equal vectors collapse to one weighted point. A group of at most ``LEAF`` points is compared whole, in one Arrow task.
A larger one is split. First it falls apart at the gaps wider than eps that its points leave on any axis: no two points of
different parts are neighbours, so nothing is lent. What is still large is cut round by round: the open boxes of all large
groups are cut along their longest axis at quantiles of their own points. A point belongs to one box and is lent to those that it reaches within eps, so that each box knows
all neighbours of its own points. A box is done when it is small, when it is not longer than eps across (its points are
all neighbours), or when a cut would lend so many points that nothing is won. What is still large then is compared
block against block where neighbours are counted. To cluster it, each block meets itself and one other; that joins most
points, and only those left outside the main tree of a box, or short of neighbours, are compared with all of it. No task
holds more than two blocks, and no setting of the session is touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators.components import connected_components
from flowloom.operators.ranking import ranked
from flowloom.session import broadcast_if_small, cut_lineage, spread

#: Points that are compared in one task, strips of a cut, and the growth by lent points at which cutting ends.
LEAF = 4096
STRIPS = 8
GROWTH = 2.0
#: Points of a block: two of them meet in one task.
BLOCK = LEAF // 2
#: Rows of a distance matrix that are held at once.
ROWS = 128
#: Cells to an eps in which gaps are looked for, gaps of an axis that are used in a round, and rounds.
FINE = 16
GAPS = 64
GAP_ROUNDS = 4


def _points(df: DataFrame, group_cols: list[str], vec: str, order_cols: list[str], leaf: int) -> tuple[DataFrame, bool]:
    """Distinct vectors per group with number ``pno``, rows ``w``, first row ``first``, the group's number ``gno`` and size ``n``; whether any group is large."""
    # rows are sorted by a hash of the vector; whole arrays, which sort slowly, are compared where hashes meet
    points = df.groupBy(F.xxhash64(vec).alias("_hash"), *group_cols, F.col(vec).alias("vec")).agg(
        F.min(F.struct(*order_cols)).alias("first"), F.count(F.lit(1)).alias("w")
    )
    points = cut_lineage(points.drop("_hash").withColumn("pno", F.monotonically_increasing_id()))
    groups = cut_lineage(points.groupBy(*group_cols).agg(F.min("pno").alias("gno"), F.count(F.lit(1)).alias("n")))
    same = [points[c].eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group_cols)]
    named = groups.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], "gno", "n")
    on = same[0]
    for c in same[1:]:
        on = on & c
    points = points.join(broadcast_if_small(named), on).drop(*[f"_g{i}" for i in range(len(group_cols))])
    large = not groups.where(F.col("n") > leaf).isEmpty()
    return points.withColumn("vec", F.transform("vec", lambda x: x.cast("double"))), large


def _groups(points: DataFrame, leaf: int) -> DataFrame:
    """Every group as one box."""
    return points.select(
        F.col("gno").cast("string").alias("leaf"), "pno", "vec", "w", F.lit(True).alias("own"), F.lit(False).alias("dense"), (F.col("n") <= leaf).alias("whole")
    )


def _apart(points: DataFrame, eps: float, leaf: int) -> DataFrame:
    """Boxes as of ``_groups``, the large ones cut at gaps of more than eps on any axis, which no two neighbours straddle.

    Cells are a fraction of eps; empty cells of together eps and more between two occupied ones are a gap. Cuts lend no
    points, so any number of them is right: a round uses the widest of each axis.
    """
    base = _groups(points, leaf)
    done, open_ = base.where("whole"), base.where(~F.col("whole"))
    cell = lambda x: F.coalesce(F.floor(x * (FINE / eps)), F.lit(0).cast("bigint"))
    for _ in range(GAP_ROUNDS):
        cells = open_.select("leaf", F.posexplode(F.transform("vec", cell)).alias("axis", "cell")).distinct()
        before = F.lag("cell").over(W.partitionBy("leaf", "axis").orderBy("cell"))
        gaps = cells.withColumn("gap", F.col("cell").cast("double") - before).where(F.col("gap") > FINE)
        widest = F.row_number().over(W.partitionBy("leaf", "axis").orderBy(F.desc("gap"), "cell"))
        gaps = gaps.withColumn("_r", widest).where(F.col("_r") <= GAPS).groupBy("leaf", "axis").agg(F.collect_list("cell").alias("cells"))
        cuts = cut_lineage(gaps.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("axis", "cells"))).alias("cuts")))
        if cuts.isEmpty():
            break
        rows = open_.join(broadcast_if_small(cuts), "leaf", "left")
        side = F.transform("cuts", lambda c: F.size(F.filter(c["cells"], lambda v: cell(F.col("vec")[c["axis"]]) >= v)).cast("string"))
        rows = cut_lineage(rows.withColumn("leaf", F.concat_ws("/", "leaf", F.array_join(side, "."))).drop("cuts"))
        sizes = cut_lineage(rows.groupBy("leaf").agg((F.count(F.lit(1)) <= leaf).alias("_small")))
        rows = cut_lineage(rows.join(broadcast_if_small(sizes), "leaf").withColumn("whole", F.col("_small")).drop("_small").select(*base.columns))
        done, open_ = done.unionByName(rows.where("whole")), rows.where(~F.col("whole"))
    return done.unionByName(open_)


def leaves(points: DataFrame, eps: float, leaf: int = LEAF) -> DataFrame:
    """Boxes of points: ``leaf``, ``pno``, ``vec``, ``w``, ``own`` (false where lent), ``dense`` (all within eps), ``whole`` (a group, or a part of one that no neighbour is outside of).

    ``points`` has ``gno``, ``n`` (points of its group), ``pno``, ``vec`` and ``w``.
    """
    base = _apart(points, eps, leaf)
    cols = base.columns
    done = [base.where("whole")]
    open_ = base.where(~F.col("whole"))
    dims = open_.agg(F.max(F.size("vec"))).first()[0]
    while dims:
        own = open_.where("own")
        ends = own.groupBy("leaf").agg(
            F.count(F.lit(1)).alias("n_own"), F.array(*[F.max(F.col("vec")[i]) - F.min(F.col("vec")[i]) for i in range(dims)]).alias("wide")
        )
        across = F.aggregate("wide", F.lit(0.0), lambda s, x: s + x * x)
        ends = ends.select(
            "leaf", "n_own", (across <= eps * eps * (1 - 1e-9)).alias("close"),
            F.array_max(F.transform("wide", lambda x, i: F.struct(x.alias("x"), i.alias("axis"))))["axis"].alias("axis"),
        )
        ends = cut_lineage(ends)
        rows = open_.join(broadcast_if_small(ends), "leaf").withColumn("at", F.col("vec")[F.col("axis")])
        cuts = rows.where("own AND NOT close").where(F.col("n_own") > leaf).groupBy("leaf").agg(
            F.percentile_approx("at", [k / STRIPS for k in range(1, STRIPS)], 1000).alias("cuts"), F.least(F.lit(STRIPS), F.ceil(F.first("n_own") / leaf)).alias("s")
        )
        # no more strips than the box needs
        part = lambda k: F.floor(k * F.col("s") / STRIPS)
        cuts = cuts.select("leaf", F.array_distinct(F.filter("cuts", lambda c, i: part(i + 1) > part(i))).alias("cuts"))
        rows = rows.join(broadcast_if_small(cut_lineage(cuts)), "leaf", "left")
        strip = lambda x: F.size(F.filter("cuts", lambda c: c < x))
        reach = eps * (1 + 1e-9)
        rows = rows.withColumns({"home": strip(F.col("at")), "from": strip(F.col("at") - reach), "to": strip(F.col("at") + reach)})
        gain = rows.where("cuts IS NOT NULL").groupBy("leaf").agg(
            F.sum(F.col("to") - F.col("from") + 1).alias("after"), F.count(F.lit(1)).alias("before"),
            F.max("home").alias("last"), F.min("home").alias("first"),
        )
        gain = gain.where((F.col("after") <= GROWTH * F.col("before")) & (F.col("last") > F.col("first"))).select("leaf", F.lit(True).alias("cut"))
        rows = cut_lineage(rows.join(broadcast_if_small(cut_lineage(gain)), "leaf", "left"))
        done.append(rows.where("cut IS NULL").withColumn("dense", F.col("close")).select(*cols))
        rows = rows.where("cut").withColumn("strip", F.explode(F.sequence("from", "to")))
        rows = rows.withColumns({"own": F.col("own") & (F.col("strip") == F.col("home")), "leaf": F.concat_ws("/", "leaf", F.col("strip").cast("string"))})
        # a strip without own points has nothing to find
        full = rows.groupBy("leaf").agg(F.max("own").alias("_own")).where("_own").select("leaf")
        open_ = cut_lineage(rows.join(broadcast_if_small(cut_lineage(full)), "leaf", "left_semi").select(*cols))
        if open_.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return cut_lineage(out)


def _blocked(boxes: DataFrame, leaf: int, large: bool, half: int = BLOCK) -> DataFrame:
    """Boxes cut into pairs of blocks (``lo``, ``hi``) of some ``half`` points; ``side`` 1 for block ``hi`` where the two differ.

    Of a dense box only pairs of a block of own and a block of lent points: own ones are neighbours as it is.
    """
    if not large:
        return boxes.withColumns({"lo": F.lit(0), "hi": F.lit(0), "side": F.lit(0)})
    sizes = boxes.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n"), F.count_if("own").alias("_n_own"), F.first("dense").alias("_dense"))
    sizes = sizes.where(F.col("_dense") | (F.col("_n") > leaf)).select(
        "leaf", F.ceil(F.when(F.col("_dense"), F.col("_n_own")).otherwise(F.col("_n")) / half).cast("int").alias("_a"),
        F.ceil((F.col("_n") - F.col("_n_own")) / half).cast("int").alias("_b"),
    )
    rows = boxes.join(broadcast_if_small(cut_lineage(sizes)), "leaf", "left").withColumns({"_a": F.coalesce("_a", F.lit(1)), "_b": F.coalesce("_b", F.lit(1))})
    mine = lambda n: F.pmod(F.xxhash64("pno"), F.col(n)).cast("int")
    even = rows.where(~F.col("dense")).withColumn("_own", mine("_a")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_a") - 1)))
    even = even.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other"), "side": (F.col("_own") > F.col("_other")).cast("int")})
    dense = rows.where(F.col("dense") & (F.col("_b") > 0))
    own = dense.where("own").withColumns({"lo": mine("_a"), "_other": F.explode(F.sequence(F.lit(0), F.col("_b") - 1)), "side": F.lit(0)})
    own = own.withColumn("hi", F.col("_a") + F.col("_other"))
    lent = dense.where(~F.col("own")).withColumns({"lo": F.explode(F.sequence(F.lit(0), F.col("_a") - 1)), "hi": F.col("_a") + mine("_b"), "side": F.lit(1)})
    cols = [*boxes.columns, "lo", "hi", "side"]
    return even.select(*cols).unionByName(own.select(*cols)).unionByName(lent.select(*cols))


def _one(boxes: DataFrame) -> DataFrame:
    """Boxes as they are, each for one task."""
    return boxes.withColumns({"lo": F.lit(0), "hi": F.lit(0), "side": F.lit(0)})


def _starred(boxes: DataFrame, half: int) -> DataFrame:
    """Boxes cut into blocks, each of which meets itself and block 0 alone: rows grow with the points. ``all_seen`` where that is the whole box."""
    sizes = boxes.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("_a"))
    rows = boxes.join(broadcast_if_small(cut_lineage(sizes)), "leaf").withColumn("_b", F.pmod(F.xxhash64("pno"), F.col("_a")).cast("int"))
    to = F.when((F.col("_b") == 0) & (F.col("_a") > 1), F.sequence(F.lit(1), F.greatest(F.col("_a") - 1, F.lit(1)))).otherwise(F.array("_b"))
    rows = rows.withColumn("lo", F.explode(to))
    return rows.withColumns({"hi": F.col("lo"), "side": F.lit(0), "all_seen": F.col("_a") <= 2}).drop("_a", "_b")


def _focused(boxes: DataFrame, half: int) -> DataFrame:
    """Pairs of a block of rows with ``focus`` (``side`` 0) and a block of all rows (``side`` 1) of their box; ``lo`` and ``hi`` always differ."""
    sizes = boxes.groupBy("leaf").agg(
        F.ceil(F.count_if("focus") / half).cast("int").alias("_f"), F.ceil(F.count(F.lit(1)) / half).cast("int").alias("_a")
    )
    rows = boxes.join(broadcast_if_small(cut_lineage(sizes.where("_f > 0"))), "leaf")
    mine = lambda n: F.pmod(F.xxhash64("pno"), F.col(n)).cast("int")
    ones = rows.where("focus").withColumns({"lo": mine("_f"), "hi": F.explode(F.sequence(F.col("_f"), F.col("_f") + F.col("_a") - 1)), "side": F.lit(0)})
    others = rows.withColumns({"hi": F.col("_f") + mine("_a"), "lo": F.explode(F.sequence(F.lit(0), F.col("_f") - 1)), "side": F.lit(1)})
    return ones.unionByName(others).drop("_f", "_a")


class _Box:
    """Points of one box, or of two of its blocks, and which of them are neighbours."""

    def __init__(self, t: pa.Table, eps: float):
        self.pno, self.w, self.own = t["pno"].to_numpy(), t["w"].to_numpy(), t["own"].to_numpy(zero_copy_only=False)
        self.side = t["side"].to_numpy()
        self.cross = t["lo"][0] != t["hi"][0]
        size = t["vec"].combine_chunks().value_lengths().to_numpy()
        flat = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.x = flat.reshape(len(size), -1)  # vectors of a run have one length
        self.near = self._neighbours(eps * eps)

    def _neighbours(self, limit: float) -> np.ndarray:
        """Whether two points are within eps: by matrix products, and by plain sums where rounding could decide.

        Of two blocks, points of side 0 (``rows``) against those of side 1 (``cols``); else all against all.
        """
        everyone = np.arange(len(self.x))
        self.rows, self.cols = (np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)) if self.cross else (everyone, everyone)
        x = self.x - self.x.mean(0)
        norm = (x * x).sum(1)
        doubt = 1e-13 * (x.shape[1] + 8) * (4 * norm.max(initial=0) + limit)
        one = np.ones((len(x), 1))
        # one product gives the squared distance less the limit
        left, right = np.hstack([-2 * x, norm[:, None] - limit, one])[self.rows], np.hstack([x, one, norm[:, None]])[self.cols].T
        out = np.zeros((len(self.rows), len(self.cols)), bool)
        for a in range(0, len(self.rows), ROWS):
            c = 0 if self.cross else a  # distances of a box are symmetric
            some, others = self.rows[a : a + ROWS], self.cols[c:]
            gap = left[a : a + ROWS] @ right[:, c:]
            near = gap < -doubt
            i, j = np.nonzero(near ^ (gap <= doubt))
            for b in range(0, len(i), 1 << 16):
                u, v = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
                exact = np.cumsum((self.x[some[u]] - self.x[others[v]]) ** 2, axis=1)[:, -1] if x.shape[1] else np.zeros(len(u))
                near[u, v] = exact <= limit
            out[a : a + ROWS, c:] = near
            if not self.cross:
                out[c:, a : a + ROWS] = near.T
        return out

    def counts(self) -> np.ndarray:
        """Rows within eps of each point, as far as this box pair sees them; a point is near itself in its own block."""
        w, out = self.w.astype(float), np.zeros(len(self.x))
        for a in range(0, len(self.rows), ROWS):
            near = self.near[a : a + ROWS].astype(float)
            out[self.rows[a : a + ROWS]] = near @ w[self.cols]
            if self.cross:
                out[self.cols] += w[self.rows[a : a + ROWS]] @ near
        return out.astype(np.int64)

    def trees(self, core: np.ndarray) -> np.ndarray:
        """Root (least ``pno``) of every core point's tree of core neighbours; -1 for others."""
        root = np.full(len(core), -1)
        for i in np.flatnonzero(core)[np.argsort(self.pno[core])].tolist():
            if root[i] >= 0:
                continue
            root[i], edge = self.pno[i], np.array([i])
            while len(edge):
                edge = np.flatnonzero(self.near[edge].any(0) & core & (root < 0))
                root[edge] = self.pno[i]
        return root

    def touches(self, root: np.ndarray) -> list[tuple[int, int]]:
        """(root, point) for each tree that an own point outside all trees touches."""
        out = []
        for i in np.flatnonzero(self.own & (root < 0)).tolist():
            out += [(int(r), int(self.pno[i])) for r in np.unique(root[self.near[i] & (root >= 0)])]
        return out


def _each_box(fn: Callable[[pa.Table], list[tuple]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Applies ``fn`` to each (leaf, lo, hi) of batches in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> Iterator[pa.RecordBatch]:
            got = fn(pa.Table.from_batches(held)) if held else []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names)

        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch[c].to_pylist() for c in ("leaf", "lo", "hi"))))
            cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if last is not None and keys[a] != last:
                    yield from rows()
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
        yield from rows()

    return run


def _dealt(boxes: DataFrame) -> DataFrame:
    return spread(boxes, "leaf", "lo", "hi").sortWithinPartitions("leaf", "lo", "hi")


def _counted(boxes: DataFrame, eps: float, leaf: int, large: bool = True, half: int = BLOCK) -> DataFrame:
    """``pno`` and ``near``: rows within eps of each own point, its own rows included."""

    def count(t: pa.Table) -> list[tuple]:
        box = _Box(t, eps)
        return [(int(p), int(k)) for p, k, own in zip(box.pno, box.counts(), box.own) if own]

    parts = _dealt(_blocked(boxes, leaf, large, half)).mapInArrow(_each_box(count, ["pno", "near"]), "pno bigint, near bigint")
    if not large:
        return parts
    return parts.unionByName(_dense_totals(boxes)).groupBy("pno").agg(F.sum("near").alias("near"))


def _dense_totals(boxes: DataFrame) -> DataFrame:
    """``pno`` and ``near``: own rows of its box for each own point of a dense one."""
    own = boxes.where("own AND dense").select("leaf", "pno", "w")
    return own.join(own.groupBy("leaf").agg(F.sum("w").alias("near")), "leaf").select("pno", "near")


def _met(split: DataFrame, eps: float, min_samples: int, half: int) -> DataFrame:
    """``kind``, ``u``, ``v``, ``whole`` from one comparison of each block with itself and block 0: 0 as of ``_links``, for points that are core by what
    they meet there; 2 for a point, the rows near it, and whether that was all of its box."""

    def some(t: pa.Table) -> list[tuple]:
        box, seen = _Box(t, eps), int(t["all_seen"][0].as_py())
        near = box.counts()
        root = box.trees(near >= min_samples)
        rows = [(2, p, k, seen) for p, k in zip(box.pno[box.own].tolist(), near[box.own].tolist())]
        return rows + [(0, r, p, 0) for r, p in zip(root[root >= 0].tolist(), box.pno[root >= 0].tolist())]

    names = ["kind", "u", "v", "whole"]
    return cut_lineage(_dealt(_starred(split, half)).mapInArrow(_each_box(some, names), "kind bigint, u bigint, v bigint, whole bigint"))


def _cores(boxes: DataFrame, met: DataFrame, eps: float, min_samples: int, half: int) -> DataFrame:
    """``pno`` and ``core`` of each own point.

    Most show in the few points that they meet in their block and block 0 (``met``); only the others are counted against the whole box.
    """

    def every(t: pa.Table) -> list[tuple]:
        box = _Box(t, eps)
        return [(int(p), int(k)) for p, k, side in zip(box.pno, box.counts(), box.side) if side == 0]

    counts = met.where("kind = 2").select(F.col("u").alias("pno"), F.col("v").alias("near"), F.col("whole").alias("seen"))
    counts = counts.unionByName(_dense_totals(boxes).withColumn("seen", F.lit(0).cast("bigint")))
    met = cut_lineage(counts.groupBy("pno").agg((F.max("near") >= min_samples).alias("core"), F.max("seen").alias("seen")))
    open_ = met.where("NOT core AND seen = 0").select("pno", F.lit(True).alias("focus"))
    if open_.isEmpty():
        return met.select("pno", "core")
    rows = boxes.join(open_, "pno", "left").withColumn("focus", F.coalesce("focus", F.lit(False)) & F.col("own"))
    full = _dealt(_focused(rows, half)).mapInArrow(_each_box(every, ["pno", "near"]), "pno bigint, near bigint")
    full = full.groupBy("pno").agg((F.sum("near") >= min_samples).alias("core"))
    return met.where("core OR seen = 1").select("pno", "core").unionByName(full)


def eps_neighbours(df: DataFrame, group_cols: list[str], id_col: str, vec: str, eps: float, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Number of other rows of the same group within eps of each row, as ``n_neighbours``. Rows with a null vector are left out."""
    points, large = _points(df.where(F.col(vec).isNotNull()), group_cols, vec, [id_col], leaf)
    counts = _counted(leaves(points, eps, leaf) if large else _groups(points, leaf), eps, leaf, large, block)
    named = points.join(counts, "pno").select(*group_cols, F.col("vec").alias("_vec"), (F.col("near") - 1).alias("n_neighbours"))
    return _back(df, named, group_cols, vec, "inner")


def _back(df: DataFrame, named: DataFrame, group_cols: list[str], vec: str, how: str) -> DataFrame:
    """``df`` with what is known of its group and vector. Rows are sorted by a hash of the vector, as whole arrays sort slowly, and compared in full where hashes meet."""
    renamed = named.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(group_cols)}).withColumn("_hash", F.xxhash64("_vec"))
    wide = F.transform(df[vec], lambda x: x.cast("double"))
    on = (F.xxhash64(wide) == F.col("_hash")) & (wide <= F.col("_vec")) & (wide >= F.col("_vec"))  # an equality would be sorted by
    for i, c in enumerate(group_cols):
        on = on & df[c].eqNullSafe(F.col(f"_g{i}"))
    return df.join(renamed, on, how).drop("_vec", "_hash", *[f"_g{i}" for i in range(len(group_cols))])


def _links(boxes: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``kind``, ``u``, ``v``, ``whole``: 0 for a tree's root and a core point in it, 1 for a tree's root and a point that it touches.

    Whole boxes get their counts and touched points here; pieces of other boxes bring ``core``. At two samples any neighbour
    makes a core point, and nothing is touched.
    """

    def link(t: pa.Table) -> list[tuple]:
        box = _Box(t, eps)
        whole = t["whole"][0].as_py()
        core = box.counts() >= min_samples if whole else t["core"].to_numpy(zero_copy_only=False)
        root = box.trees(core)
        rows = [(0, int(r), int(p), int(whole)) for r, p in zip(root, box.pno) if r >= 0]
        return rows + ([(1, r, p, 1) for r, p in box.touches(root)] if whole and min_samples > 2 else [])

    return _dealt(boxes).mapInArrow(_each_box(link, ["kind", "u", "v", "whole"]), "kind bigint, u bigint, v bigint, whole bigint")


def _other_links(boxes: DataFrame, eps: float, half: int) -> DataFrame:
    """``kind``, ``u``, ``v`` as of ``_links`` for rows with ``focus``: roots (``root``, -1 without one) of core neighbours that are not one tree yet,
    and roots that a point outside all trees touches."""

    def link(t: pa.Table) -> list[tuple]:
        box, root = _Box(t, eps), t["root"].to_numpy()
        theirs, mine = root[box.cols], box.rows
        order = np.flatnonzero(theirs >= 0)
        order = order[np.argsort(theirs[order], kind="stable")]
        if not len(order) or not len(mine):
            return []
        roots, starts = np.unique(theirs[order], return_index=True)
        met = np.logical_or.reduceat(box.near[:, order], starts, axis=1)
        i, j = np.nonzero(met & (root[mine][:, None] != roots))
        core = root[mine][i] >= 0
        joins = np.unique(np.stack([root[mine][i[core]], roots[j[core]]], 1), axis=0)
        touched = zip(roots[j[~core]].tolist(), box.pno[mine][i[~core]].tolist())
        return [(0, u, v) for u, v in joins.tolist()] + [(1, u, v) for u, v in touched]

    return _dealt(_focused(boxes, half)).mapInArrow(_each_box(link, ["kind", "u", "v"]), "kind bigint, u bigint, v bigint").distinct()


def _rooted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pno`` and ``root`` of each of ``nodes`` (``pno``): the least one it is joined with, or itself."""
    joined = connected_components(edges.select("u", "v").distinct())
    return nodes.join(joined, F.col("pno") == F.col("node"), "left").select("pno", F.coalesce("root", "pno").alias("root"))


def _split_links(split: DataFrame, links: DataFrame, eps: float, half: int) -> tuple[DataFrame, DataFrame]:
    """Roots of the core points of split boxes, and (``u``, ``v``) for a root and a point outside all trees that it touches.

    ``links`` join most of a box's core points to one tree: only points of other trees can still join something to it.
    """
    own = split.where("own AND dense AND core").select("leaf", "pno")
    star = own.join(own.groupBy("leaf").agg(F.min("pno").alias("u")), "leaf").select("u", F.col("pno").alias("v"))
    across = links.where("kind = 0 AND whole = 0").select("u", "v").unionByName(star)
    roots = cut_lineage(_rooted(across, split.where("own AND core").select("pno")))
    rows = cut_lineage(split.join(roots, "pno", "left").withColumn("root", F.coalesce("root", F.lit(-1).cast("bigint"))))
    main = rows.where("root >= 0").groupBy("leaf", "root").agg(F.count(F.lit(1)).alias("_n")).groupBy("leaf").agg(F.max_by("root", F.struct("_n", "root")).alias("_main"))
    rows = rows.join(broadcast_if_small(cut_lineage(main)), "leaf")
    rows = rows.withColumn("focus", F.when(F.col("root") >= 0, F.col("root") != F.col("_main")).otherwise(F.col("own"))).drop("_main")
    more = cut_lineage(_other_links(rows, eps, half))
    merged = cut_lineage(_rooted(more.where("kind = 0"), roots.select(F.col("root").alias("pno")).distinct()))
    merged = merged.select(F.col("pno").alias("_old"), F.col("root").alias("_new"))
    roots = roots.join(merged, F.col("root") == F.col("_old")).select("pno", F.col("_new").alias("root"))
    return roots, more.where("kind = 1").select("u", "v")


def cluster_by_group(
    df: DataFrame, group_cols: list[str], id_col: str, vec: str, order_cols: list[str], eps: float = 0.1, min_samples: int = 2, leaf: int = LEAF,
    block: int = BLOCK,
) -> DataFrame:
    """Add cluster_id: numbered from 0 inside the group by first row (``order_cols``), -1 for noise and for null vectors.

    A row with at least ``min_samples`` rows within eps (itself included) is core. Clusters are the connected
    core rows; a border row takes the lowest-numbered cluster it touches. Vectors have one length.
    """
    keys = list(group_cols)
    points, large = _points(df.where(F.col(vec).isNotNull()), keys, vec, order_cols, leaf)
    boxes = leaves(points, eps, leaf) if large else _groups(points, leaf)
    pieces = _one(boxes.where("whole").withColumn("core", F.lit(None).cast("boolean")))
    split = boxes.where(~F.col("whole"))
    large = large and not split.isEmpty()
    if large:
        met = _met(split, eps, min_samples, block)
        split = cut_lineage(split.join(_cores(split, met, eps, min_samples, block), "pno"))
        if min_samples > 2:  # at two, who is core in a block shows there, and so do its trees
            pieces = pieces.unionByName(_starred(split, block).select(pieces.columns))
    links = _links(pieces, eps, min_samples)
    links = cut_lineage(links.unionByName(met.where("kind = 0")) if large and min_samples <= 2 else links)
    roots = links.where("kind = 0 AND whole = 1").select(F.col("v").alias("pno"), F.col("u").alias("root"))
    touch = links.where("kind = 1").select("u", "v")
    if large:
        found, met = _split_links(split, links, eps, block)
        roots, touch = cut_lineage(roots.unionByName(found)), touch.unionByName(met)
    core = points.join(roots, "pno").select(*keys, "pno", "root", "first")
    first = core.groupBy(*keys, "root").agg(F.min("first").alias("_first"))
    numbers = cut_lineage(ranked(cut_lineage(first), keys, ["_first"], name="cluster_id").select("root", "cluster_id"))
    known = roots.join(numbers, "root").select("pno", "cluster_id")
    if min_samples > 2:  # at two, any neighbour makes a core point
        top = roots.withColumnsRenamed({"pno": "u"}).join(numbers, "root").select("u", "cluster_id")
        known = known.unionByName(touch.withColumnRenamed("v", "pno").join(top, "u").groupBy("pno").agg(F.min("cluster_id").alias("cluster_id")))
    named = points.join(known, "pno").select(*keys, F.col("vec").alias("_vec"), "cluster_id")
    out = _back(df, named, keys, vec, "left")
    return out.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1).cast("bigint")))
