"""Hard negatives by exact inner-product search with length buckets and coordinate pruning (after LEMP).

Rows are dealt by (label, falling length) into parts of bounded size, each an index of its own: buckets of rows of
similar length, and in each bucket a sorted list of every coordinate of the rows' directions. For an anchor that needs
a score of ``low`` at least, a bucket of rows up to length ``l`` must hold a direction with a cosine of
``low / (|anchor| l)``. Where that is above 1, this bucket and all shorter ones are out. Else it bounds the value that
the direction may have in each coordinate; the anchor's ``FOCUS`` largest coordinates are looked up in the sorted
lists and the ranges intersected. What is left is verified by its integer score. The bound rises as results come in.

The anchors are the query set: their rows are sent to the parts that can hold an answer (for positives, parts with
the anchor's label; for negatives, parts with another label and rows long enough), while the rows of a part stay where they are.
A task streams anchors past one part's index, so its memory is bounded by ``PART_VALUES``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.session import cut_lineage, spread

#: Vector entries of a part, rows of a bucket, the least share of its longest row's length in it, coordinates looked up.
PART_VALUES = 4 << 20
BUCKET = 1024
SHORTEST = 0.9
FOCUS = 4
#: Anchors handled at once against one bucket.
ANCHORS = 64
#: Scores stay below it, so that floats hold them exactly.
LIMIT = 1 << 53
_SLACK = 1e-9
_NONE = -(1 << 62)


def _packer(dims: int):
    """Vectors to fixed-width bytes of 32-bit integers, with their lengths."""
    most = min(math.isqrt(LIMIT // max(dims, 1)), (1 << 31) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["vec"].value_lengths().to_numpy()
            row = np.repeat(np.arange(len(batch)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            x = np.zeros((len(batch), dims), np.int32)
            x[row, place] = np.clip(batch["vec"].flatten().to_numpy(), -most, most)
            raw, wide = x.tobytes(), 4 * dims
            packed = pa.array([raw[i * wide : (i + 1) * wide] for i in range(len(batch))], pa.binary())
            length = np.sqrt((x.astype(float) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["anchor"], packed, pa.array(length)], ["id", "label", "anchor", "x", "length"])

    return run


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), dims).astype(float)


class Bucket:
    """Rows of similar length with a sorted list of each coordinate of their directions."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray):
        self.x, self.ids, self.labels, self.longest = x, ids, labels, float(lengths.max())
        self.unit = x / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0).astype(np.int32)
        self.lists = np.take_along_axis(self.unit, self.order, axis=0)

    def scores(self, q: np.ndarray, length: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors that can reach ``low`` here, and their scores with all rows; rows that can't reach it have ``_NONE``."""
        reach = length * self.longest
        cosine = np.where(low > 0, low / np.maximum(reach, 1e-300), -1.0)
        live = np.flatnonzero(cosine <= 1 + _SLACK)
        out = np.full((len(self.ids), len(live)), float(_NONE))
        whole = np.ones(len(live), bool)
        pruned = np.flatnonzero(cosine[live] > 0)
        if len(pruned):
            some = live[pruned]
            unit = q[some] / length[some][:, None]
            focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
            own = np.arccos(np.clip(np.take_along_axis(unit, focus, 1), -1, 1))
            wide = np.arccos(np.clip(cosine[some], 0, 1))[:, None]
            low_value = np.cos(np.minimum(own + wide, np.pi)) - _SLACK
            high_value = np.cos(np.maximum(own - wide, 0)) + _SLACK
            cuts = (low_value > self.lists[0][focus]) | (high_value < self.lists[-1][focus])  # else the whole list is feasible
            for k in np.flatnonzero(cuts.any(1)).tolist():
                whole[pruned[k]] = False
                rows = self._intersect(focus[k], low_value[k], high_value[k])
                out[rows, pruned[k]] = self.x[rows] @ q[some[k]]
        if whole.any():
            out[:, whole] = self.x @ q[live[whole]].T
        return live, out

    def _intersect(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows whose values lie in the feasible range of every focus coordinate, from the shortest list on."""
        begin = [int(np.searchsorted(self.lists[:, f], a, "left")) for f, a in zip(focus, low)]
        end = [int(np.searchsorted(self.lists[:, f], b, "right")) for f, b in zip(focus, high)]
        best = int(np.argmin(np.subtract(end, begin)))
        rows = self.order[begin[best] : max(begin[best], end[best]), focus[best]]
        for k, f in enumerate(focus):
            if k != best:
                v = self.unit[rows, f]
                rows = rows[(v >= low[k]) & (v <= high[k])]
        return rows


def _index(tables: list[pa.RecordBatch], dims: int) -> list[Bucket]:
    """Buckets of the distinct rows, the longest first."""
    t = pa.Table.from_batches(tables).group_by(["id", "label", "x", "length"]).aggregate([]).combine_chunks()
    t = t.sort_by([("length", "descending"), ("id", "ascending")])
    x, length = _matrix(t["x"].combine_chunks(), dims), t["length"].to_numpy()
    ids, labels = t["id"].to_numpy(), t["label"].to_numpy()
    out, start = [], 0
    while start < len(ids):
        near = int(np.searchsorted(-length, -length[start] * SHORTEST, "right"))
        stop = max(start + 1, min(start + BUCKET, near))
        out.append(Bucket(*(v[start:stop] for v in (x, ids, labels, length))))
        start = stop
    return out


class Wants:
    """Searches of some anchors: the best ``k`` scores within [low, high] for each."""

    def __init__(self, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.owner, self.low, self.high, self.k = owner, low.astype(float), high.astype(float), k
        self.scores = np.full((len(owner), k), float(_NONE))
        self.ids = np.zeros((len(owner), k), np.int64)

    def need(self, anchors: int) -> np.ndarray:
        """The least score that still serves each anchor."""
        out = np.full(anchors, np.inf)
        np.minimum.at(out, self.owner, self.low)
        return out

    def offer(self, live: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Takes what is better from ``scores`` (row by live anchor), where ``allowed``."""
        column = np.full(int(self.owner.max(initial=-1)) + 1, -1)
        known = live[live < len(column)]
        column[known] = np.arange(len(known))
        for w in np.flatnonzero(column[self.owner] >= 0).tolist():
            c = column[self.owner[w]]
            s = scores[:, c]
            rows = np.flatnonzero((s >= self.low[w]) & (s <= self.high[w]) & allowed[:, c])
            if not len(rows):
                continue
            if len(rows) > self.k:
                bar = np.partition(s[rows], len(rows) - self.k)[len(rows) - self.k]
                rows = rows[s[rows] >= bar]  # with all ties, the ids decide below
            s = np.concatenate([self.scores[w], s[rows]])
            i = np.concatenate([self.ids[w], ids[rows]])
            best = np.lexsort((i, -s))[: self.k]
            self.scores[w], self.ids[w] = s[best], i[best]
            if self.scores[w, -1] > _NONE:
                self.low[w] = max(self.low[w], self.scores[w, -1])


def _search(dims: int, k: int, same: bool):
    """Rows of each part come first and make its index, then anchors stream past it."""

    def answers(index: list[Bucket], batch: pa.RecordBatch) -> pa.RecordBatch:
        q, length = _matrix(batch["x"], dims), batch["length"].to_numpy()
        ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
        owner = np.repeat(np.arange(len(batch)), batch["low"].value_lengths().to_numpy())
        wants = Wants(owner, batch["low"].flatten().to_numpy(), batch["high"].flatten().to_numpy(), k)
        for bucket in index:
            live, scores = bucket.scores(q, length, wants.need(len(batch)))
            if len(live):
                equal = bucket.labels[:, None] == labels[live]
                wants.offer(live, scores, bucket.ids, (equal if same else ~equal) & (bucket.ids[:, None] != ids[live]) & (scores > _NONE))
        w, j = np.nonzero(wants.scores > _NONE)
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        return pa.RecordBatch.from_arrays(
            [pa.array(batch["anchor"].to_numpy()[owner[w]]), pa.array(number[w].astype(np.int32)), pa.array(wants.ids[w, j]), pa.array(wants.scores[w, j].astype(np.int64))],
            ["anchor", "want", "id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, index = None, [], None
        for batch in batches:
            mark = batch["part"].to_numpy() * 2 + batch["kind"].to_numpy()
            for at in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(mark)) + 1):
                if not len(at):
                    continue
                run_of = batch.slice(int(at[0]), len(at))
                if run_of["part"][0].as_py() != part:
                    part, rows, index = run_of["part"][0].as_py(), [], None
                if run_of["kind"][0].as_py() == 0:
                    rows.append(run_of.select(["id", "label", "x", "length"]))
                    continue
                if index is None:
                    index, rows = _index(rows, dims) if rows else [], []
                for a in range(0, len(run_of), ANCHORS):
                    yield answers(index, run_of.slice(a, ANCHORS))

    return run


def _best(rows: DataFrame, asked: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """``anchor``, ``want`` (number of its band), ``rank`` from 1, ``id``, ``score``: the best ``k`` over all parts."""
    none = F.lit(None).cast("array<bigint>")
    here = rows.select("part", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("anchor"), "id", "label", "x", "length", none.alias("low"), none.alias("high"))
    met = here.unionByName(asked.select("part", F.lit(1).alias("kind"), "anchor", "id", "label", "x", "length", "low", "high"))
    met = spread(met, "part").sortWithinPartitions("part", "kind")
    found = met.mapInArrow(_search(dims, k, same), "anchor bigint, want int, id bigint, score bigint")
    order = W.partitionBy("anchor", "want").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, part_values: int = PART_VALUES
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``df`` has ``vec_id`` and ``label`` (bigint) and ``vec`` (array of bigint); rows where ``anchor`` holds are asked for.
    An anchor's positives are the ``positives`` best other rows of its label; for each, the ``negatives`` best rows of
    other labels follow whose score is ``low_percent`` to ``high_percent`` of the positive's. Ties go to the smaller
    ``vec_id``. A positive with a score below zero has no band and a score of zero only zeros. Rows with a null in
    ``vec_id``, ``label`` or ``vec`` take no part; rows equal in all three count once, and rows of the anchor's own id
    are never its partners. Shorter vectors are filled up with zeros. Components are held within a bound that keeps
    scores below 2^53 (some 11 million at 64 dimensions). An empty table, a lone label or an anchor without partners
    give no rows. Texts and other columns are not read.
    """
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", F.isnull)
    given = df.where(whole).select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("vec").cast("array<bigint>").alias("vec")
    )
    seen = given.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    n, dims = seen["n"], seen["dims"] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n * max(dims, 1) / part_values))
    rows = given.mapInArrow(_packer(dims), "id bigint, label bigint, anchor boolean, x binary, length double")
    rows = cut_lineage(rows.repartitionByRange(parts, "label", F.desc("length"), F.xxhash64("id")).withColumn("part", F.spark_partition_id()))
    asked = rows.where("anchor").select("id", "label", "x", "length").distinct().withColumn("anchor", F.monotonically_increasing_id())
    asked = cut_lineage(asked)
    bounds = rows.groupBy("part").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.max("length").alias("longest"))
    places = rows.select("label", "part").distinct()
    wide = F.array(F.lit(LIMIT).cast("bigint"))
    own = asked.join(places, "label").withColumns({"low": F.transform(wide, lambda x: -x), "high": wide})
    found = cut_lineage(_best(rows, own, dims, positives, True))
    band = found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank").where("positive_score >= 0")
    # integer bounds: the least score with 100 * score >= low_percent * positive_score, and the greatest likewise
    band = band.withColumns({
        "low": F.expr(f"({low_percent} * positive_score + 99) DIV 100"), "high": F.expr(f"({high_percent} * positive_score) DIV 100"),
    }).where("low <= high")
    bands = band.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high", "positive_id", "positive_score"))).alias("bands"))
    bands = cut_lineage(asked.join(bands, "anchor"))
    other = bands.withColumns({"low": F.col("bands.low"), "high": F.col("bands.high"), "part": F.explode(F.sequence(F.lit(0), F.lit(max(parts, _part_count(rows)) - 1)))})
    other = other.join(bounds, "part").where(
        ((F.col("first") != F.col("label")) | (F.col("last") != F.col("label"))) & (F.col("longest") * F.col("length") * (1 + _SLACK) >= F.array_min("low"))
    )
    best = _best(rows, other.drop("bands"), dims, negatives, False)
    chosen = F.col("bands")[F.col("want")]
    return best.join(bands.select("anchor", F.col("id").alias("anchor_id"), "bands"), "anchor").select(
        "anchor_id", chosen["positive_id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        chosen["positive_score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _part_count(rows: DataFrame) -> int:
    """Parts that the range shuffle has made."""
    return (rows.agg(F.max("part")).first()[0] or 0) + 1
