"""Substring dedup by seed and extend: repeats of ``WINDOW`` words and more between documents, without listing pairs.

*Seeds.* Every run of ``SEED`` words is hashed; the least hash of each ``WINDOW - SEED + 1`` neighbouring runs is an
anchor (winnowing). Equal windows hold the same anchor at the same place, so documents that share a window meet there.

*Extend.* An anchor can be extended by ``REACH`` words to each side before a window no longer holds it. Occurrences of
an anchor whose whole surroundings agree are one class: a class is summed up by its smallest document before anything
is compared, and all other occurrences in it are repeats as far as they reach. Only where the classes of one anchor
differ is one occurrence of each (in its smallest document) extended: its surroundings are hashed step by step to the
left and to the right, and two classes share a window if they agree ``r`` words to the left and ``REACH - r`` to the
right. The farthest of these to both sides are the maximal repeat around the anchor, kept if it reaches ``WINDOW``
words. Classes of one anchor are compared together in one task up to ``GROUP``; the extensions of more are keys of an
aggregation that Spark spreads, so a passage that stands in a third of all documents needs no task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.grouped import whole_groups
from flowloom.llm.text import Flat, blocks, mix, span_hashes
from flowloom.session import broadcast_if_small, cut_lineage, spread

WINDOW = 50
SEED = 8
REACH = WINDOW - SEED
#: Classes of one anchor that one task compares.
GROUP = 1024
#: Anchors whose surroundings are gathered at once.
ROWS = 1 << 14

_SALT = mix(np.arange(1, 2 * WINDOW, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_DOC = ["doc_id", "text_key"]


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over ``x[i : i + width]`` at every place where that is whole."""
    span, out = 1, x
    while 2 * span <= width:
        out, span = pick(out[: len(out) - span], out[span:]), 2 * span
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places of the anchors, the hashes of all runs, and the least one of each window (0 where a text ends inside).

    ``h`` are words of texts that begin at ``first`` (one more than texts).
    """
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), h[:0], h[:0]
    runs = np.zeros(len(h) - SEED + 1, np.uint64)
    for k in range(SEED):
        runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SEED + 1 + k])
    low = _sliding(runs, REACH + 1, np.minimum)
    end = np.repeat(first[1:], np.diff(first))
    low[np.arange(len(low)) + WINDOW > end[: len(low)]] = 0  # a window across two texts
    edge = np.zeros(REACH, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), REACH + 1, np.maximum) == runs), runs, low


def surroundings(h: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the ``REACH`` words before each anchor, its own, and ``REACH`` behind; 0 beyond the text."""
    text = np.searchsorted(first, at, side="right") - 1
    place = at[:, None] + np.arange(-REACH, WINDOW)
    out = h[np.clip(place, 0, len(h) - 1)]
    out[(place < first[text][:, None]) | (place >= first[text + 1][:, None])] = 0
    return out


def extension_keys(words: np.ndarray) -> np.ndarray:
    """For each row of ``surroundings`` and each ``r``: a hash of the extensions by ``r`` words to the left and ``REACH - r`` to the right."""
    n = len(words)
    left, right = np.zeros((n, REACH + 1), np.uint64), np.zeros((n, REACH + 1), np.uint64)
    for k in range(SEED):
        right[:, 0] = mix(right[:, 0] * np.uint64(0xD6E8FEB86659FD93) + words[:, REACH + k])
    for r in range(REACH):
        left[:, r + 1] = mix(left[:, r] * np.uint64(0xA24BAED4963EE407) + words[:, REACH - 1 - r])
        right[:, r + 1] = mix(right[:, r] * np.uint64(0xD6E8FEB86659FD93) + words[:, WINDOW + r])
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right[:, ::-1] + np.arange(REACH + 1, dtype=np.uint64))


def own_windows(at: np.ndarray, runs: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether the window that begins ``r`` words before the anchor is one of those that chose it; a range of ``r``."""
    start = at[:, None] - np.arange(REACH + 1)
    return (start >= 0) & (start < len(low)) & (low[np.clip(start, 0, len(low) - 1)] == runs[at][:, None])


def _words(texts: pa.Array) -> tuple[Flat, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat = Flat(texts)
    starts, ends, first = flat.words()
    h = span_hashes(flat.data, starts, ends)
    return flat, starts, ends, first, h | np.uint64(1)  # 0 stands for no word


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks of a batch: the rows, the first word of each, word hashes, anchors, runs, least runs."""
    for batch in batches:
        for start, stop in blocks(batch["text"]):
            part = batch.slice(start, stop - start)
            _, _, _, first, h = _words(part["text"])
            yield part, first, h, *anchors(h, first)


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, first, _, at, runs, _ in _texts(batches):
        text = np.searchsorted(first, at, side="right") - 1
        yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(text)), pa.array(runs[at].view(np.int64))], ["doc_id", "seed"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, first, h, at, runs, _ in _texts(batches):
        text = np.searchsorted(first, at, side="right") - 1
        for a in range(0, len(at), ROWS):
            some, row = at[a : a + ROWS], text[a : a + ROWS]
            around = mix(mix(surroundings(h, first, some) ^ _SALT[: WINDOW + REACH]).view(np.int64).sum(1).view(np.uint64))
            docs = part.select(_DOC).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*docs.columns, *[pa.array(v.view(np.int64)) for v in (runs[some], around)], pa.array((some - first[row]).astype(np.int32))],
                [*_DOC, "seed", "around", "at"],
            )


def _extension_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The extensions of the anchors listed in ``spots`` with each text, for the windows that chose the anchor."""
    for part, first, h, _, runs, low in _texts(batches):
        spots, count = part["spots"].flatten(), part["spots"].value_lengths().to_numpy()
        seed, around, at, n = (spots.field(i).to_numpy() for i in range(4))
        row = np.repeat(np.arange(len(part)), count)
        for a in range(0, len(at), ROWS):
            some = slice(a, a + ROWS)
            place = first[row[some]] + at[some]
            keys, own = extension_keys(surroundings(h, first, place)), own_windows(place, runs, low)
            lead = np.concatenate([[0], np.cumsum(own.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed[some]), pa.array(around[some]), pa.array(n[some]), part["doc_id"].take(pa.array(row[some])),
                 pa.array(own.argmax(1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(lead), pa.array(keys[own].view(np.int64)))],
                ["seed", "around", "n", "doc_id", "low", "keys"],
            )


def _grower(group: int):
    """How far each class repeats a class of a smaller document, for whole anchors in seed order; large ones pass with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["seed", "block"], rows=8192):
            hot = table["n"].to_numpy() > group
            if hot.any():
                some = table.filter(pa.array(hot)).select(["seed", "around", "doc_id", "low", "keys"]).combine_chunks()
                none = pa.nulls(len(some), pa.int32())
                yield from some.append_column("left", none).append_column("right", none).to_batches()
                table = table.filter(pa.array(~hot)).combine_chunks()
            if not len(table):
                continue
            keys = table["keys"].combine_chunks()
            size, key = keys.value_lengths().to_numpy(), keys.flatten().to_numpy()
            row = np.repeat(np.arange(len(table)), size)
            r = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size) + table["low"].to_numpy()[row]
            seed, doc = table["seed"].to_numpy()[row], table["doc_id"].to_numpy()[row]
            order = np.lexsort((doc, key, r, seed))
            row, r, key, seed, doc = (v[order] for v in (row, r, key, seed, doc))
            new = np.ones(len(row), bool)
            new[1:] = (key[1:] != key[:-1]) | (r[1:] != r[:-1]) | (seed[1:] != seed[:-1])
            hit = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else new
            left, right = np.full(len(table), -1), np.full(len(table), WINDOW)
            np.maximum.at(left, row[hit], r[hit])
            np.minimum.at(right, row[hit], r[hit])
            found = np.flatnonzero(left >= 0)
            some = table.select(["seed", "around"]).take(pa.array(found)).combine_chunks()
            for name in ("doc_id", "low", "keys"):
                some = some.append_column(name, pa.nulls(len(found), table.schema.field(name).type))
            ends = [pa.array(v[found].astype(np.int32)) for v in (left, WINDOW - right)]
            yield from some.append_column("left", ends[0]).append_column("right", ends[1]).to_batches()

    return run


def _extensions(classes: DataFrame, group: int) -> DataFrame:
    """``seed``, ``around``, ``left``, ``right`` of the classes that repeat a window of another class of a smaller document."""
    block = F.pmod(F.xxhash64("doc_id", "around"), F.ceil(F.col("n") / group).cast("bigint"))
    grown = spread(classes.withColumn("block", block), "seed", "block").sortWithinPartitions("seed", "block")
    grown = cut_lineage(grown.mapInArrow(_grower(group), "seed bigint, around bigint, doc_id bigint, low int, keys array<bigint>, left int, right int"))
    few = grown.where("keys IS NULL").select("seed", "around", "left", "right")
    keys = grown.where("keys IS NOT NULL").select("seed", "around", "doc_id", "low", F.posexplode("keys").alias("r", "key"))
    keys = keys.withColumn("r", F.col("r") + F.col("low")).drop("low")
    least = keys.groupBy("seed", "r", "key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    hits = keys.join(least.drop("most"), ["seed", "r", "key"]).where("doc_id > least")
    many = hits.groupBy("seed", "around").agg(F.max("r").alias("left"), (F.lit(WINDOW) - F.min("r")).cast("int").alias("right"))
    return few.unionByName(many)


def repeated_spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Maximal repeats as ``doc_id``, ``text_key`` (hash of the text), ``from``, ``to``: word places, 0-based, end exclusive.

    Spans lie around an anchor each, so those of one document overlap and are to be merged. ``docs`` has ``doc_id``
    (bigint), ``text_key`` and ``text``. Rows with a null ``doc_id`` have no spans and give none to others.
    """
    docs = docs.where("doc_id IS NOT NULL").select(*_DOC, "text")
    seeds = docs.select("doc_id", "text").mapInArrow(_seed_rows, "doc_id bigint, seed bigint")
    seeds = seeds.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    seeds = cut_lineage(seeds.select("seed"))  # as a stored table, so that the join below may split a hot seed
    found = docs.mapInArrow(_anchor_rows, "doc_id bigint, text_key bigint, seed bigint, around bigint, at int")
    found = cut_lineage(found.join(seeds, "seed"))
    classes = cut_lineage(
        found.groupBy("seed", "around").agg(F.min(F.struct(*_DOC, "at")).alias("one"), F.max("doc_id").alias("most"))
        .select("seed", "around", F.col("one.doc_id").alias("least"), "one.text_key", "one.at", "most")
    )
    mixed = classes.groupBy("seed").agg(F.count("*").alias("n"), F.min("least").alias("low"), F.max("least").alias("high"))
    ones = classes.join(mixed.where("low < high").select("seed", "n"), "seed")
    spots = ones.groupBy(F.col("least").alias("doc_id"), "text_key").agg(F.collect_list(F.struct("seed", "around", "at", "n")).alias("spots"))
    spots = cut_lineage(spots)
    listed = docs.join(broadcast_if_small(spots.select(*_DOC)), _DOC, "left_semi")  # where few texts are listed, only these travel
    extended = listed.join(spots, _DOC).select("doc_id", "text", "spots").mapInArrow(
        _extension_rows, "seed bigint, around bigint, n bigint, doc_id bigint, low int, keys array<bigint>"
    )
    grown = _extensions(extended, group)
    useful = classes.select("seed", "around", "least", "most").join(grown, ["seed", "around"], "left")
    useful = cut_lineage(useful.where("least < most OR left IS NOT NULL").drop("most"))
    whole = F.col("doc_id") > F.col("least")
    return (
        found.join(useful, ["seed", "around"])
        .where(whole | F.col("left").isNotNull())
        .select(
            *_DOC,
            F.greatest(F.col("at") - F.when(whole, REACH).otherwise(F.col("left")), F.lit(0)).alias("from"),
            (F.col("at") + F.when(whole, WINDOW).otherwise(F.col("right"))).alias("to"),
        )
    )


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in blocks(batch["text"]):
            part = batch.slice(start, stop - start)
            flat = Flat(part["text"])
            starts, ends, first = flat.words()
            spans = part["spans"].fill_null([])
            begin, end = (spans.flatten().field(i).to_numpy() for i in range(2))
            row = np.repeat(np.arange(len(part)), spans.value_lengths().to_numpy())
            step = np.zeros(len(starts) + 1, np.int32)
            np.add.at(step, first[row] + begin, 1)
            np.add.at(step, np.minimum(first[row] + end, first[row + 1]), -1)
            kept = np.cumsum(step[:-1]) == 0
            text = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
            last = np.full(len(part), -1)
            last[text[kept]] = np.flatnonzero(kept)  # of several the last assignment stays
            behind = ends + 1
            behind[last[last >= 0]] -= 1  # one character stands between words, none behind the last
            step = np.zeros(len(flat.data) + 2, np.int8)
            step[starts[kept]] = 1
            np.add.at(step, behind[kept], -1)
            mask = np.cumsum(step[: len(flat.data)], dtype=np.int8) > 0
            out = flat.data.copy()
            between = behind[kept] - 1
            out[between[between == ends[kept]]] = 0x20
            cuts = np.concatenate([[0], np.cumsum(mask)])[flat.offsets]
            raw = out[mask].tobytes()
            texts = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            n = np.diff(first)
            gone = n - np.bincount(text[kept], minlength=len(part))
            yield pa.RecordBatch.from_arrays(
                [*part.select(part.schema.names[:-2]).columns, pa.array(n), pa.array(gone), pa.array(texts, pa.binary()).cast(pa.string()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                [*part.schema.names[:-2], "n_words", "n_removed", "kept_text", "kept_sha256"],
            )


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), group: int = GROUP) -> DataFrame:
    """``keep``, ``n_words``, ``n_removed``, ``kept_text`` and ``kept_sha256`` of every row of ``docs`` (``doc_id`` bigint, ``text``).

    Words are runs other than space and 0x09 to 0x0D. Removed is every word inside ``WINDOW`` words that also stand in a
    row of a smaller ``doc_id``; ``kept_text`` joins the others by single spaces. Ties: rows of one id never remove
    each other, whatever their texts, and repeated rows give repeated rows. A null ``doc_id`` removes nothing and loses
    nothing. Null, empty and short texts (fewer than ``WINDOW`` words) lose nothing. A very long text is one row of one
    task, at some 15 times its bytes. An empty table gives an empty one. Other columns are only read if in ``keep``,
    under any name.
    """
    names = [f"_c{i}" for i in range(len(keep))]
    rows = docs.select(
        *[F.col("`" + c.replace("`", "``") + "`").alias(n) for n, c in zip(names, keep)],
        docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"),
    ).withColumn("text_key", F.xxhash64("text"))
    spans = repeated_spans(rows.select(*_DOC, "text"), group)
    spans = spans.groupBy(*_DOC).agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    fields = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + ["n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"])
    out = rows.join(spans, _DOC, "left").select(*names, F.coalesce("text", F.lit("")).alias("text"), "spans").mapInArrow(_without_spans, fields)
    return out.withColumnsRenamed(dict(zip(names, keep)))
