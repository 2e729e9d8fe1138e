"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures, confirmed on the full sets.

A document's set holds its distinct 5-word shingles; equal sets are one class. Each class has a signature of ``m``
chunks of ``WIDTH`` MinHash values cut to 16 bits. Two signatures that differ in at most ``2 m - 1`` values differ in
at most one value of some chunk (pigeonhole), so the keys "chunk without its i-th value" bring all such pairs into a
common bucket. ``m`` is the least number for which a pair at the similarity threshold differs in more values with a
probability of at most ``MISS`` (13 chunks for 0.85).

No pair is emitted inside a bucket: blocks of a bucket compare signatures in numpy and give a spanning forest. Its
components (clusters of signatures within the distance) are then compared on full shingle sets, again in blocks, and
the confirmed links' forest gives the components. Buckets with the same members are compared once, classes of equal
sets take part as one member. A large bucket or cluster is cut into blocks that each get its smallest member too: what
hangs together with that one there is settled, and only the rest is compared with the other blocks, so no task holds a
group and the rows of a group of near copies grow with its size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.grouped import Forest, group_links
from flowloom.llm.text import LOWER, Flat, map_text, mix, per_text, span_hashes, window_hashes
from flowloom.operators.components import connected_components
from flowloom.session import broadcast_if_small, cut_lineage

SHINGLE_WORDS = 5
WIDTH = 5
MISS = 2e-6
#: Members of a bucket block, and shingles of a cluster block.
BUCKET_BLOCK = 2048
SHINGLE_BLOCK = 1 << 17
_FACTOR = np.random.default_rng(85).integers(0, 1 << 63, 60 * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.random.default_rng(86).integers(0, 1 << 63, (2, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chunks_for(percent: int) -> int:
    """Chunks for which a pair of that similarity is beyond the signature distance with probability ``MISS`` at most."""
    differ = 1 - percent / 100
    for m in range(2, len(_FACTOR) // WIDTH + 1):
        n = m * WIDTH
        if sum(math.comb(n, k) * differ**k * (1 - differ) ** (n - k) for k in range(2 * m, n + 1)) <= MISS:
            return m
    raise ValueError("similarities of 75 percent and more are supported")


def max_errors(chunks: int) -> int:
    return 2 * chunks - 1


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the first of each text (one more than texts)."""
    flat = Flat(texts)
    starts, ends, first = flat.words()
    sh, lead = window_hashes(span_hashes(LOWER[flat.data], starts, ends), first, SHINGLE_WORDS)
    for a, b in zip(lead[:-1].tolist(), lead[1:].tolist()):
        sh[a:b].sort()
    new = np.ones(len(sh), bool)
    new[1:] = sh[1:] != sh[:-1]
    new[lead[:-1][np.diff(lead) > 0]] = True
    return sh[new], np.concatenate([[0], np.cumsum(new)])[lead]


def set_keys(sets: np.ndarray, lead: np.ndarray) -> pa.Array:
    """A 128-bit fingerprint of each set (all zero for an empty one)."""
    parts = [per_text(lead, mix(sets ^ salt).view(np.int64)) for salt in (np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5))]
    raw = np.stack([*parts, np.diff(lead)], 1).astype("<i8").tobytes()
    return pa.array([raw[i : i + 24] for i in range(0, len(raw), 24)], pa.binary())


def signatures(sets: np.ndarray, lead: np.ndarray, slots: int) -> np.ndarray:
    """MinHash values of each set, cut to 16 bits; zeros for an empty set."""
    full = np.flatnonzero(np.diff(lead))
    out = np.zeros((len(lead) - 1, slots), np.uint16)
    if len(full):
        for k in range(slots):
            low = np.minimum.reduceat(sets * _FACTOR[k], lead[full])
            out[full, k] = mix(low).astype(np.uint16)
    return out


def _signer(slots: int):
    def sign(texts: pa.Array) -> dict[str, pa.Array]:
        sets, lead = shingle_sets(texts)
        raw, wide = signatures(sets, lead, slots).tobytes(), 2 * slots
        return {
            "n_shingles": pa.array(np.diff(lead)),
            "set_key": set_keys(sets, lead),
            "sig": pa.array([raw[i : i + wide] for i in range(0, len(raw), wide)], pa.binary()),
        }

    return sign


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """As many keys as values for each row: each chunk with each one of its values left out."""
    rows, slots = sig.shape
    chunk = sig.reshape(rows, slots // WIDTH, WIDTH).astype(np.uint64)
    term = mix((chunk + np.uint64(1)) * _WORD[0]) * _WORD[1]
    left = term.sum(axis=2, keepdims=True) - term  # by wrapping sums, one value taken out
    which = np.arange(slots, dtype=np.uint64).reshape(1, -1, WIDTH)
    return mix(left + which * np.uint64(0x9E3779B97F4A7C15)).reshape(rows, slots)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _bucket_keys(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            keys = chunk_keys(_matrix(b.column(1)))
            rep = np.repeat(b.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(rep)], ["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key bigint, rep bigint")


def _near_signatures(group: pa.Table) -> list[tuple]:
    """Stars of the trees of near signatures: the smallest id in front, so that blocks agree on their hubs."""
    group = group.sort_by("rep")
    rep, side, cross = group["rep"].to_numpy(), group["side"].to_numpy(), group["lo"][0] != group["hi"][0]
    sig = _matrix(group["sig"].combine_chunks())
    forest, limit = Forest(len(rep)), max_errors(sig.shape[1] // WIDTH)
    for i in range(len(rep) - 1):
        if cross and side[i]:
            continue
        near = (sig[i + 1 :] != sig[i]).sum(1) <= limit if not cross else ((sig != sig[i]).sum(1) <= limit) & (side == 1)
        for j in np.flatnonzero(near).tolist():
            forest.join(i, j if cross else j + i + 1)
    return forest.links(rep)


def _linker(percent: int):
    def linked(group: pa.Table) -> list[tuple]:
        """Stars of the trees that the links between a block's documents make, on their full sets."""
        group = group.sort_by("rep")
        sets, lead = shingle_sets(group["text"].combine_chunks())
        keys = set_keys(sets, lead).to_pylist()
        rep, side, cross = group["rep"].to_numpy(), group["side"].to_numpy(), group["lo"][0] != group["hi"][0]
        size = np.diff(lead)
        _, number = np.unique(sets, return_inverse=True)
        mark = np.zeros(len(sets), bool)
        real = np.array([k == w for k, w in zip(keys, group["set_key"].to_pylist())])  # another text under that id
        forest = Forest(len(rep))
        for i in range(len(rep)):
            if not real[i] or (cross and side[i]):
                continue
            own = number[lead[i] : lead[i + 1]]
            mark[own] = True
            start = 0 if cross else i + 1
            both = per_text(lead[start:] - lead[start], mark[number[lead[start] :]])
            mark[own] = False
            ok = (100 * both >= percent * (size[start:] + size[i] - both)) & real[start:]
            if cross:
                ok &= side == 1
            for j in (np.flatnonzero(ok) + start).tolist():
                forest.join(i, j)
        return forest.links(rep)

    return linked


def near_duplicates(docs: DataFrame, percent: int = 85, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` (and ``keep``) of every row of ``docs`` (``doc_id`` bigint, ``text``).

    Linked are documents with 100 * intersection >= ``percent`` * union of their shingle sets. ``component_id`` is the smallest id reachable by links; ``kept`` where
    it is the row's own. A null or wordless text has an empty set and its own component. A row without id links with
    nothing: ``component_id`` null, ``kept`` true. Repeated rows give repeated rows; ties (equal sets) are one class, named by
    its smallest id, and texts that share an id share a component. A very long text is one row of one task, at some 15 times
    its bytes. An empty table gives an empty one. Other columns are not read unless in ``keep``.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)]
    schema = ", ".join([*fields, "n_shingles bigint", "set_key binary", "sig binary"])
    signed = cut_lineage(map_text(docs, ["doc_id", *keep], _signer(WIDTH * chunks_for(percent)), schema))
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")
    )
    # an id that stands on several texts stands for each of their sets, so its texts share a component
    classes = cut_lineage(classes)
    roots = _components(docs.select("doc_id", "text"), classes, percent)
    rep = classes.join(roots, classes.rep == roots.node, "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    got = signed.select("doc_id", *keep, "n_shingles", "set_key").join(rep, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return got.select("doc_id", *keep, "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _components(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    keys = _bucket_keys(classes)
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("members")).where("n > 1")
    buckets = buckets.groupBy("n", "members").agg(F.min("key").alias("key"))
    near = keys.join(buckets.select("key"), "key")
    large = buckets.where(F.col("n") > BUCKET_BLOCK).select("key", F.ceil(F.col("n") / BUCKET_BLOCK).alias("_blocks"))
    edges = group_links(near, "key", "rep", large, lambda rows: rows.join(classes.select("rep", "sig"), "rep"), _near_signatures)
    clusters = connected_components(edges).withColumnRenamed("node", "rep").withColumnRenamed("root", "cluster")
    members = clusters.join(classes.select("rep", "set_key", "n_shingles"), "rep")
    weight = members.groupBy("cluster").agg(F.sum("n_shingles").alias("weight"))
    members = cut_lineage(members.join(weight, "cluster"))
    large = weight.where(F.col("weight") > SHINGLE_BLOCK).select("cluster", F.ceil(F.col("weight") / SHINGLE_BLOCK).alias("_blocks"))

    def with_texts(rows: DataFrame) -> DataFrame:
        listed = broadcast_if_small(rows.select("rep").distinct())  # where few texts are asked for, only these travel
        texts = docs.withColumnRenamed("doc_id", "rep").join(listed, "rep", "left_semi")
        return texts.join(rows, "rep").select("cluster", "lo", "hi", "side", "rep", "set_key", "text")

    links = group_links(members.select("cluster", "rep", "set_key"), "cluster", "rep", large, with_texts, _linker(percent))
    return connected_components(links)
