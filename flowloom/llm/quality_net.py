"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into blocks of ``BLOCK`` bytes; chunks of two neighbouring blocks overlap by half and
cover the whole text. Each byte gives a learned vector, and each block how well its bytes match those 1 to ``LAGS``
bytes before. Learned filters over a chunk's inputs are rectified, max-pooled over all chunks of the text, and a
logistic layer combines them into the probability of label 1.

The network is fitted on the driver from at most ``max_rows`` labelled texts (those with the least hash of their id)
of at most ``max_bytes`` together; everything else runs inside Arrow batches, one block of texts at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.text import Flat, below_share, map_text

BLOCK, LAGS, DIM, FILTERS = 16, 32, 4, 16
#: Zero blocks after each text: no lag reaches into the text before.
PAD = LAGS // BLOCK
WIDTH = BLOCK * DIM + LAGS
_BYTE_SUM = np.uint64(0x0101010101010101)


@dataclass
class Net:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # 2 x WIDTH x FILTERS: over a chunk's first and second block
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    out_bias: np.ndarray  # 1

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]


def fresh_net(seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    f = np.float32
    return Net(
        rng.normal(0, 0.5, (256, DIM)).astype(f), rng.normal(0, 0.1, (2, WIDTH, FILTERS)).astype(f), np.zeros(FILTERS, f),
        rng.normal(0, 0.3, FILTERS).astype(f), np.zeros(1, f),
    )


def byte_blocks(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks (n x BLOCK bytes), their lag matches (n x LAGS, 0 to 1), and the first block of each text (one more).

    A text has at least one block, and ``PAD`` zero blocks after it.
    """
    size = np.diff(flat.offsets)
    count = np.maximum(-(-size // BLOCK), 1) + PAD
    lead = np.concatenate([[0], np.cumsum(count)])
    data = np.zeros((lead[-1] + PAD) * BLOCK, np.uint8)
    shift = (lead[:-1] + PAD) * BLOCK
    data[np.arange(len(flat.data)) + np.repeat(shift - flat.offsets[:-1], size)] = flat.data
    body = data[LAGS:]
    match = np.empty((LAGS, lead[-1]), np.float32)
    written = body != 0
    for lag in range(1, LAGS + 1):
        same = (body == data[LAGS - lag : len(data) - lag]) & written
        eight = (same.view(np.uint64) * _BYTE_SUM) >> np.uint64(56)
        match[lag - 1] = eight.reshape(-1, 2).sum(1)
    match /= BLOCK
    return body.reshape(-1, BLOCK), (match**3).T, lead


def _inputs(net: Net, byte: np.ndarray, match: np.ndarray) -> np.ndarray:
    return np.concatenate([net.embed[byte].reshape(len(byte), -1), match], axis=1)


def _pooled(net: Net, x: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Largest rectified response of each filter over each text's chunks."""
    both = x @ np.concatenate([net.filters[0], net.filters[1]], axis=1)
    r = both[:, :FILTERS].copy()
    r[:-1] += both[1:, FILTERS:]
    # a chunk starts at each block of the text; the zero blocks after it start none
    cut = np.stack([lead[:-1], lead[1:] - PAD], 1).reshape(-1)
    return np.maximum(np.maximum.reduceat(r, cut, axis=0)[::2] + net.bias, 0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(net: Net, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text; a null or empty text counts as one block of zeros."""
    byte, match, lead = byte_blocks(Flat(texts))
    pooled = _pooled(net, _inputs(net, byte, match), lead)
    return _sigmoid(pooled.astype(np.float64) @ net.out + net.out_bias[0])


def fit(texts: list[str], labels: list[int], epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Net:
    """Logistic loss by Adam; a filter's gradient flows through the chunk that gave its maximum."""
    net, rng = fresh_net(seed), np.random.default_rng(seed)
    y_all = np.array(labels, np.float32)
    share = (y_all.sum() + 1) / (len(y_all) + 2)
    net.out_bias[0] = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    column = pa.array(texts, pa.string())
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            part, step = order[at : at + batch], step + 1
            grads = _gradient(net, column.take(pa.array(part)), y_all[part])
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for p, g, (m, v) in zip(net.params(), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _gradient(net: Net, texts: pa.Array, y: np.ndarray) -> list[np.ndarray]:
    byte, match, lead = byte_blocks(Flat(texts))
    x = _inputs(net, byte, match)
    both = x @ np.concatenate([net.filters[0], net.filters[1]], axis=1)
    r = both[:, :FILTERS].copy()
    r[:-1] += both[1:, FILTERS:]
    best = np.stack([a + r[a : b - PAD].argmax(0) for a, b in zip(lead[:-1], lead[1:])])  # text x filter
    top = np.take_along_axis(r, best, 0) + net.bias
    pooled = np.maximum(top, 0)
    error = (_sigmoid(pooled @ net.out + net.out_bias[0]) - y) / len(y)
    d = error[:, None] * net.out[None, :] * (top > 0)  # text x filter
    g_filters = np.empty_like(net.filters)
    g_embed = np.zeros_like(net.embed)
    for half in (0, 1):
        rows = best + half
        g_filters[half] = np.einsum("tfw,tf->wf", x[rows], d)
        back = np.einsum("tf,wf->tfw", d, net.filters[half][: BLOCK * DIM]).reshape(-1, BLOCK, DIM)
        for k in range(DIM):
            g_embed[:, k] += np.bincount(byte[rows].reshape(-1), back[..., k].reshape(-1), 256)
    decay = 1e-4
    return [g_embed + decay * net.embed, g_filters + decay * net.filters, d.sum(0), pooled.T @ error + decay * net.out, error.sum(keepdims=True)]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, a fifth of all."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 64 << 20) -> Net:
    """The network fitted on a bounded sample of labelled rows that are not held out.

    The sample is the ``max_rows`` ids of least hash; texts are taken in that order, passing over those with which the
    sum would be above ``max_bytes``. Labelled texts of which none fits are an error.
    Null labels, ids and texts are left out; of an id with several labels the greatest counts, of one with several
    texts the least. Rows are thinned out by the hash before they are put in order.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(3), "doc_id")
    few = known.where(below_share(order, max_rows, known.agg(F.countDistinct("doc_id")).first()[0]))
    chosen = few.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(order, "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    seen, total, texts, marks = 0, 0, [], []
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # ids bounded by max_rows
    rows = rows.withColumn("text", F.when(F.octet_length("text") <= max_bytes, F.col("text")))
    for r in rows.orderBy(order, "doc_id").toLocalIterator():
        seen += 1
        size = max_bytes + 1 if r["text"] is None else len(r["text"].encode())
        if total + size > max_bytes:
            continue
        total += size
        texts.append(r["text"])
        marks.append(int(r["quality"]))
    if seen and not texts:
        raise ValueError(f"none of {seen} labelled texts has at most {max_bytes} bytes")
    return fit(texts, marks)


def score_quality(docs: DataFrame, net: Net, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) of every row's whole text.

    Null and empty texts get the score of one empty block. Equal texts, and so repeated rows, get equal scores; a score
    that ties with ``threshold`` is predicted 1. Null ids are kept like others. A very long text is one row of one task,
    at some 50 times its bytes. An empty table gives an empty one; columns that are not in ``keep`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few kB: fixed by the layer sizes

    def one(texts: pa.Array) -> dict[str, pa.Array]:
        p = scores(shared.value, texts)
        return {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return map_text(docs, keep, one, ", ".join([*fields, "score double", "predicted int"]))
