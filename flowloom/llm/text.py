"""Flat numpy views of Arrow text batches, shared by the operators that work on bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; one longer text is handled alone.
BLOCK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for bytes of a word: all but space and the control characters 0x09 to 0x0D.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: 8-byte pieces that are hashed at once.
PIECES = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Flat:
    """Texts of a batch as one byte array ``data`` with ``offsets`` (one more than texts)."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_string())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.data = raw[off[0] : off[-1]] if len(off) else raw[:0]
        self.offsets = off - off[0] if len(off) else np.zeros(1, np.int64)

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Flat:
        out = object.__new__(cls)
        out.data, out.offsets = data, offsets
        return out

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, inside: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the runs of ``inside`` bytes, and the first run of each text (one more than texts)."""
        word = inside[self.data]
        cut = np.zeros(len(word) + 1, bool)
        cut[self.offsets] = True
        before, after = np.empty_like(word), np.empty_like(word)
        before[:1], before[1:] = False, word[:-1]
        after[-1:], after[:-1] = False, word[1:]
        starts = np.flatnonzero(word & (~before | cut[:-1]))
        ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: its 8-byte pieces, each mixed with its place in the span before they are summed.

    Works on ``PIECES`` pieces at a time, so the memory beyond the result does not grow with the spans.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    lead = np.concatenate([[0], np.cumsum((size + 7) >> 3)])
    out = size.astype(np.uint64) * _ODD
    for low in range(0, int(lead[-1]), PIECES):
        high = min(low + PIECES, int(lead[-1]))
        s0, s1 = np.searchsorted(lead, low, side="right") - 1, np.searchsorted(lead, high, side="left")
        cut = np.clip(lead[s0 : s1 + 1], low, high)
        span = np.repeat(np.arange(s0, s1), np.diff(cut))
        place = np.arange(low, high) - lead[span]
        at = starts[span] + 8 * place
        spare = np.maximum(at + 8 - ends[span], 0).astype(np.uint64) * np.uint64(8)
        piece = at_byte[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> spare)
        out[s0:s1] += per_text(cut - low, mix(piece ^ mix((place + 1).astype(np.uint64) * _ODD)).view(np.int64)).view(np.uint64)
    return mix(out)


def window_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive items inside each text, and the first window number of each text.

    A text with fewer items, but some, gives one window of all of them.
    """
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    lead = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(lead[-1]) - np.repeat(lead[:-1] - first[:-1], count)
    size = np.repeat(np.minimum(n, width), count)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    out = size.astype(np.uint64)
    for k in range(width):
        out = mix(out * _ODD + np.where(k < size, padded[at + k], np.uint64(0)))
    return out, lead


def per_text(lead: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's range ``lead[i]:lead[i + 1]``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[lead[1:]] - total[lead[:-1]]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one longer text."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(size), 0
    while start < len(size):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield start, stop
        start = stop


def below_share(key: Column, rows: int, total: int) -> Column:
    """Whether a 64-bit hash is among the least, for about twice ``rows`` of ``total`` keys: thins out before a top-k."""
    share = min(1.0, 2 * rows / max(total, 1))
    return key <= F.lit(min(int(share * 2.0**64) - (1 << 63), (1 << 63) - 1))


def map_text(df: DataFrame, keep: list[str], fn: Callable[[pa.Array], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Applies ``fn`` to blocks of the column ``text``; ``keep`` columns go along, named as in ``schema`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, stop in blocks(texts):
                part = texts.slice(start, stop - start)
                out = fn(part)
                kept = [batch.column(i).slice(start, stop - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + list(out.values()), keep + list(out))

    kept = [F.col("`" + c.replace("`", "``") + "`").alias(f"_keep{i}") for i, c in enumerate(keep)]
    return df.select(*kept, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)
