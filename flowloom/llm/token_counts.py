"""Token counts of sections by offset-mapped attribution.

A whole text is encoded once with a byte-level tokenizer; a running sum of the tokens' byte lengths gives their spans.
Sections are spans of the same text, and both are joined by sorted search inside the block. A token that crosses a
section's border goes to the section that holds its first byte (rule ``first``), or each section gets the share of the
token's bytes that lies in it (rule ``split``); either way the sections and gaps of a text add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.text import Flat, blocks

RULES = ("first", "split")
SECTIONS = "array<struct<name:string,start:bigint,end:bigint>>"


@lru_cache(maxsize=2)
def load_encoding(path: str, pattern: str):
    """A byte-level encoding and the byte length of each token, from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for raw, rank in ranks.items():
        size[rank] = len(raw)
    return tiktoken.Encoding("flowloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def token_ends(texts: list[str], encoding, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of each token in the bytes of all texts joined, and the first token of each text (one more than texts)."""
    ids = [encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    return np.cumsum(size[flat]), np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)


def line_spans(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end byte of each line; a line holds the line feed that ends it."""
    feeds = np.flatnonzero(flat.data == 10) + 1
    ends = np.unique(np.concatenate([feeds, flat.offsets[1:][np.diff(flat.offsets) > 0]]))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    return np.searchsorted(flat.offsets, starts, side="right") - 1, starts, ends


def given_spans(flat: Flat, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """The same for given sections in code points, cut to the text, and their names; sections may not overlap."""
    head = np.append(np.flatnonzero((flat.data & 0xC0) != 0x80), len(flat.data))
    first = np.searchsorted(head, flat.offsets)
    rows = [
        (i, first[i] + min(max(s["start"] or 0, 0), n), first[i] + min(max(s["end"] or 0, s["start"] or 0, 0), n), s["name"])
        for i, (n, spans) in enumerate(zip(np.diff(first).tolist(), column.to_pylist()))
        for s in sorted((s for s in spans or [] if s is not None), key=lambda s: (s["start"] or 0, s["end"] or 0, s["name"] or ""))
    ]
    text, a, b = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    if (b[:-1] > a[1:])[text[1:] == text[:-1]].any():
        raise ValueError("sections of a text overlap")
    return text, head[a], head[b], [r[3] for r in rows]


def attribute(ends: np.ndarray, starts_at: np.ndarray, ends_at: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross one of its borders, from token and section spans."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    low, high = np.searchsorted(starts, starts_at), np.searchsorted(starts, ends_at)  # tokens that begin inside
    before = np.searchsorted(ends, starts_at, side="right")  # first token that ends inside
    crossing = np.where(ends_at > starts_at, (low > before).astype(np.int64) + ((high > low) & (ends[np.maximum(high - 1, 0)] > ends_at)), 0) if len(ends) else high
    if rule == "first":
        return (high - low).astype(np.float64), crossing

    def share(at: np.ndarray) -> np.ndarray:
        """Tokens before a byte, with the part of a token that lies before it."""
        k = np.minimum(np.searchsorted(ends, at, side="right"), len(ends) - 1)
        return k + (at - starts[k]) / (ends[k] - starts[k])

    return (share(ends_at) - share(starts_at) if len(ends) else np.zeros(len(starts_at))), crossing


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """``doc_id``, ``section`` (0-based, by place), ``name``, ``start``, ``size`` (bytes), ``n_tokens``, ``n_crossing``, ``text_tokens``.

    One row per section of every row of ``docs``: the text's lines, or those in the column ``sections`` (``SECTIONS``,
    code points, without overlaps; spans are cut to the text). ``n_tokens`` is a double; under ``first`` it is whole.
    What lies in no section is a last row with section -1 if it has tokens. A null or empty text has one row, section
    -1, without tokens. Repeated rows give repeated rows and null ids are kept like others; a token that starts where a
    section does lies in it. A very long text is one row of one task. An empty table gives an empty one; other columns are
    not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "section", "name", "start", "size", "n_tokens", "n_crossing", "text_tokens"]
    given = [F.col(sections).cast(SECTIONS).alias("sections")] if sections else []

    def block(batch: pa.RecordBatch, a: int, b: int) -> pa.RecordBatch:
        encoding, size = load_encoding(path, pattern)
        texts = pc.fill_null(batch.column(1).slice(a, b - a), "")
        flat = Flat(texts)
        ends, lead = token_ends(texts.to_pylist(), encoding, size)
        if sections:
            text, s, e, name = given_spans(flat, batch.column(2).slice(a, b - a))
        else:
            text, s, e = line_spans(flat)
            name = [None] * len(text)
        n, crossing = attribute(ends, s, e, rule)
        total = np.diff(lead)
        rest = total - np.bincount(text, n, minlength=len(total))
        extra = np.flatnonzero((rest > 1e-6) | ((total == 0) & (np.bincount(text, minlength=len(total)) == 0)))
        number = np.arange(len(text)) - np.searchsorted(text, text)
        doc = np.concatenate([text, extra])
        gap = np.zeros(len(extra), np.int64)
        columns = [
            batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(np.concatenate([number, gap - 1]).astype(np.int64)),
            pa.array(name + [None] * len(extra), pa.string()), pa.array(np.concatenate([s - flat.offsets[text], gap])),
            pa.array(np.concatenate([e - s, gap])), pa.array(np.concatenate([n, rest[extra]]).astype(np.float64)),
            pa.array(np.concatenate([crossing, gap]).astype(np.int64)), pa.array(total[doc].astype(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                yield block(batch, a, b)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *given)
    return rows.mapInArrow(run, f"doc_id {doc_type}, section bigint, name string, start bigint, size bigint, n_tokens double, n_crossing bigint, text_tokens bigint")
