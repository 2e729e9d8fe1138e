"""Quality rules as a short-circuit cascade.

Every text is counted (words, symbols, repeated lines and windows). Further rules then look only at texts that no
earlier rule has rejected. Before the run each rule's cost and share of rejections are measured on a bounded sample,
and the rules are ordered by rejections per cost. The order changes the work, never the verdict: a text is kept if no
rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.text import Flat, below_share, map_text, mix, per_text, span_hashes, window_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 3


def _lut(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


_SYMBOL = _lut(lambda b: b in SYMBOLS)
_UPPER = _lut(lambda b: 65 <= b <= 90)
_LETTER = _lut(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80)
_ASCII_LETTER = _lut(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
_IN_LINE = _lut(lambda b: b != 10)
_HEAD = _lut(lambda b: b & 0xC0 != 0x80)


class Texts:
    """A block of texts with what the rules share."""

    def __init__(self, column: pa.Array):
        self.flat = Flat(column)
        self.starts, self.ends, self.first = self.flat.words()
        self.n_words = np.diff(self.first)

    def subset(self, rows: np.ndarray) -> Texts:
        """These texts alone; their words are not cut again."""
        if len(rows) == len(self.flat):
            return self
        out, old = object.__new__(Texts), self.flat.offsets
        size = np.diff(old)[rows]
        lead = np.concatenate([[0], np.cumsum(size)])
        pieces = [self.flat.data[a:b] for a, b in zip(old[rows].tolist(), old[rows + 1].tolist())]
        out.flat = self.flat.of(np.concatenate(pieces) if pieces else self.flat.data[:0], lead)
        out.n_words = self.n_words[rows]
        out.first = np.concatenate([[0], np.cumsum(out.n_words)])
        word = np.arange(out.first[-1]) + np.repeat(self.first[rows] - out.first[:-1], out.n_words)
        shift = np.repeat(lead[:-1] - old[rows], out.n_words)
        out.starts, out.ends = self.starts[word] + shift, self.ends[word] + shift
        return out

    def in_spans(self, lut: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(lut[self.flat.data], dtype=np.int64)])
        return total[ends] - total[starts]

    def counts(self) -> dict[str, np.ndarray]:
        texts = self.flat.offsets[:-1], self.flat.offsets[1:]
        return {
            "n_words": self.n_words,
            "word_chars": per_text(self.first, self.in_spans(_HEAD, self.starts, self.ends)),
            "n_symbols": self.in_spans(_SYMBOL, *texts),
            "n_dup_lines": self._dup_lines(),
            "n_repeat_words": self._repeat_words(),
        }

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the lines that hold a word."""
        a, b, first = self.flat.words(_IN_LINE)
        text = np.repeat(np.arange(len(self.flat)), np.diff(first))
        some = np.searchsorted(self.starts, b) > np.searchsorted(self.starts, a)
        return a[some], b[some], text[some]

    def _dup_lines(self) -> np.ndarray:
        a, b, text = self.lines()
        key = mix(span_hashes(self.flat.data, a, b) + mix(text.astype(np.uint64)))
        _, at = np.unique(key, return_index=True)
        n = len(self.flat)
        return np.bincount(text, minlength=n) - np.bincount(text[at], minlength=n)

    def _repeat_words(self) -> np.ndarray:
        h, lead = window_hashes(span_hashes(self.flat.data, self.starts, self.ends), self.first, WINDOW)
        text = np.repeat(np.arange(len(self.flat)), np.diff(lead))
        _, which, count = np.unique(mix(h + mix(text.astype(np.uint64))), return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[which] > 1)
        at = twice - lead[text[twice]] + self.first[text[twice]]
        hit = np.zeros(len(self.starts), bool)
        for k in range(WINDOW):
            hit[at + k] = True
        return per_text(self.first, hit)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts, dict[str, np.ndarray]], np.ndarray]


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def _symbols(t: Texts, c: dict[str, np.ndarray]) -> np.ndarray:
    return 2 * c["n_symbols"] > c["n_words"]


def _word_length(t: Texts, c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 14 * c["n_words"])


def _dup_lines(t: Texts, c: dict[str, np.ndarray]) -> np.ndarray:
    _, _, text = t.lines()
    return 10 * c["n_dup_lines"] > 7 * np.bincount(text, minlength=len(t.flat))


def _capitals(t: Texts, c: dict[str, np.ndarray]) -> np.ndarray:
    texts = t.flat.offsets[:-1], t.flat.offsets[1:]
    return 2 * t.in_spans(_UPPER, *texts) > t.in_spans(_ASCII_LETTER, *texts)


def _letterless(t: Texts, c: dict[str, np.ndarray]) -> np.ndarray:
    with_letter = per_text(t.first, t.in_spans(_LETTER, t.starts, t.ends) > 0)
    return 10 * with_letter < 7 * t.n_words


RULES = (
    Rule("symbols", _symbols), Rule("word_length", _word_length), Rule("dup_lines", _dup_lines),
    Rule("capitals", _capitals), Rule("letterless", _letterless),
)


def order_rules(texts: list[str], rules: tuple[Rule, ...] = RULES, repeats: int = 3) -> list[Rule]:
    """Rules by rejections per second on the sample; rules that reject nothing there stand last, cheap ones first."""
    column = pa.array(texts, pa.string())
    t = Texts(column)
    counts, rank = t.counts(), []
    for k, rule in enumerate(rules):
        took = []
        for _ in range(repeats):
            start = time.perf_counter()
            rejected = rule.rejects(t, counts).sum()
            took.append(time.perf_counter() - start)
        cost = max(min(took), 1e-9)
        rank.append((-(rejected / cost), cost, k))
    return [rules[k] for _, _, k in sorted(rank)]


def sample_texts(docs: DataFrame, rows: int = 200) -> list[str]:
    """At most ``rows`` distinct texts of least hash, none above 100,000 characters: only for costs and selectivities.

    Rows are thinned out by their hash first, and equal texts meet map-side, so no task sends more than its few.
    """
    text = docs.select(F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    few = text.where(below_share(F.col("h"), rows, docs.count()) & F.col("text").isNotNull() & (F.length("text") < 100_000))
    return [r["text"] for r in few.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(rows).collect()]


def judge(texts: pa.Array, rules: list[Rule]) -> dict[str, np.ndarray]:
    """Counts of each text, ``base_failed`` and ``kept``; each rule sees the texts that are still kept."""
    part = Texts(texts)
    counts = part.counts()
    failed = base_failed(counts)
    alive, good = np.arange(len(failed)), ~failed
    for rule in rules:
        part, alive = part.subset(np.flatnonzero(good)), alive[good]
        if not len(alive):
            break
        good = ~rule.rejects(part, {k: v[alive] for k, v in counts.items()})
    alive = alive[good] if len(alive) else alive
    kept = np.zeros(len(failed), bool)
    kept[alive] = True
    return {**counts, "base_failed": failed, "kept": kept}


def apply_rules(docs: DataFrame, keep: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """``keep`` columns, the counts, ``base_failed`` and ``kept`` of every row's whole text.

    A null, empty or wordless text has no words, so it fails the base rule. Equal texts and repeated rows get equal rows, so
    ties need no rule; null ids are kept like others. A very long text is one row of one task, at some 30 times its bytes.
    An empty table gives an empty one; other columns of ``docs`` are not read unless in ``keep``. ``rules`` defaults to all, ordered on a sample of ``docs``.
    """
    ordered = order_rules(sample_texts(docs)) if rules is None else rules
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields += [f"{n} bigint" for n in numbers] + ["base_failed boolean", "kept boolean"]

    def one(texts: pa.Array) -> dict[str, pa.Array]:
        got = judge(texts, ordered)
        return {n: pa.array(got[n].astype(np.int64)) for n in numbers} | {n: pa.array(got[n]) for n in ("base_failed", "kept")}

    return map_text(docs, keep, one, ", ".join(fields))
