"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(ascii_lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def components(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> (n_shingles, component_id, kept), by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where: dict = {}
    for d in sorted(sets):
        shared: dict = {}
        for s in sets[d]:
            for o in where.setdefault(s, []):
                shared[o] = shared.get(o, 0) + 1
            where[s].append(d)
        for o, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                up[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def contamination(docs: list[tuple], items: list[tuple], width: int = 10) -> list[tuple]:
    """Rows of find_contamination."""
    norm = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def words(text):
        return norm.findall(ascii_lower(text or ""))

    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(len(v), width)
            for i in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at] == v[i] and w[at : at + n] == v[i : i + n]:
                        hit.update(range(at, at + n))
                        found.add(item_id)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Pattern spans without the shortcuts: every match is found first and failing ones are dropped."""
    flags = re.IGNORECASE | re.ASCII
    assign = re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, flags)
    out = [(m.start(), 0, m.end()) for m in assign if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def rule_counts(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {i for i, t in enumerate(triples) if triples.count(t) > 1} if len(set(triples)) < len(triples) else set()
    repeated = len({i + k for i in twice for k in range(3)})
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated,
        len(w) < 50 or 100 * repeated > 50 * len(w),
    )


def attribution(lengths: list[int], spans: list[tuple[int, int]], rule: str) -> list[tuple[float, int]]:
    """(tokens, crossing tokens) of each span."""
    ends = [sum(lengths[: i + 1]) for i in range(len(lengths))]
    tokens = list(zip([0, *ends[:-1]], ends))
    out = []
    for a, b in spans:
        touch = [(s, e) for s, e in tokens if s < b and e > a]
        n = sum(a <= s < b for s, _ in tokens) if rule == "first" else sum((min(e, b) - max(s, a)) / (e - s) for s, e in touch)
        out.append((n, sum(s < a < e for s, e in touch) + sum(s >= a and s < b < e for s, e in touch)))
    return out


def without_repeats(rows, window=50):
    """(n_words, n_removed, kept text) of each (doc_id, text), by looking at every window."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i : i + window])
                least[key] = min(doc, least.get(key, doc))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and least[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
