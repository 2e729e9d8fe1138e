"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The texts of a block become one flat array of symbols, cut into words where a space follows another character (no
piece of the vocabulary spans such a cut). Equal words are encoded once. A round finds each word's least pair rank,
merges its leftmost pair of that rank in all words at once, and compacts the array; words without a pair leave it.
Words of more than ``LONG_WORD`` characters are first cut wherever no piece holds the two characters side by side; what
is still long keeps its pairs in a heap, because a round per merge would cost the square of its length.

Vocabulary and scores come from the model file at a given path; the merges, byte fallback and decoding are done here.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from flowloom.llm.text import Flat, mix, map_text, span_hashes

SPACE = "▁"
#: Characters of a word from which the heap takes over.
LONG_WORD = 96
#: A pair's rank and the id it makes share one number.
ID_BITS = 22
ID_MASK = np.int64((1 << ID_BITS) - 1)
NO_PAIR = np.int64(1 << 60)


class PieceModel:
    """Tables of a BPE model file: characters, mergeable pairs, ranks and the bytes of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bos, self.eos, self.unk, self.size = sp.bos_id(), sp.eos_id(), sp.unk_id(), size
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece goes on after a space: words can't be cut there")
        symbol = {pieces[i]: i for i in plain}
        for ch in sorted({c for i in plain for c in pieces[i]} - set(symbol)):
            symbol[ch] = size + len(symbol)  # part of pieces, but no piece itself
        self.symbols = max(symbol.values()) + 1
        chars = sorted((ord(s), i) for s, i in symbol.items() if len(s) == 1)
        self.char_code, self.char_id = (np.array(x, np.int64) for x in zip(*chars))
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_char[self.char_code] = self.char_id
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        pairs, beside = [], set()
        for i in plain:
            p = pieces[i]
            beside.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                left, right = symbol.get(p[:cut]), symbol.get(p[cut:])
                if left is not None and right is not None:
                    pairs.append((left * self.symbols + right, i, order[sp.get_score(i)]))
        pairs.sort()
        self.pair_key, self.pair_id, self.pair_rank = (np.array(x, np.int64) for x in zip(*pairs))
        slots = 1 << (len(pairs) * 4).bit_length()
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.beside = np.unique(np.array([(ord(a) << 21) | ord(b) for a, b in beside], np.int64))
        self._hash_pairs(slots)
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        raw = [b"" if sp.is_control(i) else bytes([int(pieces[i][3:5], 16)]) if sp.is_byte(i) else
               " ⁇ ".encode() if sp.is_unknown(i) else pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.silent = np.array([sp.is_control(i) for i in range(size)])
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.starts_space = np.array([not sp.is_byte(i) and not sp.is_control(i) and pieces[i].startswith(SPACE) for i in range(size)])

    def _hash_pairs(self, slots: int) -> None:
        """An open-addressed table of pair keys: a lookup is a few gathers, not a search."""
        table = np.full(slots, -1, np.int64)
        left = np.arange(len(self.pair_key))
        at = self._slot(self.pair_key)
        while len(left):
            free = table[at] < 0
            table[at[free]] = left[free]
            stay = table[at] != left
            left, at = left[stay], (at[stay] + 1) & (slots - 1)
        self.table_key = np.where(table >= 0, self.pair_key[table], -1)
        self.table_value = np.where(table >= 0, (self.pair_rank[table] << ID_BITS) | self.pair_id[table], NO_PAIR)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair as one number, the rank above ``ID_BITS``; ``NO_PAIR`` where none merges."""
        key = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * self.symbols + right)
        at = self._slot(key)
        got = self.table_key[at]
        hit = got == key
        out = np.where(hit, self.table_value[at], NO_PAIR)
        todo = np.flatnonzero(~hit & (got >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.table_key) - 1)
            got = self.table_key[at]
            hit = got == key[todo]
            out[todo[hit]] = self.table_value[at[hit]]
            more = ~hit & (got >= 0)
            todo, at = todo[more], at[more]
        return out

    def merge_words(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words and the first symbol of each word, from character symbols."""
        words = len(first) - 1
        word = np.repeat(np.arange(words, dtype=np.int32), np.diff(first))
        done_sym, done_word = [], []
        pair = self._pairs(sym, word, np.arange(len(sym)))
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(start, len(sym)))
            least = np.minimum.reduceat(pair, start)
            live = least < NO_PAIR
            if not live.all():  # words without a pair are ready
                going = np.repeat(live, size)
                done_sym.append(sym[~going])
                done_word.append(word[~going])
                sym, word, pair = sym[going], word[going], pair[going]
                if not len(sym):
                    break
                least, size = least[live], size[live]
            at = np.flatnonzero(pair <= np.repeat(least | ID_MASK, size))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]  # the leftmost of each word
            sym[at] = pair[at] & ID_MASK
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, word, pair = sym[keep], word[keep], pair[keep]
            for near in (at, np.maximum(at - 1, 0)):
                pair[near] = self._pairs(sym, word, near)
        sym = np.concatenate(done_sym) if done_sym else sym
        word = np.concatenate(done_word) if done_word else word
        order = np.argsort(word, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=words))]).astype(np.int64)

    def _pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(sym) - 1)
        same = (after > at) & (word[after] == word[at])
        return self.find(np.where(same, sym[at], -1), sym[after])

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The same merges for one long word, by a heap of (rank, place)."""
        n = len(sym)
        s, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        pair = _PairMap(self)
        heap = [(v >> ID_BITS, i, s[i], s[i + 1], v & ID_MASK) for i, v in enumerate(self.find(sym[:-1], sym[1:]).tolist()) if v < NO_PAIR]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j], after[i] = m, -2, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (got := pair.get(s[x], s[y])):
                    heapq.heappush(heap, (got[0], x, s[x], s[y], got[1]))
        return np.array([x for x in s if x != -2], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids without begin and end, and the first id of each text (one more than texts)."""
        texts = pc.fill_null(texts, "")
        full = pc.greater(pc.binary_length(texts), 0)
        texts = pc.if_else(full, pc.binary_join_element_wise(" ", texts, ""), texts)
        flat = Flat(texts)
        data = flat.data
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(flat) + 1, np.int64)
        head = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
        code = _code_points(data, head)
        code[code == ord(SPACE)] = 0x20  # a space is written as that sign, so they are the same symbol
        text_at = np.searchsorted(head, flat.offsets)
        begins = np.zeros(len(code), bool)
        begins[text_at[:-1][np.diff(text_at) > 0]] = True
        gap = code == 0x20
        begins[1:] |= gap[1:] & ~gap[:-1]
        code[gap] = ord(SPACE)
        starts = np.flatnonzero(begins)
        text_word = np.searchsorted(starts, text_at)
        ends = np.append(starts[1:], len(code))
        if (ends - starts > LONG_WORD).any():
            cut = ~np.isin((code[:-1] << 21) | code[1:], self.beside)
            in_long = np.repeat(ends - starts > LONG_WORD, ends - starts)
            begins[1:] |= cut & in_long[1:] & in_long[:-1]
            starts = np.flatnonzero(begins)
            text_word = np.searchsorted(starts, text_at)
            ends = np.append(starts[1:], len(code))
        # equal words are encoded once: same bytes have the same two hashes and the same length
        byte_at = np.append(head, len(data))
        key = span_hashes(data, byte_at[starts], byte_at[ends])
        check = np.add.reduceat(mix(code.astype(np.uint64) + np.uint64(17)) * (np.arange(len(code)) - np.repeat(starts, ends - starts) + 3).astype(np.uint64), starts)
        key = mix(key + mix(check + (ends - starts).astype(np.uint64)))
        _, seen, which = np.unique(key, return_index=True, return_inverse=True)
        size = (ends - starts)[seen]
        sym = self._symbols(code)
        short = np.flatnonzero(size <= LONG_WORD)
        first = np.concatenate([[0], np.cumsum(size[short])])
        gather = np.arange(first[-1]) + np.repeat(starts[seen[short]] - first[:-1], size[short])
        out, out_at = self._finish(*self.merge_words(sym[gather], first), code[gather], first)
        parts, count = [out], np.zeros(len(seen), np.int64)
        count[short] = np.diff(out_at)
        place = np.zeros(len(seen), np.int64)
        place[short] = out_at[:-1]
        total = len(out)
        for k in np.flatnonzero(size > LONG_WORD):
            span = slice(starts[seen[k]], ends[seen[k]])
            got, _ = self._finish(m := self.merge_long(sym[span]), np.array([0, len(m)]), code[span], np.array([0, len(code[span])]))
            parts.append(got)
            count[k], place[k] = len(got), total
            total += len(got)
        pool = np.concatenate(parts)
        each = count[which]
        lead = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.arange(lead[-1]) + np.repeat(place[which] - lead[:-1], each)]
        return ids, lead[text_word]

    def _symbols(self, code: np.ndarray) -> np.ndarray:
        return self.of_char[code]

    def _finish(self, sym: np.ndarray, first: np.ndarray, code: np.ndarray, code_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids: characters that are no piece become their UTF-8 bytes."""
        odd = (sym < 0) | (sym >= self.size)
        if not odd.any():
            return sym, first
        # odd symbols are single characters; within a word they stand in the order of its odd characters
        known = self._symbols(code)
        unit = np.repeat(np.arange(len(sym)), np.where(odd, 1, 0))
        lone = self._lone_codes(sym, odd, known, code, first, code_first)
        raw = [chr(c).encode() for c in lone.tolist()]
        size = np.ones(len(sym), np.int64)
        size[unit] = [len(b) for b in raw]
        lead = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(lead[-1], np.int64)
        out[lead[:-1][~odd]] = sym[~odd]
        out[np.repeat(odd, size)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return out, lead[first]

    def _lone_codes(self, sym, odd, known, code, first, code_first) -> np.ndarray:
        made_of_piece = np.full(self.symbols, 0, np.int64)
        chars = dict(zip(self.char_id.tolist(), self.char_code.tolist()))
        if (sym[odd] >= self.size).any():
            back = np.array([chars.get(x, 0) for x in range(self.size, self.symbols)], np.int64)
            made_of_piece[self.size :] = back
        out = np.where(sym >= self.size, made_of_piece[np.maximum(sym, 0)], 0)
        out[sym < 0] = code[known < 0]  # unknown characters never merge, so they keep their order
        return out[odd]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: pieces joined, one leading space taken off, byte runs read as UTF-8."""
        out = []
        size = np.diff(self.piece_at)[ids]
        lead = np.concatenate([[0], np.cumsum(size)])
        data = self.piece_bytes[np.arange(lead[-1]) + np.repeat(self.piece_at[:-1][ids] - lead[:-1], size)].tobytes()
        lead = lead.tolist()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            raw = data[lead[a] : lead[b]]
            if not _is_utf8(raw) or self.silent[ids[a + 1 : b - 1]].any():  # pieces are whole characters: a run of bytes is not
                raw = self._mixed(ids[a:b])
            at = a
            while at < b and size[at] == 0:
                at += 1
            out.append(raw[1:] if at < b and self.starts_space[ids[at]] else raw)
        return out

    def _mixed(self, ids: np.ndarray) -> bytes:
        """Bytes of pieces; in a run of byte pieces every byte that is no part of a character becomes U+FFFD."""
        byte = self.is_byte[ids]
        cut = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1], [True]]))
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            raw = b"".join(self.piece_bytes[self.piece_at[i] : self.piece_at[i + 1]].tobytes() for i in ids[a:b].tolist())
            out.append(_each_bad_byte(raw) if byte[a] else raw)
        return b"".join(out)


class _PairMap:
    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def get(self, a: int, b: int) -> tuple[int, int] | None:
        if (a, b) not in self.known:
            value = int(self.model.find(np.array([a]), np.array([b]))[0])
            self.known[a, b] = (value >> ID_BITS, value & ID_MASK) if value < NO_PAIR else None
        return self.known[a, b]


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _each_bad_byte(raw: bytes) -> bytes:
    if _is_utf8(raw):
        return raw
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode().encode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


def _code_points(data: np.ndarray, head: np.ndarray) -> np.ndarray:
    size = np.diff(np.append(head, len(data)))
    lead = data[head].astype(np.int64)
    code = np.where(size == 1, lead, lead & (0xFF >> (size + 1)))
    for k in (1, 2, 3):
        at = np.flatnonzero(size > k)
        code[at] = (code[at] << 6) | (data[head[at] + k] & 0x3F)
    return code


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_texts(docs: DataFrame, model_path: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """Token ids of every ``text`` with begin and end ids, and what they decode to.

    Returns the ``keep`` columns, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (lower-case hex; ids as
    little-endian unsigned 32-bit integers), and with ``with_ids`` also ``ids`` and ``decoded``. A null or empty text
    has the begin and end ids only and decodes to the empty text. Equal rows give equal rows, null ids are kept
    like others, and of equal ranks the leftmost pair is merged first. A very long text is one row of one task, at some 70
    times its bytes. An empty table gives an empty one; other columns of ``docs`` do not matter. ``model_path`` must be readable on every executor.
    """
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    fields += ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"]
    fields += ["ids array<int>", "decoded string"] if with_ids else []

    def one(texts: pa.Array) -> dict[str, pa.Array]:
        model = load_model(model_path)
        ids, first = model.encode(texts)
        n = len(first) - 1
        at = first + 2 * np.arange(n + 1)  # room for begin and end
        full = np.empty(len(ids) + 2 * n, np.int64)
        inner = np.ones(len(full), bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        full[inner], full[at[:-1]], full[at[1:] - 1] = ids, model.bos, model.eos
        raw, cut = full.astype("<u4").tobytes(), at.tolist()
        text = model.decode(full, at)
        out = {
            "n_tokens": pa.array(np.diff(at)),
            "ids_sha256": pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string()),
        }
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(full.astype(np.int32)))
            out["decoded"] = pa.array([t.decode() for t in text], pa.string())
        return out

    return map_text(docs, keep, one, ", ".join(fields))
