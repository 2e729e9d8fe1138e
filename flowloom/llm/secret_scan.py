"""Secret scan: pattern spans, and base64 or hex candidates confirmed by the structure of what they decode to.

A candidate counts only if it parses: a private key in DER (a sequence whose nested lengths fill it exactly, that
starts with a version number or names a password-based encryption), an OpenSSH private key (magic and length-prefixed fields), or a signed token (three
parts, of which the header and payload are JSON objects and the header names an algorithm). The least token,
``{"alg":"none"}`` with an empty payload, has ``RUN`` characters.

A key is put together over line breaks, real or escaped, with blanks, quote marks or comment marks beside them, over
escaped slashes and over the quotes that join source strings; one in hex also over blanks, colons, commas, hyphens,
``0x`` and ``\\x``. Lines may have any length. Not joined: base64 over blanks alone, percent or entity codes, dumps with
offsets or another column. A token must stand in one piece.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowloom.llm.text import Flat, map_text, per_text

# The patterns, in the order in which their kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")

# A key's first characters, from anywhere in a run: DER opens with 0x30 and a length, OpenSSH with its magic.
_BREAK = r"\\[nrt]?|[\r\n\f\v]"
_BESIDE = r"""["'][\x20\t]*[+.,](?=[\x20\t]*[\r\n])|[\x20\t"'>|#*]"""
_JOINED = f"(?:{_BESIDE})*(?:{_BREAK})(?:{_BESIDE}|{_BREAK})*"
_JOIN64 = re.compile(_JOINED)
_PIECE64 = re.compile(r"[A-Za-z0-9+/_-]+")
_START64 = re.compile(f"M(?:{_JOINED})?[A-I]|b(?:{_JOINED})?3(?:{_JOINED})?B")
_OPENS64 = re.compile(r"(?=M[A-I]|b3Bl)")
_APART = r"""(?:\\[nrtx]?|0[xX](?=[0-9A-Fa-f])|[\s:,+"'>|#*-])"""
_JOINHEX = re.compile(f"{_APART}+", re.ASCII)
_PIECEHEX = re.compile(r"[0-9A-Fa-f]+")
_STARTHEX = re.compile(f"3{_APART}*0{_APART}*[0-8]|6{_APART}*[Ff]{_APART}*7{_APART}*0", re.ASCII)
_OPENSHEX = re.compile(r"(?=30[0-8]|6[Ff]70)")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{8,}|ew[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.[A-Za-z0-9_-]*")
#: Without one of these a text has no assignment.
_WORDS = ("passw", "secret", "token", "api_key", "apikey")
#: Hex and tokens hold a run of that many of these bytes; keys may be wrapped in shorter lines.
RUN = 24
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-.="]] = True
_MAGIC = b"openssh-key-v1\0"
#: Object identifiers of password-based encryption begin so (PKCS 5 and PKCS 12).
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: Bytes of the least key that counts, and the most values of its outer sequence: an RSA key has 9, others fewer. So a
#: start that is no key costs a fixed number of steps, whatever length it claims.
LEAST_KEY = 16
MOST_ITEMS = 16


def der_items(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill ``raw[at:end]`` exactly; None if a length does not fit or they are too many."""
    out = []
    while at < end:
        if at + 2 > end or len(out) == MOST_ITEMS:
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(raw[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def der_end(raw: bytes, at: int = 0) -> int | None:
    """End of the DER private key that starts at ``raw[at]``; None if none does.

    One sequence: version 0 or 1 first, then numbers (RSA), an algorithm (PKCS 8) or octets (EC); or, encrypted (PKCS 8),
    an algorithm of password-based encryption and octets. Its outer length says where it ends.
    """
    if raw[at : at + 1] != b"\x30" or at + 2 > len(raw):
        return None
    body, size = at + 2, raw[at + 1]
    if size & 0x80:
        body += size & 0x7F
        if not 1 <= size & 0x7F <= 4 or body > len(raw):
            return None
        size = int.from_bytes(raw[at + 2 : body], "big")
    end = body + size
    items = der_items(raw, body, end) if end <= len(raw) and raw[body : body + 1] in (b"\x02", b"\x30") else None
    if not items or len(items) < 2:
        return None
    tags = [t for t, _, _ in items]
    if tags[0] == 0x30:
        inner = der_items(raw, *items[0][1:])
        named = bool(inner) and inner[0][0] == 0x06 and raw[inner[0][1] : inner[0][2]].startswith(_PBE)
        return end if named and tags == [0x30, 0x04] else None
    if raw[items[0][1] : items[0][2]] not in (b"\0", b"\1"):
        return None
    if tags[1] == 0x30:
        inner = der_items(raw, *items[1][1:])
        known = bool(inner) and inner[0][0] == 0x06 and len(tags) > 2 and tags[2] == 0x04
    else:
        known = tags[1] == 0x04 or (tags[1] == 0x02 and len(tags) >= 6 and set(tags) == {0x02})
    return end if known else None


def openssh_end(raw: bytes, at: int = 0) -> int | None:
    """End of the OpenSSH private key that starts at ``raw[at]``; None if none does.

    Magic, then cipher, derivation and options as length-prefixed fields, the key count and a public key; then, where
    they are there, the other public keys and the private part. A private part that is cut off has the rest of ``raw``.
    """
    if not raw.startswith(_MAGIC, at):
        return None
    at += len(_MAGIC)
    fields = 5
    k = 0
    while k < fields:
        if at + 4 > len(raw):
            return at if k > 4 else None
        size = int.from_bytes(raw[at : at + 4], "big")
        if k == 3:  # the number of keys is no length
            if not 1 <= size <= 16:
                return None
            fields, at = 5 + size, at + 4
        elif at + 4 + size <= len(raw):
            at += 4 + size
        elif k > 4:
            return len(raw) if size < 1 << 16 else at
        else:
            return None
        k += 1
    return at


def is_key_der(raw: bytes) -> bool:
    """Whether a DER private key fills ``raw``."""
    return der_end(raw) == len(raw)


def is_key_openssh(raw: bytes) -> bool:
    """Whether ``raw`` starts with an OpenSSH private key."""
    return openssh_end(raw) is not None


def _decode64(text: str) -> bytes:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _bytes64(text: str) -> bytes:
    """All whole bytes of a run of base64 characters of any length."""
    return base64.b64decode(text + "A" * (-len(text) % 4), b"-_")[: len(text) * 3 // 4]


def is_token(header: str, payload: str) -> bool:
    for k, part in enumerate((header, payload)):
        try:
            found = json.loads(_decode64(part))
        except (ValueError, RecursionError):
            return False
        if not isinstance(found, dict) or (k == 0 and not isinstance(found.get("alg"), str)):
            return False
    return True


def _key_at(raw: bytes, at: int) -> tuple[str, int] | None:
    """Kind and end of the key that starts at ``raw[at]``."""
    for kind, end in (("der", der_end(raw, at)), ("openssh", openssh_end(raw, at))):
        if end is not None and end - at >= LEAST_KEY:
            return kind, end
    return None


def _run(text: str, start: int, piece: re.Pattern, join: re.Pattern) -> tuple[str, list[int], list[int], int]:
    """Pieces from ``start`` over joins: their characters, where each piece starts in those and in ``text``, and the end."""
    parts, lead, place, at, n = [], [], [], start, 0
    while m := piece.match(text, at):
        parts.append(m[0])
        lead.append(n)
        place.append(at)
        n, end = n + len(m[0]), m.end()
        if not (gap := join.match(text, end)):
            break
        at = gap.end()
    return "".join(parts), lead, place, end


def _keys(text: str, hexa: bool) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the keys in base64 or hex.

    A key may start anywhere in a run and ends where its own lengths say; the scan goes on behind it. A run is decoded
    once for each place that its characters can have in a byte, so no start copies the rest of it.
    """
    start, piece, join, opens = (_STARTHEX, _PIECEHEX, _JOINHEX, _OPENSHEX) if hexa else (_START64, _PIECE64, _JOIN64, _OPENS64)
    per, size = (2, 1) if hexa else (4, 3)  # so many characters are so many bytes
    out, at = [], 0
    while m := start.search(text, at):
        chars, lead, place, at = _run(text, m.start(), piece, join)
        if len(chars) * size < LEAST_KEY * per:
            continue
        in_text = lambda i: place[k := bisect_right(lead, i) - 1] + i - lead[k]
        decoded, behind = {}, 0
        for o in opens.finditer(chars):
            if (i := o.start()) < behind:
                continue
            shift = i % per
            if shift not in decoded:
                whole = chars[shift : len(chars) - (len(chars) - shift) % 2] if hexa else chars[shift:]
                decoded[shift] = bytes.fromhex(whole) if hexa else _bytes64(whole)
            begin = (i - shift) // per * size
            if found := _key_at(decoded[shift], begin):
                behind = i - (begin - found[1]) * per // size  # rounded up: the last character may hold bits that are not used
                end = in_text(behind - 1) + 1
                end += 0 if hexa else len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
                out.append((in_text(i), KINDS.index(found[0]), end))
    return out


def base_spans(text: str, has_run: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns alone, per kind leftmost and without overlaps."""
    out = []
    if (":" in text or "=" in text) and any(w in text.lower() for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)] if has_run else []
    return sorted(out)


def confirmed_spans(text: str, has_run: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of decoded candidates that parse; without a run there is no token, but wrapped keys."""
    out = {*_keys(text, False), *_keys(text, True)}
    for m in _TOKEN.finditer(text) if has_run else ():
        if len(m[0]) >= RUN and is_token(m[1], m[2]):
            out.add((m.start(), KINDS.index("jwt"), m.end()))
    return sorted(out)


def with_runs(flat: Flat) -> np.ndarray:
    """Which texts hold a run of ``RUN`` candidate bytes: the hex and token patterns need not look at the others."""
    starts, ends, first = flat.words(_RUN_BYTES)
    return per_text(first, ends - starts >= RUN) > 0


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end and b > a:
            out += [text[at:a] if at < a else "", mark]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """Secrets in every row's whole text, in code points, end exclusive.

    Returns the ``keep`` columns, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (of the pattern spans),
    ``spans`` (all, by start, then kind) and with ``with_text`` the ``redacted`` text (null where the text is null). A
    null or empty text has no spans. Ties: of base spans that start together, kinds stand in the order of ``KINDS``, and per
    kind the leftmost wins. Null ids are kept like others and repeated rows give repeated rows. A very long text is one row
    of one task, in time that grows with its length. An empty table gives an empty one; other columns are not read.
    """
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    fields += ["n_assign bigint", "n_access bigint", "n_hex bigint", "base_sha256 string", "spans string"]
    fields += ["redacted string"] if with_text else []

    def one(texts: pa.Array) -> dict[str, pa.Array]:
        rows = []
        for text, run in zip(texts.to_pylist(), with_runs(Flat(texts)).tolist()):
            base = base_spans(text or "", run)
            every = sorted(base + confirmed_spans(text or "", run))
            count = [sum(k == i for _, k, _ in base) for i in range(3)]
            row = [*count, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)]
            rows.append([*row, None if text is None else redact(text, every)] if with_text else row)
        names = [f.split()[0] for f in fields[len(keep) :]]
        kinds = [pa.int64()] * 3 + [pa.string()] * (len(names) - 3)
        columns = list(zip(*rows)) or [[]] * len(names)
        return {n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)}

    return map_text(docs, keep, one, ", ".join(fields))
