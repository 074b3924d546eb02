"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, slices

#: The kinds of spans; those after hex are added by this method. The order breaks ties between spans.
KINDS = ("assign", "access", "hex", "forge", "registry", "jwt", "pem")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_FORGE = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_REGISTRY = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_PART = re.compile(rb"[A-Za-z0-9_-]*")
_PEM = re.compile(rb"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\x20\x09-\x0D]+)-----END \1-----")
#: Lower-cased keywords and the kind that each may begin.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge", "ghr_": "forge", "npm_": "registry", "eyj": "jwt", "-----begin ": "pem",
}
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_STEP = 8


def _base62_crc(body: bytes) -> bytes:
    n, out = binascii.crc32(body), b""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r : r + 1] + out
    return out


def _checked(span: bytes) -> bool:
    """Whether a token of 4 + 30 characters ends in the base-62 CRC-32 of those 30."""
    return _base62_crc(span[4:34]) == span[34:40]


def _header(span: bytes) -> bool:
    """Whether a token's first part is a base64url JSON object that names an algorithm."""
    part = span.split(b".")[0]
    try:
        head = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # a text may nest its JSON as deeply as it likes
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _der(body: bytes) -> bool:
    """Whether a key's base64 is a DER sequence of exactly the length that it states, or an OpenSSH key."""
    try:
        raw = base64.b64decode(b"".join(body.split()), validate=True)
    except ValueError:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    wide = raw[1] & 0x7F if raw[1] & 0x80 else 0
    stated = int.from_bytes(raw[2 : 2 + wide], "big") if wide else raw[1]
    return 2 + wide + stated == len(raw)


_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (_ACCESS, lambda m: len(m[0]) >= 20),
    "forge": (_FORGE, lambda m: _checked(m[0])),
    "registry": (_REGISTRY, lambda m: _checked(m[0])),
    "jwt": (_JWT, lambda m: _header(m[0])),
    "pem": (_PEM, lambda m: _der(m[2])),
}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def _hex_runs(text: bytes, least: int = 24) -> Iterator[tuple[int, int]]:
    """Maximal runs of least hex digits or more: each covers least // _STEP samples in a row, so only near those is it measured."""
    if len(text) < least:
        return
    data = np.frombuffer(text, np.uint8)
    sampled = _HEX[data[::_STEP]]
    need = least // _STEP
    near = sampled[: len(sampled) - need + 1].copy()
    for k in range(1, need):
        near &= sampled[k : len(sampled) - need + 1 + k]
    end = 0
    for s in (np.flatnonzero(near) * _STEP).tolist():
        if s < end:
            continue
        start, end = s, s
        while start and _HEX[text[start - 1]]:
            start -= 1
        while end < len(text) and _HEX[text[end]]:
            end += 1
        if end - start >= least:
            yield start, end


def scan(text: bytes, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start and then by kind.

    Every match of an expression begins with a keyword, so trying it at each hit from the left, beyond the end of the
    last match, finds what a scan of the whole text would: the leftmost matches that do not overlap."""
    found: list[tuple[str, int, int]] = []
    ends = dict.fromkeys(_RULES, 0)
    hits = [(end - n + 1, kind) for end, (n, kind) in keywords.iter(text.translate(LOWER).decode("latin-1"))]
    for start, kind in sorted(hits):
        if start < ends[kind]:
            continue
        rule, valid = _RULES[kind]
        if m := rule.match(text, start):
            ends[kind] = m.end()
            if valid(m):
                found.append((kind, start, m.end()))
        elif kind == "jwt":
            ends[kind] = _PART.match(text, start).end()  # what begins later in the same part fails alike
    found += [("hex", s, e) for s, e in _hex_runs(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _points(text: bytes, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets as code points, counted once from the left."""
    if not found or text.isascii():
        return found
    points, at, n = {}, 0, 0
    for b in sorted({x for _, s, e in found for x in (s, e)}):
        n += len(text[at:b].decode())
        points[b] = n
        at = b
    return [(k, points[s], points[e]) for k, s, e in found]


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with each span, or run of overlapping spans, replaced by [kind of the first]."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_OUT = pa.schema([("id", pa.int64()), ("secrets", pa.list_(_SPAN)), ("redacted", pa.string())])


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    for batch in slices(batches):
        spans, redacted = [], []
        for text in batch.column("text").to_pylist():
            raw = text.encode() if text else b""
            found = _points(raw, scan(raw, keywords))
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            redacted.append(redact(text, found) if found else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(_SPAN)), pa.array(redacted, pa.string())], schema=_OUT)


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, secrets (kind, start, end in code points, end exclusive) and redacted, the
    text without them (null where nothing was found).

    Keywords are looked for by one automaton over the text with A-Z lower-cased; the expressions are tried only where a
    keyword begins. Runs of hex digits have no keyword and are sampled instead. Spans with an embedded checksum or a
    structure (forge, registry, jwt, pem) count only if it holds.

    Cases: null and empty texts have no spans; repeated rows are scanned alike; whole texts of any length are scanned;
    an empty table gives an empty result; other columns are ignored. No shuffle."""
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ddl = "id bigint, secrets array<struct<kind: string, start: bigint, end: bigint>>, redacted string"
    return base.mapInArrow(_scanner, ddl).withColumnRenamed("id", id_col)
