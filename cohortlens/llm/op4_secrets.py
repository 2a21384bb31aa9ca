r"""Secret scan: keyword prefilter, anchored expressions near hits, checksum validation.

1. An Aho-Corasick automaton over the keywords of all kinds runs once over the
   text with A-Z lowered.  The hex kind has no keyword of its own; it is prefiltered by a scan
   for 32 characters of its class.
2. Each kind's expression is matched anchored at its hit only, left to right,
   from the end of the kind's previous match on (so the matches are the leftmost
   non-overlapping ones).
3. Kinds with an embedded checksum are validated by it: ``ghtoken`` (prefix,
   30 characters, CRC-32 of them in six base-62 digits) and ``npmtoken`` (same
   form).  A token whose checksum fails gives no span.

Spans are code points, end exclusive, of the whole match.  Defined results: a null or
empty text has no span; overlapping spans of different kinds all stay; repeated
rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Keywords and expressions of the kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GH_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
GH = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KINDS = ("assign", "access", "hex", "ghtoken", "npmtoken")
BASE_KINDS = KINDS[:3]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(payload: str) -> str:
    """CRC-32 of the payload in base 62, six digits."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _automaton():
    a = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("ghtoken", GH_WORDS), ("npmtoken", ("npm_",))):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_AUTO = None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All ``(kind, start, end)`` of one text, by start, then kind as listed."""
    global _AUTO
    if not text:
        return []
    if _AUTO is None:
        _AUTO = _automaton()
    # bytes.lower() touches A-Z only, so every code point keeps its place
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    spans, done = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _AUTO.iter(low))
    for at, kind in hits:
        if at < done[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "ghtoken": GH, "npmtoken": NPM}[kind].match(text, at)
        if not m:
            continue
        done[kind] = m.end()
        if kind == "assign":
            ok = len(m.group(1)) >= 8
        elif kind == "access":
            ok = m.end() - at >= 16
        else:
            ok = base62_crc(m.group(1)) == m.group(2)
        if ok:
            spans.append((kind, at, m.end()))
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                        ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            spans = find_spans(text)
            base = [s for s in spans if s[0] in BASE_KINDS]
            n = [sum(s[0] == k for s in base) for k in BASE_KINDS]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.record_batch([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, schema.types[1:]))], schema=schema)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCHEMA)
