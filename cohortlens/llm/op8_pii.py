r"""Personal data: pattern spans, and terms that disclose a protected entity.

Base spans (code points, end exclusive) are the leftmost non-overlapping matches of each kind
that pass the kind's check: e-mail addresses, IPv4 addresses, card numbers (Luhn), phone numbers.

Information-theoretic sanitisation adds the terms around them.  A protected entity is a value found
(one address, one number) and also each kind as a whole.  Over all documents

* ``IC(e) = -ln(n_e / N)`` is what knowing entity ``e`` tells,
* ``PMI(e, t) = ln(n_et N / (n_e n_t))`` is how much of it the term ``t`` discloses, ``n_et`` counting the
  documents with ``t`` among the ``CONTEXT`` terms before or after ``e``.

A term is a run of two or more letters outside every pattern span, compared in lower case, however far it
stands from the span; scripts without spaces have their terms between punctuation.  All four counts are of rows,
so a table written several times over has the same spans as one copy of it.

A term discloses an entity when ``PMI >= ALPHA * IC``, that is ``n_t <= n_et (N / n_e) ** (1 - ALPHA)``.
For a value one text is enough: beside a value that stands once, the terms of at most ``N ** (1 - ALPHA)``
documents disclose it.  A kind needs support from at least ``MIN_KIND_TEXTS`` different texts (copies of one
text are no evidence for it).  The occurrences of a disclosing term beside its entity become ``term`` spans.  ``sanitize`` generalises pattern spans to their kind and removes disclosing terms.

Defined results: a null or empty text has no spans; overlapping spans of different kinds all stay; a
term inside a pattern span adds none; repeated rows repeat; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from cohortlens.session import materialize

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 5
ALPHA = 0.8
MIN_KIND_TEXTS = 10
TERM = r"\p{L}{2,}"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = regex.compile(TERM)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches, found from their @ (linear also in long runs of address characters)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def find_base(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as listed, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def contexts(text: str, base) -> list[list[tuple[int, int]]]:
    """For each span the ``CONTEXT`` terms on either side as ``(start, end)``; terms that touch a span are none."""
    if not base:
        return []
    spans, terms, k, reach = sorted((s, e) for _, s, e in base), [], 0, -1
    for m in _TERM.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= a:
            terms.append((a, b))
    starts = [a for a, _ in terms]
    out = []
    for _, s, e in base:
        i, j = bisect_left(starts, s), bisect_left(starts, e)
        out.append(terms[max(0, i - CONTEXT):i] + terms[j:j + CONTEXT])
    return out


_SCAN = ("doc_id long, th long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
         "spans string, mentions array<struct<kind:string,value:string,terms:array<string>,at:array<int>>>")


def _scan(batches):
    mention = pa.struct([("kind", pa.string()), ("value", pa.string()), ("terms", pa.list_(pa.string())), ("at", pa.list_(pa.int32()))])
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("row", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()),
                        ("spans", pa.string()), ("mentions", pa.list_(mention))])
    for b in batches:
        cols: list[list] = [[] for _ in range(len(KINDS) + 3)]
        for text in b.column("text").to_pylist():
            base = find_base(text)
            for i, k in enumerate(KINDS):
                cols[i].append(sum(s[0] == k for s in base))
            cols[-3].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[-2].append(joined(base))
            found = []
            for (k, s, e), near in zip(base, contexts(text, base)):
                found.append({"kind": k, "value": text[s:e], "terms": [text[x:y] for x, y in near], "at": [x for x, _ in near]})
            cols[-1].append(found)
        yield pa.record_batch([b.column("doc_id"), b.column("th"), b.column("row"), *(pa.array(c, t) for c, t in zip(cols, schema.types[3:]))], schema=schema)


def _key(term):
    """A term by the hash of its lower case; both sides lower it by the same function, after it is cut out."""
    return F.xxhash64(F.lower(term))


def _mentioned(scanned: DataFrame) -> DataFrame:
    """``row, th, i, entity, is_kind, terms``: each mention as its value and as its kind."""
    value, kind = F.xxhash64("m.kind", "m.value"), F.xxhash64("m.kind")
    return (scanned.select("row", "th", F.posexplode("mentions").alias("i", "m"))
                   .select("row", "th", "i", F.col("m.terms").alias("terms"),
                           F.explode(F.array(F.struct(value.alias("entity"), F.lit(False).alias("is_kind")), F.struct(kind.alias("entity"), F.lit(True).alias("is_kind")))).alias("e"))
                   .select("row", "th", "i", "e.entity", "e.is_kind", "terms"))


def disclosing_terms(docs: DataFrame, scanned: DataFrame, alpha: float = ALPHA, min_kind_texts: int = MIN_KIND_TEXTS) -> DataFrame:
    """``(entity, term, ratio)``: terms (hashes) that disclose an entity (a value's hash, or a kind's)."""
    n_docs = max(1, scanned.count())
    near = _mentioned(scanned)
    entity = near.groupBy("entity").agg(F.count_distinct("row").alias("n_e"))
    with_t = (near.select("row", "th", "entity", "is_kind", F.explode(F.transform("terms", _key)).alias("term")).distinct()
                  .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.count_distinct("th").alias("texts"), F.max("is_kind").alias("is_kind"))
                  .where(~F.col("is_kind") | (F.col("texts") >= min_kind_texts)))
    with_t = materialize(with_t.join(entity, "entity"))
    if with_t.isEmpty():
        return with_t.select("entity", "term", F.lit(0.0).alias("ratio"))
    # the whole vocabulary is counted before the join: candidates grow with the corpus, and so would a join of its terms with them
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), _key))
    df = docs.where(F.col("text").isNotNull()).select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    pmi = F.log(F.col("n_et") * F.lit(float(n_docs)) / (F.col("n_e").cast("double") * F.col("n_t")))
    ic = -F.log(F.col("n_e") / F.lit(float(n_docs)))
    return (with_t.join(df, "term").withColumn("pmi", pmi).withColumn("ic", ic)
                  .where((F.col("ic") > 0) & (F.col("pmi") >= alpha * F.col("ic"))).select("entity", "term", (F.col("pmi") / F.col("ic")).alias("ratio")))


def _with_terms(docs: DataFrame, alpha: float) -> DataFrame:
    """The scan of every document with ``flags``: the disclosing terms beside its mentions, as (mention, term) places."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = materialize(docs.select("doc_id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(_scan, _SCAN))
    bad = disclosing_terms(docs, scanned, alpha)
    m = _mentioned(scanned).select("row", "i", "entity", F.posexplode(F.transform("terms", _key)).alias("j", "term"))
    flags = m.join(bad, ["entity", "term"]).groupBy("row").agg(F.collect_set(F.struct("i", "j")).alias("flags"))
    return scanned.join(flags, "row", "left")


def term_spans(mentions, flags) -> list[tuple[str, int, int]]:
    """Where the flagged terms stand beside their mentions, by start."""
    at = {(mentions[f["i"]]["at"][f["j"]], len(mentions[f["i"]]["terms"][f["j"]])) for f in flags or ()}
    return [("term", a, a + n) for a, n in sorted(at)]


def _parse(spans: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def _finish(batches):
    for b in batches:
        spans = []
        for base, mentions, flags in zip(b.column("spans").to_pylist(), b.column("mentions").to_pylist(), b.column("flags").to_pylist()):
            more = term_spans(mentions, flags)
            spans.append(",".join(x for x in (base, joined(more)) if x))
        yield pa.record_batch([*(b.column(c) for c in OUT[:-1]), pa.array(spans, pa.string())], names=OUT)


OUT = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def find_pii(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document."""
    return _with_terms(docs, alpha).mapInArrow(
        _finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitized(text: str | None, spans: str) -> str | None:
    """Pattern spans generalised to their kind, disclosing terms removed; the widest of overlapping spans counts."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(_parse(spans), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "" if kind == "term" else f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def sanitize(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, text`` with the found spans generalised or removed."""
    found = _with_terms(docs, alpha)
    spans = found.mapInArrow(_spans_by_text, "th long, spans string").where("spans <> ''").dropDuplicates(["th"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).join(spans, "th", "left")

    def run(batches):
        for b in batches:
            out = [sanitized(t, s or "") for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return texts.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def _spans_by_text(batches):
    for b in batches:
        for out in _finish([b]):
            yield pa.record_batch([b.column("th"), out.column("spans")], names=["th", "spans"])
