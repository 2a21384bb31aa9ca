"""op11, op12 and op13 against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import op11_search, op12_neardup, op13_merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score long, rank int, t string, i long, n long, item_id long"
WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, *[None] * 6) for i, t, lang, s, n in rows], DOCS)


# -- op11 --------------------------------------------------------------------------------------

def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_search(rows, items, top=10):
    found = [(i, WORD.findall(lower_ascii(t))) for i, t in rows if t]
    found = [(i, ts) for i, ts in found if ts]
    n_docs, total = len(found), sum(len(ts) for _, ts in found)
    df = Counter(t for _, ts in found for t in set(ts))
    out = []
    for item, text in items:
        scores = []
        for i, ts in found:
            tf, m = Counter(ts), 25 + 75 * len(ts) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                    for t in WORD.findall(lower_ascii(text or "")) if t in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


ODD = [(1, "The cat sat. THE CAT! é É İstanbul naïve_x", None, "a", 1), (2, None, "en", "a", 2), (3, "", "en", None, None), (4, " \n!!", "en", "b", 3),
       (5, "the the the dog", "en", "a", 4), (5, "the the the dog", "en", "a", 4), (6, "the the the dog", "en", "b", 4), (None, "the the the dog", "en", "a", 4),
       (7, "dog\u0000cat \U0001F600 cat2cat", "en", "a", 4), (8, "word " * 30_000 + "cat", "en", "a", 4)]


@pytest.mark.parametrize("block, short, batch", [(16_384, 1 / 32, 500_000), (7, 0.5, 5), (64, 0.0, 40)])
def test_search_equals_brute_force(spark, block, short, batch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = ODD + [(10 + k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(1, 120))), "en", "s", 0) for k in range(300)]
    items = [(1, "The dog and the w3 w3 w59 w40"), (2, None), (3, ""), (4, "w0 w1 w2"), (5, "nothing of it"), (6, "é cat CAT cat2cat"), (6, "é cat CAT cat2cat"), (None, "w7 dog")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op11_search.search(docs(spark, rows).repartition(5), bench, block=block, short=short, batch_terms=batch)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search([(r[0], r[1]) for r in rows], dict.fromkeys(items))


def test_search_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert op11_search.search(docs(spark, []), bench).count() == 0
    assert op11_search.search(docs(spark, ODD), bench.limit(0)).count() == 0
    assert op11_search.search(docs(spark, [(1, None, None, None, None), (2, "!", None, None, None)]), bench).count() == 0


# -- op12 --------------------------------------------------------------------------------------

def brute_links(rows, threshold):
    ok = [e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e in rows]
    v = [np.array(e, dtype=float) if k else None for (_, e), k in zip(rows, ok)]
    v = [x / np.abs(x).max() if x is not None else None for x in v]
    n, up, deg = len(rows), list(range(len(rows))), [0] * len(rows)

    def root(a):
        while up[a] != a:
            a = up[a]
        return a
    for a in range(n):
        for b in range(a):
            if v[a] is not None and v[b] is not None and len(v[a]) == len(v[b]) and v[a] @ v[b] / (math.sqrt(v[a] @ v[a]) * math.sqrt(v[b] @ v[b])) >= threshold:
                deg[a] += 1
                deg[b] += 1
                up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i, deg[a], least.get(root(a)), i is not None and least[root(a)] == i) for a, (i, _) in enumerate(rows)), key=repr)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, e, 0, None, None) for i, e in rows], f"vec_id long, embedding array<{kind}>, label int, node long, w long")


@pytest.mark.parametrize("tile, kind, threshold", [(4096, "double", 0.9), (16, "float", 0.9), (5, "double", 0.7), (8, "double", -0.2)])
def test_near_duplicates_equal_brute_force(spark, tile, kind, threshold):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    x = [centres[k % 8] + rng.normal(size=12) * (0.02 if k % 3 == 0 else 0.3) for k in range(150)] + [rng.normal(size=12) for _ in range(60)]
    x = [v.astype(np.float32).astype(float).tolist() for v in x]
    copies = [x[0]] * 40 + [(np.array(x[1]) * 2).tolist()]
    odd = [None, [], [0.0] * 12, [float("nan")] + x[0][1:], [float("inf")] + x[0][1:], x[0][:11], x[0][:11], x[0] + [0.0], [None] + x[0][1:], [-v for v in x[0]]]
    if kind == "double":
        odd += [[1e300] * 12, [1e-300] * 12]
    rows = [(k * 3 % 1009, e) for k, e in enumerate(x + copies + odd)] + [(5, x[2]), (5, x[2]), (None, x[3]), (None, [9.0] + [0.0] * 11)]
    got = op12_neardup.near_duplicates(vectors(spark, rows, kind).repartition(4), threshold, tile=tile)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_links(rows, threshold)


def test_a_tight_ball_costs_no_comparison(spark, monkeypatch):
    """A ball of near copies, dealt to many leaves: whole leaves link by weights, the result is the brute force's."""
    rng = np.random.default_rng(1)
    ball = np.eye(8)[0] + rng.normal(size=(300, 8)) * 0.004
    rows = [(k, v.tolist()) for k, v in enumerate(np.vstack([ball, rng.normal(size=(100, 8))]))]
    got = op12_neardup.near_duplicates(vectors(spark, rows), 0.9, tile=20)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_links(rows, 0.9)


def test_near_duplicates_of_empty_and_void_tables(spark):
    assert op12_neardup.near_duplicates(vectors(spark, [])).count() == 0
    got = op12_neardup.near_duplicates(vectors(spark, [(1, None), (2, [0.0]), (None, None)])).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)], key=repr)


def test_bound_keeps_every_link_at_any_cut():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(40, 16)), 5, axis=0) + rng.normal(size=(200, 16)) * 0.2
    u = op12_neardup.unit(x)
    rot = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    size = np.full(200, 16)
    for first in (1, 4, 8, 16):
        mask = np.vstack([m for _, m in op12_neardup.linked(x, x, size, size, rot, first, 0.9)])
        close = np.abs(u @ u.T - 0.9) < 1e-12
        assert ((mask == (u @ u.T >= 0.9)) | close).all()


# -- op13 --------------------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    leaf = lambda r: sha(*map(field, (r[0], r[3], r[2], r[4], r[1])))
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[3], []).append(r)

    def reduce(hashes):
        """Tops and, per node, its siblings by level."""
        paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
        while len(level) > 1:
            for p, k in zip(paths, at):
                run = level[k // 16 * 16:k // 16 * 16 + 16]
                p.append((k % 16, run[:k % 16] + run[k % 16 + 1:]))
            at = [k // 16 for k in at]
            level = [sha(*level[s:s + 16]) for s in range(0, len(level), 16)]
        return level[0], paths
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = [reduce([leaf(r) for r in groups[s]]) for s in names]
    root, over = reduce([t for t, _ in tops])
    out = []
    for s, (top, paths), more in zip(names, tops, over):
        for r, p in zip(groups[s], paths):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = lower_ascii(text)
            h = leaf((r[0], text, *r[2:]))
            for pos, sib in p + more:
                h = sha(*sib[:pos], h, *sib[pos:])
            out.append((r[0], leaf(r), top, root, sha(*[x for _, sib in p + more for x in sib]), h, h == root))
    return sorted(out, key=repr)


def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@pytest.mark.parametrize("sources", [1, 2, 19, 300])
def test_manifest_equals_brute_force(spark, sources):
    rng = random.Random(sources)
    rows = ODD + [(100 + k, f"Text {k} é", "en" if k % 3 else None, None if rng.random() < 0.1 else f"s{0 if rng.random() < 0.4 else rng.randrange(sources)}", k) for k in range(700)]
    rows = [(*r[:3], "one", r[4]) for r in rows] if sources == 1 else rows
    got = op13_merkle.manifest(docs(spark, rows).repartition(5), tampered()).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)


def test_manifest_of_empty_tables_and_lone_rows(spark):
    assert op13_merkle.manifest(docs(spark, [])).count() == 0
    for rows in ([(1, "A", None, None, None)], [(1, "A", None, "x", None), (2, None, None, "", 5)]):
        assert sorted((tuple(r) for r in op13_merkle.manifest(docs(spark, rows), tampered()).collect()), key=repr) == brute_manifest(rows)


def test_manifest_joins_by_shuffle_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(op13_merkle, "BROADCAST_NODES", 0)
    rows = [(k, f"T{k}", None, f"s{k % 3}", None) for k in range(900)]
    assert sorted((tuple(r) for r in op13_merkle.manifest(docs(spark, rows), tampered()).collect()), key=repr) == brute_manifest(rows)
