"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# rows per Arrow batch: bounds the memory of a Python worker on long texts
ARROW_ROWS = "512"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_langid")
def op1_langid(spark, sf_dir):
    from cohortlens.llm.op1_langid import language_id
    return language_id(read(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    from cohortlens.llm.op5_toxicity import toxicity
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS p, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS s FROM w WHERE len(ws) >= 8),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rw AS (SELECT doc_id, count(DISTINCT p + j) AS n_repeat_words FROM rep, (SELECT unnest(range(8)) AS j) GROUP BY 1),
tbl AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i))),
g AS (SELECT doc_id, unnest(list_concat(ws, CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [] END)) AS g FROM w),
u AS (SELECT DISTINCT g, hex(encode(g)) AS h FROM g),
b AS (SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1]))) & 16383 AS b FROM u, tbl),
f AS (SELECT g.doc_id, b.b, count(*) AS n FROM g JOIN b USING (g) GROUP BY 1, 2),
q AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
c AS (SELECT b, sum(n) AS r, sum(n) FILTER (WHERE q.doc_id IS NOT NULL) AS t FROM f LEFT JOIN q USING (doc_id) GROUP BY 1),
tot AS (SELECT sum(r)::DOUBLE AS r, coalesce(sum(t), 0)::DOUBLE AS t FROM c),
lr AS (SELECT b, CASE WHEN tot.t = 0 THEN 0 ELSE floor(1000000 * ln((coalesce(c.t, 0) + 131072.0::DOUBLE * c.r / tot.r) / ((tot.t + 131072.0::DOUBLE) * c.r / tot.r)) + 0.5)::BIGINT END AS v FROM c, tot),
s AS (SELECT doc_id, sum(n * v)::BIGINT AS log_ratio, sum(n)::BIGINT AS n_features FROM f JOIN lr USING (b) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(dl.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rw.n_repeat_words, 0)::BIGINT AS n_repeat_words,
      coalesce(s.log_ratio, 0)::BIGINT AS log_ratio, coalesce(s.n_features, 0)::BIGINT AS n_features
      FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND log_ratio >= n_features * -60000 AS kept FROM m
"""


@query("op2_quality", OP2_SQL)
def op2_quality(spark, sf_dir):
    from cohortlens.llm.op2_quality import quality
    trusted = read(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    return quality(read(spark, sf_dir, "documents"), trusted)


OP3_SQL = r"""
WITH i0 AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark WHERE text IS NOT NULL),
i1 AS (SELECT item_id, ws, len(ws) AS l, least(5, len(ws)) AS k FROM i0 WHERE len(ws) > 0),
i2 AS (SELECT item_id, l, k, unnest(list_transform(range(1, l - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS s FROM i1),
i3 AS (SELECT item_id, l, k, s, count(*) AS c FROM i2 GROUP BY ALL),
d0 AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
ks AS (SELECT DISTINCT k FROM i1),
d1 AS (SELECT doc_id, len(ws) AS n, k, unnest(range(0, len(ws) - k + 1)) AS pos,
              unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS s FROM d0, ks WHERE len(ws) >= k),
h AS (SELECT DISTINCT d1.doc_id, d1.n, i3.l, i3.k, i3.item_id, d1.pos FROM d1 JOIN i3 ON i3.k = d1.k AND i3.s = d1.s),
w AS (SELECT DISTINCT doc_id, n, l, k, item_id, unnest(range(least(greatest(0, n - l), greatest(0, pos - l + k)), least(pos, greatest(0, n - l)) + 1)) AS w FROM h),
x AS (SELECT w.doc_id, w.item_id, w.l, w.w, least(w.l, w.n) - w.k + 1 AS mw, w.l - w.k + 1 AS mi, d1.s, count(*) AS c
      FROM w JOIN d1 ON d1.doc_id = w.doc_id AND d1.k = w.k AND d1.pos BETWEEN w.w AND w.w + least(w.l, w.n) - w.k GROUP BY ALL),
y AS (SELECT x.doc_id, x.item_id, x.l, x.w, mw, mi, sum(least(x.c, i3.c)) AS b FROM x JOIN i3 ON i3.item_id = x.item_id AND i3.s = x.s GROUP BY ALL),
z AS (SELECT doc_id, item_id, l, w, b / (mw + mi - b) AS sim FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, w) AS rn FROM z WHERE sim >= 0.8)
SELECT doc_id, item_id, round(sim, 6) AS similarity, w::INT AS start_word, l::INT AS n_words FROM r WHERE rn = 1
"""


@query("op3_decontaminate", OP3_SQL)
def op3_decontaminate(spark, sf_dir):
    from cohortlens.llm.op3_decontaminate import leaks
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op4_secrets")
def op4_secrets(spark, sf_dir):
    from cohortlens.llm.op4_secrets import scan_secrets
    return scan_secrets(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ') || ' /' || len(ws)]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) m ON m.x = w.doc_id
"""


@query("op6_jaccard_join", OP6_SQL)
def op6_jaccard_join(spark, sf_dir):
    from cohortlens.llm.op6_jaccard import jaccard_components
    return jaccard_components(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(a) AS line, unnest(range(len(a))) AS pos
           FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
w AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has FROM l),
b AS (SELECT line, min((doc_id, pos)) AS first FROM w WHERE has GROUP BY line
      HAVING count(DISTINCT coalesce(source, chr(1))) >= 4),
k AS (SELECT w.doc_id, w.pos, w.line, b.line IS NULL OR b.first = (w.doc_id, w.pos) AS keep FROM w LEFT JOIN b ON w.has AND b.line = w.line)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(x.t, '') END AS text, coalesce(x.n, 0)::INT AS n_lines, coalesce(x.r, 0)::INT AS n_removed
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (keep) AS t, count(*) AS n, count(*) FILTER (NOT keep) AS r
                            FROM k GROUP BY 1) x USING (doc_id)
"""


@query("op7_line_dedup", OP7_SQL)
def op7_line_dedup(spark, sf_dir):
    from cohortlens.llm.op7_linededup import CONTRACT_SITES, dedup_lines
    return dedup_lines(read(spark, sf_dir, "documents"), CONTRACT_SITES).select("doc_id", "text", "n_lines", "n_removed")


@query("op8_pii")
def op8_pii(spark, sf_dir):
    from cohortlens.llm.op8_pii import find_pii
    return find_pii(read(spark, sf_dir, "documents"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf_dir):
    from cohortlens.llm.op9_sentencepiece import encode
    return encode(read(spark, sf_dir, "documents"))


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    from cohortlens.llm.op10_sharding import shard
    out = shard(read(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


OP11_SQL = r"""
WITH d0 AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT k, doc_id, ts, len(ts)::BIGINT AS n FROM d0 WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM d),
i0 AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
i1 AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM i0),
i AS (SELECT item_id, t, count(*) AS q FROM i1 GROUP BY 1, 2),
p0 AS (SELECT k, doc_id, n, unnest(ts) AS t FROM d),
p AS (SELECT k, doc_id, n, t, count(*)::BIGINT AS tf FROM p0 GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), s),
x AS (SELECT i.item_id, p.k, p.doc_id, sum(i.q * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * n_docs) // total))))::BIGINT AS score
      FROM i JOIN w USING (t) JOIN p USING (t), s GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op11_search", OP11_SQL)
def op11_search(spark, sf_dir):
    from cohortlens.llm.op11_search import search
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS e,
                     coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                              AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine FROM embeddings),
f AS (SELECT k, vec_id, e, len(e) AS d, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE fine),
l AS (SELECT a.k AS x, b.k AS y FROM f a JOIN f b ON a.k <> b.k AND a.d = b.d AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT k AS x, k AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT r.x, min(v.vec_id) AS component_id FROM r JOIN v ON v.k = r.y GROUP BY 1),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, coalesce(v.vec_id = c.component_id, false) AS kept
FROM v JOIN c ON c.x = v.k LEFT JOIN n ON n.x = v.k
"""


@query("op12_near_duplicates", OP12_SQL)
def op12_near_duplicates(spark, sf_dir):
    from cohortlens.llm.op12_neardup import near_duplicates
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
                       FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT *, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
             lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1]))) % 5 = 0, false) AS tampered FROM documents, tbl),
f AS (SELECT doc_id, source, tampered, coalesce(text, '') AS t0, text IS NULL AS no_text,
             CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
             || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END AS head FROM d),
g AS (SELECT doc_id, source, sha256(head || CASE WHEN no_text THEN '-' ELSE strlen(t0) || ':' || t0 END) AS leaf,
             sha256(head || CASE WHEN no_text THEN '-' ELSE strlen(t0) || ':' || CASE WHEN tampered THEN translate(t0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE t0 END END) AS used FROM f),
o AS (SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS t,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM g),
up AS (SELECT 0 AS lv, t, i, leaf AS h, m FROM o
       UNION ALL
       SELECT lv + 1, t, i // 16, sha256(string_agg(h, '' ORDER BY i)), max((m + 15) // 16) FROM up WHERE m > 1 GROUP BY lv, t, i // 16),
sub AS (SELECT t, h, row_number() OVER (ORDER BY encode(t)) - 1 AS i, count(*) OVER () AS m FROM up WHERE m = 1),
over_ AS (SELECT 0 AS lv, i, h, m FROM sub
       UNION ALL
       SELECT lv + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), max((m + 15) // 16) FROM over_ WHERE m > 1 GROUP BY lv, i // 16),
run AS (SELECT lv, t, i // 16 AS p, list(h ORDER BY i) AS hs FROM up WHERE m > 1 GROUP BY ALL),
orun AS (SELECT lv, i // 16 AS p, list(h ORDER BY i) AS hs FROM over_ WHERE m > 1 GROUP BY ALL),
walk AS (SELECT k, t, 0 AS lv, i, used AS h, '' AS proof FROM (SELECT *, row_number() OVER () AS k FROM o)
       UNION ALL
       SELECT k, w.t, w.lv + 1, i // 16, sha256(array_to_string(hs[1:i % 16], '') || h || array_to_string(hs[i % 16 + 2:], '')), proof || array_to_string(hs[1:i % 16], '') || array_to_string(hs[i % 16 + 2:], '')
       FROM walk w JOIN run r ON r.t = w.t AND r.lv = w.lv AND r.p = w.i // 16),
mid AS (SELECT k, t, h, proof FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY lv DESC) = 1),
walk2 AS (SELECT k, 0 AS lv, sub.i, mid.h, proof FROM mid JOIN sub USING (t)
       UNION ALL
       SELECT k, w.lv + 1, i // 16, sha256(array_to_string(hs[1:i % 16], '') || h || array_to_string(hs[i % 16 + 2:], '')), proof || array_to_string(hs[1:i % 16], '') || array_to_string(hs[i % 16 + 2:], '')
       FROM walk2 w JOIN orun r ON r.lv = w.lv AND r.p = w.i // 16),
fin AS (SELECT k, h, proof FROM walk2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY lv DESC) = 1),
root AS (SELECT h AS root FROM over_ WHERE m = 1)
SELECT x.doc_id, x.leaf, sub.h AS subroot, root, sha256(fin.proof) AS proof_sha256, fin.h AS folded_root, fin.h = root AS verified
FROM (SELECT *, row_number() OVER () AS k FROM o) x JOIN fin USING (k) JOIN sub USING (t), root
"""


@query("op13_merkle", OP13_SQL)
def op13_merkle(spark, sf_dir):
    from cohortlens.llm.op13_merkle import manifest
    return manifest(read(spark, sf_dir, "documents"), tamper=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
