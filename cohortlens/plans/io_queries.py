"""Source / sink queries (S1, S3-S5, S8, S9, S12-S19, streaming conversion, F14-F16).

Round-trip queries write into the shared checkpoint folder of the session
and read the result back, so the check compares what was written.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from cohortlens.functions.nulls import normalize_na
from cohortlens.operators import features as feats, profile
from cohortlens.plans.feature_queries import ORDER_TIMING_SQL
from cohortlens.plans.join_queries import _FILTERED, q_merged_table
from cohortlens.plans.registry import query
from cohortlens.plans.roles import BASE_TABLES, FEATURE_COLS, role
from cohortlens.session import scratch_path
from cohortlens.sources import catalog, footers, readers, sinks
from cohortlens.streaming.convert import convert_stream


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"io/{name}-{uuid.uuid4().hex[:12]}")


@query("scan_parquet", """
SELECT l_orderkey, l_extendedprice, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'
""")
def q_scan_parquet(spark, sf):
    li = readers.read_table(spark, sf, "lineitem")
    return (li.where(F.col("l_shipdate") >= F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")))
              .select("l_orderkey", "l_extendedprice", "l_shipdate"))


@query("na_normalize", """
SELECT event_id, TRY_CAST(CASE WHEN trim(subject_id_text) IN ('', 'NULL', 'null', 'None') THEN NULL
                               ELSE trim(subject_id_text) END AS BIGINT) AS subject_id
FROM raw_ids
""")
def q_na_normalize(spark, sf):
    return role(spark, sf, "raw_ids").select("event_id", normalize_na("subject_id_text").alias("subject_id"))


@query("csv_roundtrip", "SELECT * FROM admissions")
def q_csv_roundtrip(spark, sf):
    path = _scratch(spark, "admissions") + ".csv"
    sinks.save_csv(role(spark, sf, "admissions"), path)
    return readers.read_csv_typed(spark, path)


@query("parquet_roundtrip", "SELECT * FROM poe")
def q_parquet_roundtrip(spark, sf):
    path = _scratch(spark, "poe") + ".parquet"
    sinks.save_parquet(role(spark, sf, "poe"), path, max_records_per_file=1_000_000)
    return spark.read.parquet(path)


@query("cached_subject_ids", "SELECT DISTINCT subject_id FROM poe WHERE subject_id IS NOT NULL")
def q_cached_subject_ids(spark, sf):
    root = _scratch(spark, "ids")
    first = catalog.cached_subject_ids(spark, role(spark, sf, "poe"), "poe", {"filtered": False}, root=root)
    first.count()
    # second call is served from the Parquet cache
    return catalog.cached_subject_ids(spark, role(spark, sf, "poe"), "poe", {"filtered": False}, root=root)


@query("catalog_scan")
def q_catalog_scan(spark, sf):
    return catalog.scan_directory(spark, sf)


def _columns_sql(table: str) -> str:
    whole = lambda agg: ("(UNPIVOT (SELECT " + agg + "(TRY_CAST(CAST(COLUMNS('(.*)') AS VARCHAR) AS BIGINT)) AS '\\1' FROM " + table
                         + ") ON COLUMNS(*) INTO NAME column_name VALUE v)")
    return f"""SELECT '{table}' AS table_name, d.column_name, d.t AS type, r.n AS n_rows,
       CASE WHEN d.t LIKE 'array%' THEN NULL ELSE c.v END AS n_values,
       CASE WHEN d.t IN ('int', 'bigint') AND c.v = r.n THEN lo.v END AS min_value, CASE WHEN d.t IN ('int', 'bigint') AND c.v = r.n THEN hi.v END AS max_value,
       r.n * CASE d.t WHEN 'int' THEN 4 WHEN 'float' THEN 4 WHEN 'date' THEN 4 WHEN 'bigint' THEN 8 WHEN 'double' THEN 8 WHEN 'timestamp_ntz' THEN 8 END AS fixed_bytes
FROM (SELECT column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
        WHEN 'FLOAT' THEN 'float' WHEN 'DATE' THEN 'date' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>'
        ELSE CASE WHEN column_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE column_type END END AS t FROM (DESCRIBE SELECT * FROM {table})) d
CROSS JOIN (SELECT count(*) AS n FROM {table}) r
LEFT JOIN (UNPIVOT (SELECT count(COLUMNS('(.*)')) AS '\\1' FROM {table}) ON COLUMNS(*) INTO NAME column_name VALUE v) c USING (column_name)
LEFT JOIN {whole('min')} lo USING (column_name) LEFT JOIN {whole('max')} hi USING (column_name)"""


@query("catalog_columns", "\nUNION ALL\n".join(_columns_sql(t) for t in BASE_TABLES))
def q_catalog_columns(spark, sf):
    return footers.catalog_columns(spark, catalog.study_tables(catalog.scan_directory(spark, sf), list(BASE_TABLES)))


@query("column_memory", """
SELECT 'documents' AS table_name, 'doc_id' AS column_name, 'bigint' AS dtype, CAST(count(doc_id) * 8 AS BIGINT) AS memory_bytes FROM documents
UNION ALL SELECT 'documents', 'text', 'string', CAST(coalesce(sum(strlen(text) + 8), 0) AS BIGINT) FROM documents
UNION ALL SELECT 'documents', 'lang', 'string', CAST(coalesce(sum(strlen(lang) + 8), 0) AS BIGINT) FROM documents
UNION ALL SELECT 'documents', 'source', 'string', CAST(coalesce(sum(strlen(source) + 8), 0) AS BIGINT) FROM documents
UNION ALL SELECT 'documents', 'n_chars', 'bigint', CAST(count(n_chars) * 8 AS BIGINT) FROM documents
UNION ALL SELECT 'embeddings', 'vec_id', 'bigint', CAST(count(vec_id) * 8 AS BIGINT) FROM embeddings
UNION ALL SELECT 'embeddings', 'embedding', 'array<float>', CAST(coalesce(sum(len(embedding) * 4 + 8), 0) AS BIGINT) FROM embeddings
UNION ALL SELECT 'embeddings', 'label', 'int', CAST(count(label) * 4 AS BIGINT) FROM embeddings
""")
def q_column_memory(spark, sf):
    one = lambda t: profile.column_memory(readers.read_table(spark, sf, t)).select(F.lit(t).alias("table_name"), "*")
    return one("documents").unionByName(one("embeddings"))


@query("column_roles")
def q_column_roles(spark, sf):
    return catalog.column_roles(role(spark, sf, "poe"))


_CONVERTED = ["region", "nation", "supplier", "customer"]


@query("convert_tables", "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, 'ok' AS status, count(*) AS rows FROM {t}" for t in _CONVERTED)
       + "\nUNION ALL\nSELECT 'missing_table', 'failed', NULL")
def q_convert_tables(spark, sf):
    done = sinks.convert_tables(spark, sf, [*_CONVERTED, "missing_table"], _scratch(spark, "converted"))
    return done.select("table_name", "status", "rows")


_ADM_COLS = ["subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "admission_type",
             "admit_provider_id", "admission_location", "discharge_location", "insurance", "language",
             "marital_status", "race", "edregtime", "edouttime", "hospital_expire_flag"]


@query("stream_convert", "SELECT * FROM admissions")
def q_stream_convert(spark, sf):
    base = _scratch(spark, "stream")
    src, out, ckpt = f"{base}/src", f"{base}/out", f"{base}/checkpoint"
    role(spark, sf, "admissions").repartition(4).write.option("header", True).csv(src)
    convert_stream(spark, src, _ADM_COLS, out, ckpt, max_files_per_trigger=2, timeout_s=600)
    return spark.read.parquet(out)


@query("feature_sink", ORDER_TIMING_SQL)
def q_feature_sink(spark, sf):
    t = feats.order_timing(role(spark, sf, "order_events"), "patient", "order_type", "ordertime",
                           "admittime", "dischtime", tiebreak="event_id")
    path = sinks.save_features(t, "timing", _scratch(spark, "features"), "parquet")
    return spark.read.parquet(path)


@query("merged_export", f"WITH {_FILTERED}\nSELECT * FROM m5")
def q_merged_export(spark, sf):
    paths = sinks.save_parquet_and_csv(q_merged_table(spark, sf), _scratch(spark, "merged"))
    return spark.read.parquet(paths["parquet"])


@query("numeric_input", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem
""")
def q_numeric_input(spark, sf):
    return readers.numeric_input(spark, f"{sf}/lineitem.parquet")


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    f = role(spark, sf, "features")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATURE_COLS, outputCol="_raw"),
                            StandardScaler(inputCol="_raw", outputCol="_x"),
                            KMeans(k=5, seed=42, featuresCol="_x", predictionCol="cluster")]).fit(f)
    path = sinks.save_model(pipe, _scratch(spark, "model"))
    return sinks.load_model(path).transform(f).select("key", F.col("cluster").cast("int").alias("cluster"))


def _violations_sql(table: str, cols: list[str]) -> str:
    from cohortlens.schema import CATEGORIES
    parts = []
    for c in cols:
        allowed = ", ".join("'" + v.replace("'", "''") + "'" for v in CATEGORIES[c])
        parts.append(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} "
                     f"WHERE {c} IS NOT NULL AND {c} NOT IN ({allowed}) GROUP BY {c}")
    return "\nUNION ALL\n".join(parts)


@query("category_violations", _violations_sql("poe", ["transaction_type", "order_status", "order_type"]))
def q_category_violations(spark, sf):
    from cohortlens.schema import category_violations
    return category_violations(role(spark, sf, "poe"))
