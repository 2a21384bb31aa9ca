"""Work that was done twice or left to few tasks: exports, cohorts, texts, K-means."""

import numpy as np
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from cohortlens.operators import cluster, cohort, lloyd, prepare
from cohortlens.operators.tiles import vector_rows
from cohortlens.plans import study
from cohortlens.sources import sinks


def points(spark, n, parts=1):
    x = np.random.default_rng(0).normal(size=(n, 2))
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "key long, a double, b double").coalesce(parts)


def test_csv_is_written_from_the_parquet(spark, tmp_path):
    paths = sinks.save_parquet_and_csv(spark.range(50).select("id", F.rand().alias("r")), str(tmp_path / "t"))
    one = {r.id: r.r for r in spark.read.parquet(paths["parquet"]).collect()}
    two = {r.id: r.r for r in spark.read.schema("id long, r double").option("header", True).csv(paths["csv"]).collect()}
    assert one == two and len(one) == 50      # computed twice, the two would differ


def test_study_subjects_are_found_once(spark, monkeypatch):
    seen, restrict = [], cohort.restrict_tables
    monkeypatch.setattr(cohort, "restrict_tables", lambda tables, ids: seen.append(ids) or restrict(tables, ids))
    monkeypatch.setattr(study.joins, "merged_table", lambda *t: t[0])
    tables = {n: spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "subject_id long, x long") for n in study.STUDY_TABLES}
    monkeypatch.setattr(cohort, "apply_table_rules", lambda n, t, p: t)
    out = study.study_cohort(tables, n_subjects=1)
    assert [r.subject_id for r in out.collect()] == [1]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Intersect" not in plan


def test_lda_reads_sparse_vectors_without_texts(spark, monkeypatch):
    seen = []

    class Spy(cluster.LDA):
        def fit(self, df):
            seen.append((df.columns, df.first()[1]))
            return super().fit(df)

    monkeypatch.setattr(cluster, "LDA", Spy)
    docs = spark.createDataFrame([(i, ["one", "two", f"w{i % 7}"]) for i in range(40)] + [(99, [])], "id long, tokens array<string>")
    for vectorizer in ("count", "tfidf"):
        td, _, vocabulary = cluster.lda_topics(docs, "id", "tokens", n_topics=2, max_iter=2, vectorizer=vectorizer)
        columns, first = seen.pop()
        assert len(columns) == 2 and "tokens" not in columns and isinstance(first, SparseVector) and len(first.indices) == 3
        rows = {r.id: r.topic_distribution for r in td.collect()}
        assert len(rows) == 41 and rows[99] == [0.5, 0.5] and len(vocabulary) == 9
        assert "regexp" not in td._jdf.queryExecution().optimizedPlan().toString()
    assert abs(first.norm(2) - 1) < 1e-12


def test_texts_are_taken_apart_once(spark):
    docs = spark.createDataFrame([(1, "Ab cd ab"), (2, ""), (3, None), (1, "ab")], "id long, text string")
    counts = prepare.term_counts(docs, "id", "text")
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted(map(tuple, counts.collect())) == [(1, "ab", 3), (1, "cd", 1)]


def test_kmeans_rounds_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "SPREAD", 100)
    monkeypatch.setattr(lloyd, "BLOCK", 16)
    rows = vector_rows(points(spark, 1000), ["a", "b"])
    packed = lloyd.pack(rows, 2)
    per_task = [r[0] for r in packed.groupBy(F.spark_partition_id()).agg(F.sum(F.length("x")) / 16).select("(sum(length(x)) / 16)").collect()]
    assert sum(per_task) == 1000 and max(per_task) <= 120
    start = [np.array([[0.0, 1.0], [1.0, 0.0], [-1.0, -1.0]])]
    (a,), (x,) = lloyd.lloyd(rows, start, 20)
    (b,), (y,) = lloyd.lloyd(packed, start, 20)
    assert np.allclose(a, b) and abs(x - y) < 1e-9
    seen, best = [], cluster._best_kmeans
    monkeypatch.setattr(cluster, "_best_kmeans", lambda vec, *a: seen.append(vec) or best(vec, *a))
    monkeypatch.setattr(cluster, "SPREAD", 100)
    labels, _ = cluster.kmeans(points(spark, 1000), 2, ["a", "b"], n_init=1)
    assert seen[0].columns == ["key", "features"] and seen[0].rdd.getNumPartitions() == 10 and labels.count() == 1000
