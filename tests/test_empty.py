"""Every operator accepts empty input and returns an empty (or one null-statistic) result."""

import pytest

from cohortlens.operators import cluster, evaluate, features, joins, neighbors, prepare, profile, stats


@pytest.fixture(scope="module")
def empty(spark):
    return {
        "ev": spark.createDataFrame([], "p long, id long, o string, t timestamp_ntz, a timestamp_ntz, "
                                        "d timestamp_ntz"),
        "seq": spark.createDataFrame([], "p long, sequence array<string>"),
        "adm": spark.createDataFrame([], "subject_id long, hadm_id long, admittime timestamp_ntz, "
                                         "dischtime timestamp_ntz"),
        "labs": spark.createDataFrame([], "labevent_id long, subject_id long, charttime timestamp_ntz"),
        "tab": spark.createDataFrame([], "r string, c string"),
        "lab": spark.createDataFrame([], "key long, cluster int, x double"),
        "long": spark.createDataFrame([], "feature string, cluster int, value double"),
    }


CASES = {
    "order_frequency": lambda e: features.order_frequency(e["ev"], "p", "o"),
    "order_transitions": lambda e: features.order_transitions(e["seq"]),
    "order_timing": lambda e: features.order_timing(e["ev"], "p", "o", "t", "a", "d"),
    "order_sequences": lambda e: features.order_sequences(e["ev"], "p", "o", "t"),
    "nearest_admission": lambda e: joins.nearest_admission(e["labs"], e["adm"]),
    "histogram": lambda e: profile.histogram(e["lab"], "x"),
    "characterization": lambda e: profile.cluster_characterization(e["lab"], features=["x"]),
    "kruskal": lambda e: stats.kruskal(e["long"]),
    "anova": lambda e: stats.anova(e["long"]),
    "dbscan": lambda e: cluster.dbscan(e["lab"], ["x"], 0.5, 2),
    "knn": lambda e: neighbors.knn_distances(e["lab"], ["x"], 2),
    "impute_median": lambda e: prepare.impute(e["lab"], "median", ["x"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_empty_input(empty, name):
    assert CASES[name](empty).count() == 0


def test_empty_statistics(empty):
    assert stats.chi2_contingency(empty["tab"], "r", "c").first()["statistic"] is None
    assert profile.box_stats(empty["lab"], "x").first()["median"] is None
    assert evaluate.metrics_summary(empty["lab"], ["x"], "a").first()["n_clusters"] == 0
