"""Sources and sinks: file priority, typed CSV, study subset, feature sink, wide pivot."""

import os
import tempfile

import pytest

from cohortlens.operators import features
from cohortlens.sources import catalog, readers, sinks


def test_file_priority_and_typed_csv(spark):
    base = tempfile.mkdtemp(prefix="cohortlens-src-")
    os.makedirs(f"{base}/hosp")
    with open(f"{base}/hosp/admissions.csv", "w") as fh:
        fh.write("subject_id,hadm_id,admittime,hospital_expire_flag,insurance\n"
                 "1,10,2020-01-01 10:00:00,0,Medicare\n"
                 "NULL,,2020-01-02 00:00:00,None,Other\n"
                 "x,12,,1,\n")
    df = readers.read_table(spark, f"{base}/hosp", "admissions")
    assert dict(df.dtypes) == {"subject_id": "bigint", "hadm_id": "bigint", "admittime": "timestamp_ntz",
                               "hospital_expire_flag": "smallint", "insurance": "string"}
    got = sorted(df.collect(), key=lambda r: str(r["hadm_id"]))
    assert [r["subject_id"] for r in got] == [1, None, None]        # hadm 10, 12, null
    assert got[2]["hospital_expire_flag"] is None and got[1]["admittime"] is None
    # a parquet copy takes priority over the csv
    sinks.save_parquet(df.where("hadm_id = 10"), f"{base}/hosp/admissions.parquet")
    assert readers.resolve_table_path(spark, f"{base}/hosp", "admissions").endswith(".parquet")
    assert readers.read_table(spark, f"{base}/hosp", "admissions").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.resolve_table_path(spark, f"{base}/hosp", "patients")
    cat = catalog.scan_directory(spark, base)
    rows = cat.collect()
    assert len(rows) == 1 and rows[0]["module"] == "hosp" and rows[0]["suffix"] == ".parquet"
    assert catalog.study_tables(cat, ["patients"]).count() == 0
    cols = catalog.table_columns(spark, cat)
    assert cols.where("column = 'hadm_id'").count() == 1


def test_feature_sink_formats(spark):
    base = tempfile.mkdtemp(prefix="cohortlens-sink-")
    seq = spark.createDataFrame([(1, ["a", "b"])], "p long, sequence array<string>")
    with pytest.raises(ValueError):
        sinks.save_features(seq, "sequences", base, "csv")
    path = sinks.save_features(seq, "sequences", base, "json", stamp="t0")
    assert path.endswith("engineered_features/sequences_t0")
    assert spark.read.json(path).count() == 1
    flat = spark.createDataFrame([(1, 2.0)], "p long, x double")
    p2 = sinks.save_features(flat, "timing", base, "csv", stamp="t1")
    assert spark.read.option("header", True).csv(p2).count() == 1


def test_to_wide(spark):
    long = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "a", 1)], "p long, o string, n long")
    wide = {r["p"]: (r["a"], r["b"]) for r in features.to_wide(long, "p", "o", "n").collect()}
    assert wide == {1: (2, 3), 2: (1, 0)}
