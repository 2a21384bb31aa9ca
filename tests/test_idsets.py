"""Id bitmaps against plain sets, and the footer catalog against the data."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import idsets, profile
from cohortlens.session import Scratch
from cohortlens.sources import catalog, footers

EDGE = [0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, 65536, 10**12, -10**12, 7]


def ids(spark, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"subject_id {kind}")


def got(df):
    return sorted(r.subject_id for r in df.collect())


@pytest.mark.parametrize("kind", ["long", "int"])
def test_ids_come_back(spark, kind):
    values = EDGE if kind == "long" else [v for v in EDGE if abs(v) < 2**31]
    bm = idsets.id_bitmap(ids(spark, values + values + [None], kind))
    assert got(idsets.ids_of(bm)) == sorted(values) and idsets.id_count(bm).first().n_ids == len(values)


def test_intersection_and_restriction_equal_sets(spark):
    rng = random.Random(3)
    sets = [{rng.randrange(-40_000, 90_000) for _ in range(3000)} | set(EDGE[:9]) for _ in range(3)]
    want = set.intersection(*sets)
    scratch = Scratch(spark, "idsets-test")
    bm = scratch.keep(idsets.intersect_bitmaps([idsets.id_bitmap(ids(spark, s)) for s in sets]))
    assert got(idsets.ids_of(bm)) == sorted(want)
    rows = [v for v in sorted(sets[0]) for _ in range(2)] + [None]
    table = ids(spark, rows).withColumn("bits", F.lit("own")).withColumn("bucket", F.lit(1))      # clashing names
    for most in (idsets.BROADCAST_BUCKETS, 0):         # bitmaps broadcast; ids joined
        out = idsets.rows_in(table, bm, broadcast_buckets=most)
        assert out.columns == table.columns and got(out) == [v for v in rows[:-1] if v in want]


def test_disjoint_and_empty_sets(spark):
    a, b, none = ids(spark, [1, 2]), ids(spark, [3]), ids(spark, [])
    empty = Scratch(spark, "idsets-test").keep(idsets.intersect_bitmaps([idsets.id_bitmap(a), idsets.id_bitmap(b)]))
    assert empty.count() == 0 and idsets.rows_in(a, empty).count() == 0
    assert idsets.id_bitmap(none).count() == 0 and idsets.id_count(idsets.id_bitmap(none)).first().n_ids == 0
    with pytest.raises(TypeError):
        idsets.id_bitmap(ids(spark, ["x"], "string"))
    whole = spark.createDataFrame([("E1", 10)], "icd_code string, icd_version int")
    assert idsets.restrict_tables({"d": whole}, empty)["d"].count() == 1


def test_cached_bitmap_is_read_back(spark, tmp_path):
    first = catalog.cached_id_bitmap(spark, ids(spark, EDGE), "t", {"a": 1}, root=str(tmp_path))
    again = catalog.cached_id_bitmap(spark, ids(spark, [5]), "t", {"a": 1}, root=str(tmp_path))
    assert got(idsets.ids_of(first)) == got(idsets.ids_of(again)) == sorted(EDGE)


def test_catalog_reads_footers_only(spark):
    session = footers.footer_session(spark)
    plan = footers.footer_columns(session, "lineitem", "/root/testdata/sf0.001/lineitem.parquet")._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_catalog_of_nulls_text_files_and_nested_columns(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([(1, None, [1.0], "x", 7), (None, 2.5, None, None, 9)], "a int, b double, c array<double>, d string, e long").write.parquet(f"{base}/t.parquet")
    spark.createDataFrame([((1, 2), 5)], "s struct<x:int,y:int>, z long").write.parquet(f"{base}/u.parquet")
    spark.createDataFrame([("1", "2")], "p string, q string").coalesce(1).write.option("header", True).csv(f"{base}/v.csv")
    rows = {(r.table_name, r.column_name): r for r in footers.catalog_columns(spark, catalog.scan_directory(spark, base)).collect()}
    a, b, c, d, e = (rows["t", k] for k in "abcde")
    assert (a.type, a.n_rows, a.n_values, a.min_value, a.max_value, a.fixed_bytes) == ("int", 2, 1, None, None, 8)
    assert (e.n_values, e.min_value, e.max_value, e.fixed_bytes) == (2, 7, 9, 16)
    assert (b.n_values, b.min_value, b.fixed_bytes) == (1, None, 16) and (c.n_values, c.fixed_bytes) == (None, None) and d.n_values == 1
    assert rows["u", "z"].n_rows == 1 and rows["u", "z"].n_values is None and rows["v", "p"].n_rows is None
    assert footers.catalog_columns(spark, catalog.scan_directory(spark, base).limit(0)).count() == 0


def test_memory_of_columns(spark):
    df = spark.createDataFrame([(1, "ab", [1, 2], {"k": 1}), (None, None, None, None)], "a int, t string, v array<long>, m map<string,int>")
    out = {r.column_name: r.memory_bytes for r in profile.column_memory(df).collect()}
    assert (out["a"], out["t"], out["v"]) == (4, 10, 24) and out["m"] > 0
