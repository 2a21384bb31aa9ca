"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cohortlens.llm import op1_langid, op2_quality, op3_decontaminate, op4_secrets, op5_toxicity, op6_jaccard, op7_linededup, op8_pii
from cohortlens.llm import op9_sentencepiece, op10_sharding

# extra columns named like the operators' own
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, shard int, comp long, pos int, th long, h long, "
          "w string, id long, n long, sid long, ids string, site string, vslot int, n_lines int, kept boolean, k int")
PLAIN = "the cat sat on the mat and looked at the other cat for a very long time while rain fell outside again"
ROWS = [(1, PLAIN, "en"), (2, PLAIN, "en"), (2, PLAIN, "en"), (2, "another text under the same id", None), (None, PLAIN, "en"),
        (None, None, None), (3, None, "de"), (4, "", ""), (5, " \n\t ", "fr"), (6, "!!! 123", "en"), (7, "x", "en"),
        (8, "der hund und die katze " * 40_000, "de"), (9, "é" * 300_000, "fr"), (10, "\u0000 \U0001F600 ﬁ İ", "es")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, None if i == 2 else "s", None, *[None] * 16) for i, t, lang in rows], SCHEMA)


def labels(spark, rows=((1, 1, 0), (7, 0, 1), (8, 1, 0), (None, 1, 1), (4, None, None), (7, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=((1, PLAIN), (2, None), (3, ""), (4, "one two"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPS = {
    "op1": lambda s, d: op1_langid.language_id(d),
    "op2": lambda s, d: op2_quality.quality(d, labels(s).where("quality = 1").select("doc_id")),
    "op4": lambda s, d: op4_secrets.scan_secrets(d),
    "op5": lambda s, d: op5_toxicity.toxicity(d, labels(s)),
    "op6": lambda s, d: op6_jaccard.jaccard_components(d),
    "op7": lambda s, d: op7_linededup.dedup_lines(d),
    "op8": lambda s, d: op8_pii.find_pii(d),
    "op9": lambda s, d: op9_sentencepiece.encode(d),
    "op10": lambda s, d: op10_sharding.shard(d),
}


@pytest.mark.parametrize("op", OPS)
def test_one_row_per_row(spark, op):
    out = OPS[op](spark, frame(spark)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)
    assert OPS[op](spark, frame(spark, [])).count() == 0


def test_defined_results(spark):
    d = frame(spark)
    lang = {(r.doc_id): r for r in OPS["op1"](spark, d).where("doc_id in (3, 4, 5, 6)").collect()}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in lang.values())
    comp = {r.doc_id: r for r in OPS["op6"](spark, d).where("doc_id in (1, 3, 4, 5)").collect()}
    assert comp[1].component_id == 1 and all((comp[i].n_shingles, comp[i].component_id) == (0, i) for i in (3, 4, 5))
    assert [r.component_id for r in OPS["op6"](spark, d).where("doc_id is null").orderBy("n_shingles").collect()] == [None, 1]
    q = {r.doc_id: r for r in OPS["op2"](spark, d).where("doc_id in (3, 4, 5)").collect()}
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in q.values())
    enc = {r.doc_id: r for r in OPS["op9"](spark, d).where("doc_id in (3, 4, 8, 9, 10)").collect()}
    assert enc[3].ids is None and enc[4].ids == [] and all(enc[i].round_trip for i in (8, 9, 10))
    tox = [r.score for r in OPS["op5"](spark, d).collect()]
    assert all(0 <= x <= 1 for x in tox)


def test_leaks(spark):
    got = op3_decontaminate.leaks(frame(spark), bench(spark)).collect()
    assert sorted((str(r.doc_id), r.item_id, r.similarity) for r in got) == [("1", 1, 1.0), ("2", 1, 1.0), ("2", 1, 1.0), ("None", 1, 1.0)]
    assert op3_decontaminate.leaks(frame(spark), bench(spark, [])).count() == 0
    assert op3_decontaminate.leaks(frame(spark, []), bench(spark)).count() == 0
    inside = [(1, "before it one two after", "en"), (2, "one  TWO", "en"), (3, "two one", "en")]
    assert sorted(r.doc_id for r in op3_decontaminate.leaks(frame(spark, inside), bench(spark)).collect()) == [1, 2]


def test_line_dedup_near_and_far_from_the_threshold(spark):
    rows = [(i, f"own {i}\ncommon" + ("\nnine" if i < 9 else "") + ("\nten" if i < 10 else ""), "en", f"s{i % 40}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in op7_linededup.dedup_lines(d, min_sites=10).collect()}
    assert out[0].text == rows[0][1] and out[1].text == "own 1\nnine" and out[9].text == "own 9" and out[30].text == "own 30"
    assert out[1].n_removed == 2 and out[1].n_lines == 4


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages(spark, name, stage, tmp_path):
    for n, df in (("labels", labels(spark)), ("benchmark", bench(spark))):
        df.write.parquet(f"{tmp_path}/{n}.parquet")
    d = frame(spark)
    out = stage(spark, d, str(tmp_path))
    rows = out.collect()
    if name != "tokens":
        assert out.columns == d.columns and out.dtypes == d.dtypes
    kept = sorted(str(r.doc_id) for r in rows)
    if name == "near_duplicates":
        assert kept == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "None"])
    if name == "decontaminate":
        assert kept == sorted(["2", "3", "4", "5", "6", "7", "8", "9", "10", "None"])
    assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0


def test_ties_in_spans_and_slots(spark):
    d = spark.createDataFrame([(1, "token=abcdefgh"), (1, "token=abcdefgh")], "doc_id long, text string")
    assert {r.spans for r in op4_secrets.scan_secrets(d).collect()} == {"assign:0:14"}
    out = op10_sharding.shard(d).groupBy("shard").agg(F.collect_list("slot").alias("s")).collect()
    assert all(sorted(r.s) == list(range(len(r.s))) for r in out)


@pytest.mark.parametrize("copies", [12, 15, 20])
def test_passages_of_few_documents_go_when_one_source_holds_a_third(spark, copies):
    passages = [f"passage {p} " + "of many words " * 20 for p in range(10)]
    rows, rng = [], random.Random(copies)
    for p, passage in enumerate(passages):
        for i in range(copies):
            source = 0 if rng.random() < 1 / 3 else rng.randrange(1, 20)
            rows.append((p * copies + i, f"own {p} {i}\n{passage}", "en", f"s{source}"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r.n_removed for r in op7_linededup.dedup_lines(d).collect()}
    assert out == {r[0]: int(r[0] % copies > 0) for r in rows}
