"""The study join reads, of every table, only the rows of stays that can be in its result."""

from cohortlens.operators import joins

from conftest import rows


def frames(spark):
    make = spark.createDataFrame
    patients = make([(1, "F"), (2, "M"), (2, "M"), (None, "F")], "subject_id long, gender string")
    admissions = make([(1, 10, "a"), (1, 11, "b"), (2, 20, "c"), (2, None, "d"), (3, 30, "e"), (None, 40, "f")],
                      "subject_id long, hadm_id long, admission_type string")
    stays = [(1, 10), (1, 11), (2, 20), (2, 20), (2, None), (3, 30), (None, 40), (1, 20)]
    transfers = make([(s, h, i) for i, (s, h) in enumerate(stays)], "subject_id long, hadm_id long, transfer_id long")
    diagnoses = make([(1, 10, "x", 10), (2, 20, "x", 10), (2, 20, "y", 10), (3, 30, "x", 10), (None, 40, "x", 10)],
                     "subject_id long, hadm_id long, icd_code string, icd_version long")
    dictionary = make([("x", 10, "ex"), ("z", 10, "zed")], "icd_code string, icd_version long, long_title string")
    orders = [(f"o{i}", i, s, h, p) for i, (s, h) in enumerate(stays) for p in ("S", None)]
    poe = make(orders, "poe_id string, poe_seq long, subject_id long, hadm_id long, order_provider_id string")
    detail = make([(f"o{i}", i, s, "v") for i, (s, _) in enumerate(stays)] * 2, "poe_id string, poe_seq long, subject_id long, field_value string")
    rx = make([(s, h, o, n, p, "drug") for o, n, s, h, p in orders[::2] + orders[1::4]],
              "subject_id long, hadm_id long, poe_id string, poe_seq long, order_provider_id string, drug string")
    labs = make([(s, h, 7, "S", 100 + i) for i, (s, h) in enumerate(stays)], "subject_id long, hadm_id long, itemid long, order_provider_id string, labevent_id long")
    items = make([(7, "seven"), (8, "eight")], "itemid long, label string")
    return [patients, admissions, transfers, diagnoses, dictionary, poe, detail, rx, labs, items]


def test_tables_are_restricted_and_rows_stay(spark, monkeypatch):
    tables = frames(spark)
    for n in (8, 10):
        want = list(joins.merge_stages(*tables[:n]).values())[-1]
        seen, stages = [], joins.merge_stages
        monkeypatch.setattr(joins, "merge_stages", lambda *t: seen.append(t) or stages(*t))
        got = joins.merged_table(*tables[:n])
        monkeypatch.undo()
        assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 0
        read = [t.count() if t is not None else None for t in seen[0][:10]]
        # stays (1, 10) and (2, 20): patients and dictionaries are whole, a detail has no stay but a subject
        assert read[:8] == [4, 2, 4, 3, 2, 8, 12, 6]
        assert read[8:] == ([None, None] if n == 8 else [4, 2])
