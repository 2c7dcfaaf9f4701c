from datetime import datetime

from carex.operators import references as R

AT = "received_at timestamp_ntz"


def at(day, hour=0):
    return datetime(2024, 3, day, hour)


def frames(spark, observations, patients, organizations=()):
    obs = spark.createDataFrame(observations, f"row_no long, {AT}, subject struct<reference:string>, key string, period string, n long")
    target = f"id string, {AT}, deleted_at timestamp_ntz, kind string"
    return (
        R.reference_rows(obs, "observation", {"subject.reference": "patient"}),
        {"patient": spark.createDataFrame(patients, target), "organization": spark.createDataFrame(list(organizations), target)},
    )


def found(spark, observations, patients, **k):
    refs, targets = frames(spark, observations, patients)
    return {r.row_no for r in R.orphan_rows(refs, targets, **k).collect()}, refs, targets


ROWS = [
    (1, at(5), ("Patient/a",), None, "x", 1),  # there
    (2, at(1), ("Patient/a",), None, "x", 1),  # arrives later
    (3, at(9), ("Patient/a",), None, "x", 1),  # deleted by then
    (4, at(8), ("Patient/a",), None, "x", 1),  # deleted just then
    (5, at(5), (" https://fhir.example.org/r4/Patient/a/_history/3 ",), None, "x", 1),
    (6, at(5), ("a",), None, "x", 1),
    (7, at(5), ("https://other.example.org/Patient/a",), None, "x", 1),
    (8, at(5), ("",), None, "x", 1),
    (9, at(5), (None,), None, "x", 1),
    (10, at(5), None, None, "x", 1),
    (11, None, ("Patient/a",), None, "x", 1),
    (12, None, ("Patient/zz",), None, "x", 1),
    (5, at(5), ("Patient/b",), None, "x", 1),  # repeated row number, other content
]
PATIENTS = [("a", at(3), at(8), "k"), ("a", at(3), at(8), "k"), ("b", None, None, "k"), (None, at(1), None, "k")]


def test_windows_forms_nulls_and_clashing_columns(spark):
    got, _, _ = found(spark, ROWS, PATIENTS)
    assert got == {2, 3, 4, 7, 8, 12}


def test_heavy_and_light_paths_agree(spark):
    assert found(spark, ROWS, PATIENTS, heavy_keys=1)[0] == found(spark, ROWS, PATIENTS, heavy_keys=100)[0]


def test_report_counts_rows(spark):
    _, refs, targets = found(spark, ROWS, PATIENTS)
    report = {r.period: (r.n_refs, r.n_orphans) for r in R.orphan_report(refs, targets).collect()}
    assert report == {"2024-03": (9, 5), None: (2, 1)}


def test_empty_tables(spark):
    assert found(spark, [], PATIENTS)[0] == set()
    refs, targets = frames(spark, ROWS[:2], [])
    assert R.orphan_rows(refs, targets).count() == 2
    assert R.orphan_report(*frames(spark, [], [])).count() == 0
