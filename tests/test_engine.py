import json

from carex.engine import Engine
from carex.plans.measures import Measure


def test_from_files_to_views_queries_and_measures(spark, tmp_path):
    people = [{"resourceType": "Patient", "id": str(k), "active": k % 2 == 0, "name": [{"family": f"F{k}", "given": ["a"]}]} for k in range(4)]
    events = [{"resourceType": "Observation", "id": f"o{k}", "subject": {"reference": f"Patient/{k % 2}"}, "status": "final"} for k in range(3)]
    (tmp_path / "b.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": r} for r in people + events]}))
    e = Engine(spark, as_of="2024-01-01 00:00:00").load_documents(str(tmp_path / "b.json"))
    view = {"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}, {"name": "family", "path": "name.family"}]}], "where": [{"path": "active"}]}
    assert sorted(map(tuple, e.view(view).collect())) == [("0", "F0"), ("2", "F2")]
    assert sorted(r.value for r in e.query("[Patient] p with [Observation] o such that o.subject references p return p.id").collect()) == ["0", "1"]
    assert e.library("library L define A: [Patient] p where p.active return p.id")("A").count() == 2
    assert e.measure(Measure("m", criteria={"numerator": "active"})).first().score == 50
    e.create(view, "people_view")
    assert spark.table("people_view").count() == 2
    e.export(view, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert [b.rows for b in e.batch({"x": view}, str(tmp_path / "batch"), "json")] == [2]
    assert e.profile(e.view(view))["FileScan"] <= 1 and e.profile(e.view(view))["Exchange"] == 0


def test_views_read_only_the_columns_they_name(spark, tmp_path):
    spark.createDataFrame([("1", True, "x")], "id string, active boolean, other string").write.parquet(str(tmp_path / "p"))
    e = Engine(spark).register("Patient", spark.read.parquet(str(tmp_path / "p")))
    plan = e.view({"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}]}], "where": [{"path": "active"}]})._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan and "PushedFilters: [IsNotNull(active), EqualTo(active,true)]" in plan


def test_exact_median_is_narrowed_to_the_middle(spark):
    import random
    import statistics

    from carex.plans.population import exact_median

    rng = random.Random(4)
    for values in ([3.0], [1.0, 2.0], [5.0] * 400, [1.0] * 300 + [2.0] * 300, [rng.gauss(0, 1) for _ in range(3001)], [float(rng.randint(0, 3)) for _ in range(2000)], [1.0] * 1000 + [rng.random() for _ in range(1000)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert exact_median(df, "v", most=50) == statistics.median(values)
    assert exact_median(spark.createDataFrame([], "v double"), "v") is None


def test_templates_build_and_refuse_unknown_names(spark):
    import pytest

    from carex.plans.views import ViewDefinition, template, template_names

    assert all(ViewDefinition.of(template(n)) for n in template_names())
    with pytest.raises(ValueError, match="there is no template"):
        template("nothing")


def test_value_set_cache_and_bundles(spark, tmp_path):
    import json

    from carex.operators.terminology import ValueSetCache, value_set
    from carex.plans.measures import report_bundles

    cache = ValueSetCache(spark, str(tmp_path / "cache"), lambda n: value_set(spark, n, [("s", "1")]), days=7)
    for now in ("2025-01-01 00:00:00", "2025-01-07 00:00:00", "2025-01-09 00:00:00"):
        assert cache.get("a", now).count() == 1
    assert cache.loads == 2
    reports = spark.createDataFrame([(json.dumps({"n": k}),) for k in range(9)], "report string")
    bundles = [json.loads(r.bundle) for r in report_bundles(reports, 2).collect()]
    assert sorted(e["resource"]["n"] for b in bundles for e in b["entry"]) == list(range(9)) and sum(b["total"] for b in bundles) == 9


def test_large_value_sets_give_the_same_rows(spark, monkeypatch):
    from carex.operators.terminology import value_set
    from carex.plans import population as P

    rows = spark.createDataFrame([(k, (([(s, c)]),)) for k, (s, c) in enumerate([("LOINC", "1"), ("http://loinc.org", "2"), ("x", "3"), ("x", "1"), (None, "3")])], "n int, code struct<coding:array<struct<system:string,code:string>>>")
    few = [("urn:oid:2.16.840.1.113883.6.1", "1"), ("LOINC", "2"), (None, "3")]
    for more in (0, 1500):
        p = P.Population({"T": rows}, value_set(spark, "v", few + [(None, f"z{k}") for k in range(more)]))
        assert {r.n for r in p.query('[T: "v"] t return t.n').select("value").withColumnRenamed("value", "n").collect()} == {0, 1, 2, 4}
