import pytest
from pyspark.sql import functions as F

from carex.functions.path_compiler import compile_path
from carex.functions.path_parser import PathError, parse
from carex.plans.measures import Measure, measure_report, membership, population_counts, proportion, wilson
from carex.plans.population import Population
from carex.plans.views import PRESETS, ViewBuilder, ViewError, preset, view_rows
from carex.sources import store
from carex.operators import terminology as terms

PEOPLE = """id string, active boolean, gender string, birthDate string, name array<struct<use:string,family:string,given:array<string>>>,
 telecom array<struct<system:string,value:string>>, contact array<struct<gender:string,telecom:array<struct<system:string,value:string>>>>, managingOrganization struct<reference:string>,
 valueQuantity struct<value:double>, valueString string, extension array<struct<url:string,valueCode:string>>"""


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            ("p1", True, "male", "1970-06", [("official", "F1", ["g1", "g2"]), ("usual", "F2", None)], [("phone", "1"), ("email", "e")], [("female", [("phone", "c1"), ("fax", "c2")])], ("Organization/o1",), (1.0,), None, [("u1", "c1"), ("u2", None)]),
            ("p2", False, None, "1990-05-20", [], None, None, ("Practitioner/x",), None, "text", None),
            ("p3", None, "female", None, None, [], [(None, None)], None, None, None, []),
        ],
        PEOPLE,
    )


CONSTANTS = [
    ("1 + 2 * 3", 7), ("2 ^ 3 ^ 2", 512.0), ("-7 mod 3", -1), ("10 div 3", 3), ("7 / 0", None), ("'abc'.substring(1)", "bc"), ("'abc'.substring(9)", None), ("'abc'.indexOf('z')", -1),
    ("('x' | 'y' | 'x').count()", 2), ("{1,2,3}.where($this > 1).count()", 2), ("{1,2,3}.aggregate($this + $total, 0)", 6.0), ("{1,2}.combine({2,3}).count()", 4), ("{1,2,2}.exclude({2}).count()", 1),
    ("{1,2}.intersect({2,3}).first()", 2), ("{true,false}.allTrue()", False), ("{true,false}.anyTrue()", True), ("{1,2,3}.tail().count()", 2), ("{1,2,3}.skip(5).count()", 0), ("{1,2,3}.take(2).last()", 2),
    ("{1,2}.single().empty()", True), ("{1,1,2}.duplicates().first()", 1), ("{1,2,3}.isSorted()", True), ("{1,2,3}.subsetOf({1,2,3,4})", True), ("iif(1 > 2, 'a', 'b')", "b"), ("'5 mg'.toQuantity().unit", "mg"), ("'x'.toInteger().empty()", True),
    ("'y'.toBoolean()", True), ("'2010'.convertsToDate()", True), ("1.0.lowBoundary()", 0.95), ("1.0.highBoundary()", 1.05), ("'2010-10'.highBoundary()", "2010-10-31"), ("'12:34'.lowBoundary()", "12:34:00.000"), ("'2010-10-10'.lowBoundary()", "2010-10-10T00:00:00.000+14:00"),
    ("years between @2000-05-01 and @2020-04-30", 19), ("difference in years between @2000-05-01 and @2020-04-30", 20), ("Interval[1,5] overlaps Interval[5,7]", True), ("Interval[1,5) overlaps Interval[5,7]", False), ("3 during Interval[1,5]", True),
    ("Interval[1,2] meets Interval[3,4]", True), ("Interval[1,2] before Interval[3,4]", True), ("Interval[2,3] starts Interval[2,9]", True), ("Interval[8,9] ends Interval[2,9]", True), ("Interval[1,9] properly includes Interval[1,9]", False), ("(Interval[1,4] intersect Interval[3,9]).low", 3),
    ("(Interval[1,9] except Interval[3,4]).count()", 2), ("(collapse {Interval[1,3], Interval[2,5], Interval[7,8]}).count()", 2), ("width of Interval[3,9]", 6.0), ("null implies true", True), ("null and false", False), ("(null xor true).empty()", True),
    ("Median({1,2,3,10})", 2.5), ("Mode({3,1,1,3})", 1.0), ("Percentile({1,2,3,4,5}, 50)", 3.0), ("Coalesce(null, 'z')", "z"), ("'a' & null", "a"), ("('a' + null).empty()", True), ("'A ' ~ 'a'", True), ("case when 1 > 2 then 'a' else 'b' end", "b"),
    ("{1,2,3,4}.partitionBy($this > 1).matching.count()", 3), ("{1,2,3}.groupBy($this mod 2).count()", 2), ("Predecessor(3)", 2), ("Successor(@2020-12-31)", __import__("datetime").date(2021, 1, 1)), ("year from Today()", 2024), ("(-1).sqrt().empty()", True), ("1 in {1, 2}", True),
    ("@2020-01-01 same month as @2020-01-20", True), ("@2020-01-31 + 1 month > @2020-02-28", True), ("'a,b'.split(',').last()", "b"), ("'aXbX'.replace('X', '-')", "a-b-"), ("'abc'.matches('^a.c$')", True), ("{3,1,2}.sortBy($this).first()", 1), ("'x y'.urlEncode()", "x+y"),
]


def test_expressions(spark):
    one = spark.createDataFrame([("x",)], "id string")
    cols = [compile_path(p, one.schema, as_of="2024-01-02 03:04:05").one().col.alias(f"c{k}") for k, (p, _) in enumerate(CONSTANTS)]
    row = one.select(*cols).first()
    for k, (p, want) in enumerate(CONSTANTS):
        assert row[k] == (pytest.approx(want) if isinstance(want, float) else want), p


@pytest.mark.parametrize("text", ["", "a.", "a(", "1 +", "name[", "'x", "#", "a b", None])
def test_texts_that_are_no_expressions(text):
    with pytest.raises(PathError):
        parse(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


PATHS = [
    ("name.family", ["F1", None, None]), ("name.where(use = 'usual').family", ["F2", None, None]), ("name.given.join(',')", ["g1,g2", "", ""]), ("name.exists()", [True, False, False]), ("telecom.empty()", [False, True, True]),
    ("contact.telecom.where(system = 'fax').value", ["c2", None, None]), ("managingOrganization.getReferenceKey(Organization)", ["Organization/o1", None, None]), ("getResourceKey() = 'Patient/p1'", [True, False, False]), ("value.ofType(Quantity).value > 0", [True, None, None]),
    ("value.ofType(string)", [None, "text", None]), ("extension('u1').valueCode", ["c1", None, None]), ("active.not()", [False, True, None]), ("name[1].family", ["F2", None, None]), ("name.select(given).count()", [2, 0, 0]), ("Patient.birthDate.lowBoundary()", ["1970-06-01", "1990-05-20T00:00:00.000+14:00", None]), ("nothing.at.all", [None, None, None]),
]


def test_paths(people):
    for path, want in PATHS:
        got = [r.v for r in people.select("id", compile_path(path, people.schema, "Patient").one().col.alias("v")).orderBy("id").collect()]
        assert got == want, path


def test_views(people):
    base = {"column": [{"name": "id", "path": "id"}]}
    view = {"resource": "Patient", "select": [base, {"forEachOrNull": "contact", "select": [{"forEach": "telecom", "column": [{"name": "v", "path": "value"}]}]}]}
    assert rows(view_rows(people, view)) == [("p1", "c1"), ("p1", "c2"), ("p2", None)]
    union = {"unionAll": [{"forEach": "telecom", "column": [{"name": "s", "path": "system"}]}, {"forEach": "contact.telecom", "column": [{"name": "s", "path": "system"}]}]}
    assert rows(view_rows(people, {"resource": "Patient", "select": [base, union]})) == [("p1", "email"), ("p1", "fax"), ("p1", "phone"), ("p1", "phone")]
    made = ViewBuilder("Patient").columns(given="name.given.join(' ')", pid="id").where("gender = %g").constant("g", valueCode="male").build()
    assert view_rows(people, made).columns == ["given", "pid"] and rows(view_rows(people, made)) == [("g1 g2", "p1")]
    coll = {"resource": "Patient", "select": [{"column": [{"name": "g", "path": "name.given", "collection": True}, {"name": "n", "path": "id", "type": "string"}]}]}
    assert rows(view_rows(people, coll)) == [(["g1", "g2"], "p1"), ([], "p2"), ([], "p3")]
    assert view_rows(people.limit(0), view).count() == 0


@pytest.mark.parametrize(
    "view",
    [
        {"select": [{"column": [{"name": "id", "path": "id"}]}]}, {"resource": "Patient"}, {"resource": "Patient", "select": [{"column": [{"name": "a b", "path": "id"}]}]}, {"resource": "Patient", "select": [{"column": [{"name": "a", "path": "id."}]}]},
        {"resource": "Patient", "select": [{"column": [{"name": "a", "path": "name.family", "collection": False}]}]}, {"resource": "Patient", "select": [{"column": [{"name": "a", "path": "id"}, {"name": "a", "path": "id"}]}]}, {"resource": "Patient", "select": [{"forEach": 3, "column": [{"name": "a", "path": "id"}]}]},
        {"resource": "Patient", "select": [{"unionAll": [{"column": [{"name": "a", "path": "id"}]}, {"column": [{"name": "b", "path": "id"}]}]}]}, {"resource": "Patient", "where": [{"path": "name.family"}], "select": [{"column": [{"name": "a", "path": "id"}]}]}, {"resource": "Patient", "constant": [{"name": "x"}], "select": [{"column": [{"name": "a", "path": "id"}]}]},
    ],
)
def test_views_that_are_errors(people, view):
    with pytest.raises(ViewError):
        view_rows(people, view)


def test_presets_compile(people):
    for name in ("patient_demographics", "patient_contacts"):
        view_rows(people, preset(name)).collect()
    assert set(PRESETS) >= {"observation_values", "lab_results", "vital_signs"}
    with pytest.raises(PathError):
        compile_path("%missing", people.schema)


def population(spark):
    p = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, kind string")
    o = spark.createDataFrame([("Patient/a", 1.0, [("s", "k1")]), ("Patient/a", 3.0, [("s", "k2")]), ("Patient/b", None, None)], "ref string, v double, codes array<struct<system:string,code:string>>")
    o = o.select(F.struct(F.col("ref").alias("reference")).alias("subject"), "v", F.struct(F.col("codes").alias("coding")).alias("code"))
    return Population({"Patient": p, "Observation": o}, terms.value_set(spark, "vs", [("s", "k2")]), "2024-01-01 00:00:00")


def test_statements(spark):
    pop = population(spark)
    ask = lambda t: rows(pop.query(t))
    assert ask("[Patient] p with [Observation] o such that o.subject references p return p.id") == [("a",), ("b",)]
    assert ask("[Patient] p without [Observation] o such that o.subject references p return p.id") == [("c",)]
    assert ask('[Observation: "vs"] o return o.v') == [(3.0,)]
    assert ask("Sum([Observation] o return o.v)") == [(4.0,)] and ask("Count([Patient])") == [(3,)]
    assert ask("[Patient] p let k: p.kind, n: k + '!' where k = 'x' return {id: p.id, n: n} sort by id desc") == [("a", "x!"), ("c", "x!")]
    assert ask("[Patient] p return distinct p.kind") == [("x",), ("y",)]
    assert ask("([Patient] p return p.id) except ([Observation] o return o.subject.reference.split('/').last())") == [("c",)]
    assert ask("from [Patient] p, [Observation] o where o.subject references p and o.v > 1 return {id: p.id, v: o.v}") == [("a", 3.0)]
    assert ask("[Observation] o aggregate t starting 1: t * Coalesce(o.v, 1.0)") == [(3.0,)]
    assert ask("exists([Patient] p where p.kind = 'z')") == [(False,)]
    pop.define("X", "[Patient] p where p.kind = 'x'").define("Ids", "X y return y.id").define("Loop", "Loop l")
    assert rows(pop.run("Ids")) == [("a",), ("c",)]
    for bad in ("Loop", "Nothing"):
        with pytest.raises(PathError):
            pop.run(bad)
    with pytest.raises(PathError):
        pop.query("[Nothing] n")


def test_measures(spark):
    s = spark.createDataFrame([("a", True, True, False), ("b", True, False, False), ("c", True, False, True), ("d", False, True, False), ("e", True, None, None)], "id string, den boolean, num boolean, excl boolean")
    m = Measure("m", "proportion", {"denominator": "den", "numerator": "num", "denominator-exclusion": "excl"})
    r = proportion(population_counts(membership(s, m))).first()
    assert (r.numerator_count, r.denominator_count, r.initial_population) == (1, 3, 5) and r.score == pytest.approx(100 / 3)
    assert (r.ci_low / 100, r.ci_high / 100) == pytest.approx(wilson(1, 3))
    assert proportion(population_counts(membership(s.limit(0), m))).first().score is None
    assert '"MeasureReport"' in measure_report(population_counts(membership(s, m)), m, ("2024-01-01", "2024-12-31")).first().report
    with pytest.raises(ValueError):
        membership(s, Measure("x", criteria={"nothing": "true"}))


def test_store_and_terminology(spark, tmp_path):
    import json

    docs = [{"resourceType": "Patient", "id": "1", "name": [{"family": "A"}]}, {"resourceType": "Device", "id": "2"}]
    (tmp_path / "list.json").write_text(json.dumps(docs))
    (tmp_path / "bundle.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": d} for d in docs]}))
    (tmp_path / "one.json").write_text(json.dumps(docs[0]))
    (tmp_path / "lines.ndjson").write_text("\n".join(map(json.dumps, docs)) + "\n{broken\n")
    read = store.read_documents(spark, [str(tmp_path / n) for n in ("list.json", "bundle.json", "one.json")])
    assert rows(read.select("id", "resource_type")) == [("1", "Patient")] * 3 + [("2", "Device")] * 2
    lines = store.read_lines(spark, str(tmp_path / "lines.ndjson"))
    store.save(lines.unionByName(store.insert(spark, docs[:1])), str(tmp_path / "s"))
    assert rows(store.resource_counts(store.load(spark, str(tmp_path / "s")))) == [("Device", 1), ("Patient", 2)]
    typed = store.typed(lines, "Patient", "struct<" + store.inferred_schema(lines, "Patient") + ">")
    assert rows(view_rows(typed, {"resource": "Patient", "select": [{"column": [{"name": "f", "path": "name.family"}]}]})) == [("A",)]
    got = store.run_batch({"a": lines, "b": lines.withColumn("id", F.raise_error(F.lit("x")))}, str(tmp_path / "o"), "csv")
    assert got[0].rows and got[1].error
    closure = terms.subsumption_closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "parent string, child string"))
    assert ("a", "d") in rows(closure) and ("d", "d") in rows(closure) and closure.count() == 10


def test_typed_reads_wrapped_documents_and_lone_values(spark):
    import json

    listed = {"id": "1", "code": {"coding": [{"code": "A", "n": ["x", None]}, {"code": "B"}]}}
    lone = {"id": "2", "code": {"coding": {"code": "C", "n": "y"}}}
    bare = [{"id": "4", "code": {"coding": None}}, {"id": "5", "code": None}, {"id": "6", "code": {"coding": []}}]
    texts = [json.dumps(listed), json.dumps(lone), json.dumps(json.dumps(lone | {"id": "3"})), *map(json.dumps, bare), "{broken", '"text"', "[1]", "null", None]
    store_rows = spark.createDataFrame([(str(k), "Observation", t) for k, t in enumerate(texts)], store.STORE)
    got = store.typed(store_rows, "Observation", "struct<id:string,code:struct<coding:array<struct<code:string,n:array<string>>>>>").selectExpr("id", "code.coding.code as c", "code.coding.n as n")
    assert {r.id: (r.c, r.n) for r in got.collect()} == {
        "1": (["A", "B"], [["x", None], None]), "2": (["C"], [["y"]]), "3": (["C"], [["y"]]), "4": (None, None), "5": (None, None), "6": ([], []),
    }


@pytest.mark.parametrize("most", [1000, 1])
def test_codes_without_system_match_any_system_in_value_sets_of_any_size(spark, monkeypatch, most):
    from carex.plans import population

    monkeypatch.setattr(population, "MOST_CODES", most)
    coded = [(1, [("s", "A")]), (2, [("t", "A")]), (3, [("t", " H ")]), (4, [(None, "H")]), (5, [("t", "B"), ("s", "C")]), (6, None), (7, []), (8, [(None, "A")])]
    obs = spark.createDataFrame([(k, (c,)) for k, c in coded], "id int, code struct<coding:array<struct<system:string,code:string>>>")
    sets = terms.value_set(spark, "v", [("s", "A"), (None, "H"), ("s", "C")])
    assert rows(population.Population({"Observation": obs}, sets).query('[Observation: "v"] o return o.id')) == [(1,), (3,), (4,), (5,)]


def test_ages_and_boundaries_of_all_texts(spark, tmp_path):
    from carex import catalog_functions as functions

    zero, end = "T00:00:00.000+14:00", "T23:59:59.999-12:00"
    cases = {  # birth date: (low, high, age on 2025-07-01)
        "1954": ("1954-01-01", "1954-12-31", None), "1962-10": ("1962-10-01", "1962-10-31", 62), "2024-02": ("2024-02-01", "2024-02-29", 1), "2023-13": (None, None, None),
        "2004-02-29": ("2004-02-29" + zero, "2004-02-29" + end, 21), "1990-06-30": ("1990-06-30" + zero, "1990-06-30" + end, 35), "1990-07-31": ("1990-07-31" + zero, "1990-07-31" + end, 34),
        "1893-11-23": ("1893-11-23" + zero, "1893-11-23" + end, 131), "1971-02-30": (None, None, None), "1900-00-00": (None, None, None), "04/05/1946": (None, None, None), "20071212": (None, None, None), "unknown": (None, None, None), None: (None, None, None),
        "1998-02-08T00:00:00.000": ("1998-02-08" + zero, "1998-02-08T00:00:00.000-12:00", 27), "1998-02-08T10:30Z": ("1998-02-08T10:30:00.000Z", "1998-02-08T10:30:59.999Z", 27),
    }
    spark.createDataFrame([(str(t), t) for t in cases], "id string, birthDate string").write.parquet(str(tmp_path / "patient.parquet"))
    bounds = {r.id: (r.low, r.high) for r in functions.path_boundaries(spark, str(tmp_path)).collect()}
    ages = {r.id: r.age for r in functions.date_ages(spark, str(tmp_path)).collect()}
    assert {t: (*bounds[t], ages[t]) for t in bounds} == {str(t): c for t, c in cases.items()}


def test_stream_of_a_view(spark, people, tmp_path):
    from carex.streaming.flows import stream_of, stream_view

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    people.write.parquet(src)
    view = {"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}]}, {"forEach": "telecom", "column": [{"name": "v", "path": "value"}]}]}
    for _ in range(2):  # a second run finds nothing new
        stream_view(stream_of(spark, src, people.schema), view, out, str(tmp_path / "ck")).awaitTermination(120)
    assert rows(spark.read.parquet(out)) == rows(view_rows(people, view))


LIBRARY = """
library Diabetes version '1.2'
using FHIR version '4.0.1'
include Common version '1.0' called Base
// a comment
codesystem "Sys": 's'
valueset "vs": 'urn:vs'
parameter Least Integer default 2
parameter "Measurement Period" Interval<DateTime> default Interval[@2024-01-01, @2024-12-31]
context Patient
define "High": [Observation] o where o.v >= Least
define private Mine: [Observation: "vs"] o return o.v
define "Subjects": [Patient] p with "High" h such that h.subject references p return p.id
define Both: Base.Every e return e.id
"""


def test_libraries(spark):
    from carex.plans.library import Library, LibraryError, dependencies

    common = Library.parse("library Common version '1.0' define Every: [Patient] p where p.kind = 'x'")
    lib = Library.parse(LIBRARY)
    assert (lib.name, lib.version, lib.context, lib.value_sets) == ("Diabetes", "1.2", "Patient", {"vs": "urn:vs"})
    assert lib.private == {"Mine"} and dependencies(lib)["Subjects"] == {"High"}
    assert lib.order().index("High") < lib.order().index("Subjects")
    run = lib.bind(population(spark), {"Common": common})
    assert rows(run("Subjects")) == [("a",)] and rows(run("Mine")) == [(3.0,)] and rows(run("Both")) == [("a",), ("c",)]
    assert rows(lib.bind(population(spark), {"Common": common}, {"Least": 1})("Subjects")) == [("a",)]
    with pytest.raises(LibraryError):
        lib.bind(population(spark), {})
    with pytest.raises(LibraryError):
        lib.bind(population(spark), {"Common": common}, {"Unknown": 1})
    with pytest.raises(LibraryError):
        Library.parse("library A define X: Y y define Y: X x").order()
