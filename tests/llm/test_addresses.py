import itertools

from carex.llm import addresses as A

PATIENT = "id string, address array<struct<use:string,line:array<string>,city:string,state:string,postalCode:string,country:string>>, zip string, pos int, house string"


def entry(line, city="Glenwick", state="NC", code="49006"):
    return (None, line if isinstance(line, list) else [line], city, state, code, None)


def pairs(spark, rows):
    df = spark.createDataFrame([(i, a, "z", 7, "h") for i, a in rows], PATIENT)
    return {tuple(r) for r in A.place_pairs(df).collect()}


SAME = [
    entry("12 North Waltadeland Boulevard Apt 3"), entry("12 N Waltadeland Blvd # 3"), entry(["c/o Front Desk", "Unit 3, 12 North Waltdaeland Boulevard"]),
    entry("12 Waltadeland Boulevard", code="49006-1234"), entry(["12 NORTH WALTADELAND BLVD, APT. 3, GLENWICK, NC 49006"], None, None, None), entry("12 North Waltadeland", city="Glenwik", code=None),
]
OTHERS = [
    entry("14 North Waltadeland Boulevard Apt 3"), entry("12 South Waltadeland Boulevard Apt 4"), entry("12 North Waltadeland Lane Apt 5"), entry("12 North Pelgridaden Boulevard"),
    entry("12 North Waltadeland Boulevard Apt 3", "Redwick", "VA", "33126"),
]


def test_one_place_and_others(spark, monkeypatch):
    rows = [(f"p{k}", [e]) for k, e in enumerate(SAME + OTHERS)] + [("x", None), (None, [SAME[0]]), ("y", [None, entry("Nowhere", None, None, None)]), ("p0", [SAME[0]])]
    streets = "Elm Oak Ashe Birch Cedar Maple Poplar Linden Willow Walnut Hazel".split()
    places = [(f"{k} {n} Blvd", f"{k} {n} Boulevard") for k, n in enumerate(streets, 60)]
    rows += [(f"q{k}{j}", [entry(s, "Millwick", "TX", f"29{k:03d}")]) for k, p in enumerate(places) for j, s in enumerate((*p, p[1]))]
    got = pairs(spark, rows)
    mine = {g for g in got if g[0].startswith("p")}
    missing = {("p3", 0, "p7", 0), ("p5", 0, "p8", 0)}  # parts that one of two lacks contradict nothing
    assert mine == {(f"p{a}", 0, f"p{b}", 0) for a, b in itertools.combinations(range(len(SAME)), 2)} | missing
    assert len(got) - len(mine) == 3 * len(places)
    monkeypatch.setattr(A, "mine_rewrites", lambda *a: {})
    unmined = pairs(spark, rows)
    assert len({g for g in unmined if g[0].startswith("q")}) == len(places) and ("p0", 0, "p1", 0) not in unmined


def test_german_streets_and_entries_of_one_patient(spark):
    got = pairs(spark, [("a", [entry("Waltadelandstraße 12", "Steintal", None, "53405"), None, entry("Waltadeland-Str. Nr. 12, D-53405 Steintal", None, None, None)]), ("b", [entry("Waltadelandweg 12", "Steintal", None, "53405")])])
    assert got == {("a", 0, "a", 2)}


def test_rewrites_are_mined(spark):
    rows = [(f"z{k}", str(k), s, n) for k in range(8) for s, n in ((f"oak{'abcdefgh'[k] * 3} plz", 1), (f"oak{'abcdefgh'[k] * 3} plaza", 2))] + [("z9", "9", "elmm qd", 1), ("z9", "9", "elmm quad", 2)]
    assert A.mine_rewrites(spark.createDataFrame(rows, "zip string, house string, street string, n long")) == {"plz": "plaza"}


def test_empty_table(spark):
    assert pairs(spark, []) == set()


def test_streets_of_numbers_letters_and_two_words(spark):
    lines = ["12 5th Avenue", "12 6th Avenue", "12 5th Avenue", "12 K Street", "12 L Street", "12 K Street", "12 Cherry Hill Road", "12 Cherry Park Road", "12 Cherry Hil Road"]
    got = pairs(spark, [(f"p{k}", [entry(x)]) for k, x in enumerate(lines)])
    assert got == {("p0", 0, "p2", 0), ("p3", 0, "p5", 0)}  # Hil and Hill are too short for a slip


def test_columns_and_functions_agree(spark):
    """The column tests say what the functions on dicts say, or nothing."""
    from pyspark.sql import functions as F

    words = ["", "oak", "oka", "boulevard", "boulevrad", "bouelvrad", "lane", "lanes", "place", "plaec", "harbour"]
    rows = [(a, b) for a in words for b in words if a and b]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", A.alike(F.col("a"), F.col("b")).alias("same"))
    told = [r for r in df.collect() if r.same is not None]
    assert all(r.same == A._alike(r.a, r.b) for r in told) and len(told) > 0.9 * len(rows)


def test_common_number_and_street_in_many_towns_stays_linear(spark):
    rows = [(f"t{k}{j}", [entry(x, f"Town{chr(97 + k % 26)}{chr(97 + k // 26)}burgh", "NC", f"{10000 + k}")]) for k in range(600) for j, x in enumerate(("12 Main Street", "12 Main Stret"))]
    df = spark.createDataFrame([(i, a, "z", 7, "h") for i, a in rows], PATIENT)
    laid = A.laid_writings(A.identified(A._entries(df)))
    assert A.writing_links(laid).count() == 600
    classes = A.place_writings(df).agg({"entries": "sum", "linked_writings": "sum", "pairs": "sum"}).first()
    assert sorted(classes) == [0, 1200, 1200]
