import random

from pyspark.sql import functions as F

from carex.operators.units import common_quantities

OBS = """row_no long, id string, code struct<coding:array<struct<system:string,code:string,display:string>>,text:string>, subject struct<reference:string>,
 valueQuantity struct<value:decimal(18,4),unit:string,system:string,code:string>, valueString string, note array<struct<text:string>>, unit_code string, factor double"""
LOINC, LOCAL = "urn:oid:2.16.840.1.113883.6.1", "http://lab.example.org/local"


def run(spark, rows):
    targets = spark.createDataFrame([("w", "Body weight", "kg", 1), ("h", "Height", "cm", 0)], "loinc_code string, display string, common_unit string, decimals int")
    conv = spark.createDataFrame(
        [("w", "kg", 1.0, 0.0), ("w", "[lb_av]", 0.453592, 0.0), ("w", "[stone_av]", 6.350293, 0.0), ("h", "cm", 1.0, 0.0), ("h", "[in_i]", 2.54, 0.0), ("h", "[ft_i]", 30.48, 0.0)],
        "loinc_code string, unit_code string, factor double, shift double",
    )
    out = common_quantities(spark.createDataFrame(rows, OBS), targets, conv).collect()
    return {r.row_no: (r.loinc_code, r.scaled_value) for r in out}


def obs(n, code="w", value=None, unit=None, ucum=None, text=None, string=None, note=None, system=LOINC, patient="p", more=()):
    from decimal import Decimal

    q = (Decimal(str(value)), unit, None, ucum) if value is not None or unit or ucum else None
    return (n, f"o{n}", ([(system, code, None), *more], text), (f"Patient/{patient}",), q, string, note, "clash", 9.0)


def test_units_from_every_field(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):  # spellings beside their codes
        kg = rng.uniform(50, 100)
        unit, ucum, f = rng.choice([("kilos", "kg", 1), ("LBS", "[lb_av]", 1 / 0.453592), ("stones", "[stone_av]", 1 / 6.350293)])
        rows.append(obs(1000 + i, value=round(kg * f, 3), unit=unit, ucum=ucum, patient=f"p{i % 30}"))
    rows += [
        obs(1, value=80, unit="Kilos "), obs(2, value=100, unit="lbs."), obs(3, value=100, ucum="[lb_av]"), obs(4, value=80), obs(5, value=80, unit="points"),
        obs(6, string="result: 81,5 kilos"), obs(7, string="12 stones 3 lbs"), obs(8, value=80, text="Body weight (kilos)"), obs(9, value=80, note=[(None,), ("value given in kilos",)]),
        obs(10, string="no number"), obs(11, code=" w ", value=80, unit="kg"), obs(12, code="WGT", system=LOCAL, value=80, unit="kg", more=[(LOINC, "w", None)]),
        obs(13, code="WGT", system=LOCAL, value=81, unit="kg"), obs(14, code="??", system=LOCAL, value=81, unit="kg"), obs(15, code="h", string="5' 6\""),
        obs(16, code="h", value=80, ucum="kg"), (17, None, None, None, None, None, None, None, None),
    ]
    got = run(spark, rows)
    want = {1: 800, 2: 454, 3: 454, 6: 815, 7: round((12 * 6.350293 + 3 * 0.453592) * 10), 8: 800, 9: 800, 11: 800, 12: 800, 13: 810}
    assert {k: v[1] for k, v in got.items() if k < 15} == want
    assert got[15] == ("h", 168) and 16 not in got and 17 not in got


def test_empty_tables(spark):
    assert run(spark, []) == {}


def test_estimate_decides_without_codes(spark, monkeypatch):
    """No row writes a code beside "zork"; its numbers are pounds. "points" holds several units at once."""
    from carex.operators import units

    rng, rows = random.Random(2), []
    for i in range(400):
        patient, kg = f"p{i}", rng.uniform(50, 110)
        rows.append(obs(1000 + i, value=round(kg, 2), ucum="kg", patient=patient))
        if i < 200:
            rows.append(obs(2000 + i, value=round(rng.uniform(50, 110) / 0.453592, 2), unit="Zork", patient=patient))
        else:
            rows.append(obs(3000 + i, value=round(rng.uniform(50, 110) * rng.choice([1, 2.2046, 0.1575]), 2), unit="points", patient=patient))
    rows.append(obs(1, value=100, unit="zork"))
    got = run(spark, rows)
    assert got[1] == ("w", 454) and sum(2000 <= k < 3000 for k in got) == 200 and not any(k >= 3000 for k in got)
    monkeypatch.setattr(units, "misfit", lambda scale, offset: F.lit(None).cast("double"))
    assert 1 not in run(spark, rows)


def test_texts_are_read_by_learned_frames(spark):
    rows = [obs(n, note=[(f"taken as {u} today",)], value=70) for n, u in enumerate(["kg", "kilos", "LBS", "gallons"])]
    rows += [obs(100 + k, value=70, unit=u, ucum=c) for k, (u, c) in enumerate([("kilos", "kg"), ("lbs", "[lb_av]"), ("stones", "[stone_av]")])]
    rows += [obs(50, value=70, note=[("kg taken as told",)]), obs(51, value=11, note=[("taken as stones today",)])]
    got = run(spark, rows)
    assert {k for k in got if k < 100} == {0, 1, 2, 51} and got[2] == ("w", 318)


def test_any_source_can_be_the_partner(spark):
    """ "zork" (pounds) shares patients with pounds only, "blorp" (stones) with "zork" only; four other sources are larger.

    "points" fits what it shares with "blorp", but not the more patients that it shares with kilograms.
    """
    rng, rows = random.Random(3), []
    for i in range(300):
        kg = rng.uniform(50, 110)
        for k, (unit, ucum, f) in enumerate([("kilos", "kg", 1), ("stones", "[stone_av]", 1 / 6.350293)]):
            rows.append(obs(10000 + 2 * i + k, value=round(kg * f, 3), unit=unit, ucum=ucum, patient=f"p{i}"))
        if i < 200:
            rows.append(obs(50000 + i, value=round(kg * rng.choice([1, 2.2046, 0.1575]), 2), unit="points", patient=f"p{i}"))
    for i in range(200):
        kg, patient = rng.uniform(50, 110), f"q{i}"
        if i < 80:
            rows.append(obs(20000 + i, value=round(kg / 0.453592, 2), ucum="[lb_av]", patient=patient))
        if i < 150:
            rows.append(obs(30000 + i, value=round(kg / 0.453592, 2), unit="zork", patient=patient))
        if i >= 80:
            rows.append(obs(40000 + i, value=round(kg / 6.350293, 3), unit="blorp", patient=patient))
        if i >= 140:
            rows.append(obs(60000 + i, value=round(kg, 2), unit="points", patient=patient))
    rows += [obs(1, value=100, unit="zork"), obs(2, value=10, unit="blorp"), obs(3, value=80, unit="points")]
    got = run(spark, rows)
    assert got[1] == ("w", 454) and got[2] == ("w", 635) and 3 not in got
    assert len([k for k in got if 30000 <= k < 50000]) == 150 + 120 and not any(k >= 50000 for k in got)


def test_every_pair_of_sources_is_an_edge(spark):
    from carex.operators import units

    rng, means = random.Random(4), {}
    for e in range(150):
        for s in rng.sample(range(12), rng.randint(4, 11)) if e else range(12):
            means[e, f"s{s:02}"] = rng.uniform(1, 9)
    rows = [(f"e{e}", "w", s, v + d) for (e, s), v in means.items() for d in (-0.5, 0.5)]  # two rows, one mean
    rows += [(f"e{e}", "w", "rare", 1.0) for e in range(units.LEAST_LINKS - 1)] + [(None, "w", "s00", 1.0)]
    got = units.source_graph(spark.createDataFrame(rows, "entity string, loinc_code string, label string, value double")).collect()
    shared = {}
    for (e, a), v in means.items():
        for b in {s for x, s in means if x == e and s != a}:
            shared.setdefault((a, b), []).append((v, means[e, b]))
    want = {k: v for k, v in shared.items() if len(v) >= units.LEAST_LINKS}
    assert len(want) > 2 * 4 * 12 and {(r.label, r.partner): r.links for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        xs, ys = (sorted(p[k] for p in want[r.label, r.partner]) for k in (0, 1))
        middle = (len(xs) + 1) // 2 - 1
        assert abs(r.qx[2] - xs[middle]) < 1e-9 and abs(r.qy[2] - ys[middle]) < 1e-9
