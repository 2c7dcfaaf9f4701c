import itertools
import random

from carex.llm import names as N

PATIENT = """id string, name array<struct<use:string,family:string,given:array<string>>>, gender string, birthDate string, telecom array<struct<system:string,value:string,use:string>>,
 address array<struct<use:string,line:array<string>,city:string,state:string,postalCode:string,country:string>>, source_system string, features string, probe string"""


def patient(i, family, given, born=None, phone=None, mail=None, gender="female", line=None, code=None):
    telecom = [("phone", phone, None)] * bool(phone) + [("email", mail, None)] * bool(mail)
    return (i, [("official", family, given)], gender, born, telecom or None, [(None, [line], None, None, code, None)] if line else None, "s", "f", "p")


def pairs(spark, rows):
    sites = spark.createDataFrame([("s", "UTC", "en-GB")], "source_system string, zone_name string, locale string")
    return {tuple(r) for r in N.person_pairs(spark.createDataFrame(rows, PATIENT), sites).collect()}


def distance(a, b):
    rows = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def mistyped(rng, word, edits):
    for _ in range(edits):
        k, kind = rng.randrange(len(word)), rng.randrange(3)
        word = word[:k] + ("" if kind == 0 else rng.choice("abcxyz") + (word[k:] if kind == 1 else "")) + (word[k + 1 :] if kind != 1 else "")
        word = word or "a"
    return word


def test_banded_distance_equals_the_full_one():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        b = mistyped(rng, a or "a", rng.randint(0, 4))
        for most in (1, 2):
            assert N.edits(a, b, most) == min(distance(a, b), most + 1)


def test_segments_lose_no_part_within_its_edits():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 14)))
        b = mistyped(rng, a, rng.randint(0, 2))
        if len(b) >= 3 and lev(a, b) <= N.allowed(len(a)):
            assert set(N.index_keys(a)) & set(N.probe_keys(b)), (a, b)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_variants_and_look_alikes(spark):
    rows = [
        patient("a1", "Thornbury", ["Margaret", "Ann"], "1960-03-04", "212-555-0101"), patient("a2", "Thronbury", ["Peggy"], "04/03/1960", None),
        patient("a3", "Margaret", ["THORNBURY"], None, "2125550101"), patient("a4", "Thornbury, Dr Margaret A.", None, "1960", "(212) 555 0101"),
        patient("b1", "Thornbury", ["Josephine"], "1960-03-04", "212-555-0101"),  # a twin
        patient("c1", "Thornbury", ["Margaret", "Ann"], "1988-10-12", "212-555-0177", line="9 Elm Road", code="12345"),  # her daughter
        patient("d1", "Thornbury", ["Margaret", "Ann"], "1975-01-02", "646-555-0999"),  # a namesake
        patient("e1", None, None), (None, None, None, None, None, None, None, None, None), patient("f1", "Xu", ["Li"], "1960-03-04", "212-555-0101"),
        patient("a1", "Thornbury", ["Margaret", "Ann"], "1960-03-04", "212-555-0101"),  # delivered again
    ]
    assert pairs(spark, rows) == set(itertools.combinations(("a1", "a2", "a3", "a4"), 2))


def test_empty_table(spark):
    assert pairs(spark, []) == set()


def test_every_part_of_a_name_is_looked_up(spark):
    rows = [
        patient("a1", "Montgomery-Smythe", ["Ann", "Elizabeth"], "1960-03-04", None, "ann@example.org"),
        patient("a2", "Cook", ["Ann"], "1960-03-04", None, "ann@example.org"),
    ]
    assert pairs(spark, rows) == {("a1", "a2")}


def test_long_chains_come_out_whole(spark):
    phones = [("phone", f"212-555-01{k:02}", None) for k in range(9)]
    rows = [patient(f"a{k}", "Thornbury", ["Margaret"])[:4] + (phones[k : k + 2],) + patient("", "", [])[5:] for k in range(8)]
    assert pairs(spark, rows) == set(itertools.combinations([f"a{k}" for k in range(8)], 2))


def test_short_names_and_other_scripts(spark):
    facts = ("1960-03-04", "212-555-0101")
    rows = [patient("a1", "Wu", ["Li"], *facts), patient("a2", "Wu", ["Li"], *facts), patient("a3", "Li", ["Wu"], *facts)]
    rows += [patient("b1", "王", ["芳"], "1970-05-06", "212-555-0102"), patient("b2", "王", ["芳"], "1970-05-06", "212-555-0102")]
    rows += [patient("c1", "Ng", ["Bo"], "1980-05-06", "212-555-0103"), patient("c2", "Ng", ["Bo"], "1980-05-06", "212-555-0103"), patient("d1", "Wu", ["An"], "1999-03-04", "212-555-0101")]
    assert pairs(spark, rows) == {*itertools.combinations(("a1", "a2", "a3"), 2), ("b1", "b2"), ("c1", "c2")}


def test_twins_with_a_family_name_of_two_parts(spark):
    facts = ("1960-03-04", "212-555-0101")
    rows = [patient("a1", "Garcia Lopez", ["Lukas"], *facts), patient("a2", "Garcia Lopez", ["Olivier"], *facts), patient("b1", "Mc Tamber", ["Ann"], *facts), patient("b2", "Mc Tamber", ["Zoe"], *facts)]
    assert pairs(spark, rows) == set()


def test_planted_variants_are_found(spark):
    """Typos, swapped parts, initials and missing facts, planted into invented people: recall and precision."""
    rng, rows, want = random.Random(5), [], set()
    syllables = "bar del fen gor hal jen kir lom mar nor pel quin ros sel tor ul ver wen yar zan".split()
    for k in range(250):
        family, given, second = ("".join(rng.choices(syllables, k=n)).capitalize() for n in (3, 3, 2))
        born, phone, mail = f"19{rng.randint(30, 99)}-{rng.randint(1, 12):02}-{rng.randint(13, 28)}", f"212-{rng.randint(200, 999)}-{k:04}", f"{given}.{k}@example.org"
        variants = [
            patient(f"{k:03}a", family, [given, second], born, phone, mail),
            patient(f"{k:03}b", mistyped(rng, family, 1), [given], born, phone),
            patient(f"{k:03}c", given, [family], born, None, mail),
            patient(f"{k:03}d", family, [given[0] + "."], born, phone),
        ]
        rows += variants
        want |= set(itertools.combinations([v[0] for v in variants], 2))
        relative = "".join(rng.choices(syllables, k=3)).capitalize()
        rows.append(patient(f"{k:03}r", family, [relative], f"19{rng.randint(30, 99)}-{rng.randint(1, 12):02}-{rng.randint(1, 12):02}", phone, gender="male"))
    got = pairs(spark, rows)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.99 * len(got)
