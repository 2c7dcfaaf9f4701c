"""Variant spellings of names typed by people (problem 1).

Pigeonhole segment join: a part of a name that is indexed is cut into k+1 segments; two parts within k edits share at
least one of them, moved by few places. Segments go into an inverted index, the substrings of other names that could
be such segments are looked up in it, and what meets is verified with a banded edit distance. Names alone do not
tell persons apart, so each key of the index also holds something the two records share (a birth date with day and
month in either order, a telephone number, an e-mail address, postal code and house number): a key is as rare as
people of one name at one place, and no group grows with a common name or a common date alone.

Two records are one person if their names agree (family and given names in any order, nicknames, initials, missing
parts) and what they share outweighs what differs. Records that agree with a third one are compared again with a
milder rule, so that groups come out whole.

Null and edge cases: a row without id or without a name is in no pair; rows delivered again count once (a row of an
id is chosen by the order of its content). A single Latin letter is an initial and not indexed, unless the name has no
other part; parts of two letters (Wu Li) and single characters of other scripts are names and are looked up without
edits. A fact that only one record has is not multiplied with keys. Empty tables give no pairs. Extra columns are ignored. Names of any length are compared whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from carex.operators.timestamps import Normaliser
from carex.session import materialise

# Titles and particles that people add to names or leave out.
TITLES = frozenset("dr mr mrs ms miss prof professor herr frau mme monsieur madame sir jr sr ii iii iv md phd rev hon".split())
PARTICLES = frozenset("von van de der den di da do dos del della la le du of el al ten ter zu zum mc st".split())
# Nicknames and the given names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alexander", "alex": "alexander alexandra", "andy": "andrew", "annie": "anneliese anna",
    "barb": "barbara", "becca": "rebecca", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "beth": "elizabeth",
    "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine",
    "charlie": "charles", "chris": "christopher christina", "chuck": "charles", "cindy": "cynthia", "dan": "daniel",
    "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "don": "donald",
    "dot": "dorothy", "dottie": "dorothy", "drew": "andrew", "ed": "edward", "eddie": "edward", "ellie": "eleanor",
    "fran": "frances", "frank": "francis", "fred": "frederick", "freddie": "frederick", "fritz": "frederick friedrich",
    "greg": "gregory", "hank": "henry", "jack": "john", "jackie": "jacqueline", "jake": "jacob", "jen": "jennifer",
    "jenny": "jennifer", "jim": "james", "jimmy": "james", "jo": "josephine", "joe": "joseph", "joey": "joseph",
    "johnny": "john", "josie": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine",
    "larry": "lawrence", "lena": "eleanor magdalena", "lexi": "alexandra", "libby": "elizabeth", "liz": "elizabeth",
    "lizzie": "elizabeth", "lou": "louis louise", "maggie": "margaret", "mandy": "amanda", "marge": "margaret", "matt": "matthew",
    "max": "maximilian", "meg": "margaret", "mick": "michael", "mike": "michael", "mickey": "michael", "nate": "nathan",
    "ned": "edward", "nell": "eleanor", "nick": "nicholas", "nicky": "nicholas", "nora": "eleanor", "pam": "pamela",
    "pat": "patrick patricia", "patty": "patricia", "peg": "margaret", "peggy": "margaret", "pete": "peter", "polly": "mary",
    "rich": "richard", "rick": "richard", "ricky": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald",
    "sally": "sarah", "sam": "samuel samantha", "sammy": "samuel samantha", "sandy": "alexandra sandra", "steph": "stephanie",
    "steve": "steven stephen", "stevie": "steven", "sue": "susan", "susie": "susan", "suzy": "susan", "ted": "edward theodore",
    "terry": "terence theresa", "tim": "timothy", "timmy": "timothy", "toby": "tobias", "tom": "thomas", "tommy": "thomas",
    "tony": "anthony", "tori": "victoria", "trish": "patricia", "vicky": "victoria", "vic": "victor victoria", "wes": "wesley",
    "will": "william", "willy": "william", "zach": "zachary", "kit": "christopher", "topher": "christopher", "tina": "christina",
    "chrissy": "christina", "lex": "alexander", "sascha": "alexander", "harry": "henry harold", "hal": "harold",
    "tess": "theresa", "jamie": "james", "sasha": "alexander alexandra", "kathi": "katherine", "kitty": "katherine", "trixie": "beatriz", "bea": "beatriz", "bart": "bartholomew baptiste",
}
MOST_EDITS = 2


def fold(text: str) -> str:
    """Lower case without marks."""
    text = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in text if not unicodedata.combining(c))


def parts_of(text: str) -> list[str]:
    text = re.sub(r"\b([od])['’`]\s*", r"\1", fold(text))
    return [p for p in re.findall(r"[^\W\d_]+", text) if p not in TITLES]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbouring swaps, within a band of `most`; most + 1 if it is greater."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    before: list[int] = []
    last = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - most), min(m, i + most)
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        for j in range(low, high + 1):
            same = a[i - 1] == b[j - 1]
            d = min(last[j - 1] + (not same), last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = d
        if min(row[low - 1 : high + 1]) > most:
            return far
        before, last = last, row
    return min(last[m], far)


def allowed(length: int) -> int:
    """Edits that a part of a name of this length may have."""
    return 0 if length < 3 else 1 if length < 6 else MOST_EDITS


def segments(length: int) -> list[tuple[int, int]]:
    """(start, size) of the k+1 segments of a part of this length."""
    k = allowed(length) + 1
    size, longer = divmod(length, k)
    out, at = [], 0
    for i in range(k):
        n = size + (i >= k - longer)
        out.append((at, n))
        at += n
    return out


@lru_cache(maxsize=100_000)
def index_keys(part: str) -> tuple[str, ...]:
    """The keys under which a part is found: its length, and the place and letters of each segment."""
    return tuple(f"{len(part)}:{i}:{part[s : s + n]}" for i, (s, n) in enumerate(segments(len(part))))


@lru_cache(maxsize=100_000)
def probe_keys(part: str) -> tuple[str, ...]:
    """The keys at which parts within the allowed edits of this one can lie: lengths around its own, starts moved so
    far as the edits before and behind a segment permit."""
    out, n = [], len(part)
    for length in range(max(1, n - MOST_EDITS), n + MOST_EDITS + 1):
        k, shift = allowed(length), n - length
        if abs(shift) > k:
            continue
        for i, (s, size) in enumerate(segments(length)):
            low = max(0, s - i, s + shift - (k - i))
            high = min(n - size, s + i, s + shift + (k - i))
            out.extend(f"{length}:{i}:{part[p : p + size]}" for p in range(low, high + 1))
    return tuple(dict.fromkeys(out))


@lru_cache(maxsize=50_000)
def features_of(text: str) -> dict:
    """Features as they were written; a record is in several pairs of a batch."""
    return json.loads(text)


@lru_cache(maxsize=200_000)
def similar(a: str, b: str) -> bool:
    """Whether two parts are within the edits that the shorter one may have."""
    most = allowed(min(len(a), len(b)))
    return a == b or (most > 0 and edits(a, b, most) <= most)


def _full_names(part: str) -> list[str]:
    return [part, *NICKNAMES.get(part, "").split()]


@lru_cache(maxsize=200_000)
def same_given(a: str, b: str) -> float:
    """1 for one name, 0.9 for a typo or nickname, 0.5 for an initial, 0 for different names."""
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.5 if a[0] == b[0] else 0.0
    if similar(a, b):
        return 0.9
    for x in _full_names(a):
        for y in _full_names(b):
            if x == y or (min(len(x), len(y)) > 4 and similar(x, y)):
                return 0.9
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and (long.startswith(short) or (short[:3] == long[:3] and re.search(r"(?:ie|ey|y|i)$", short) and len(long) > 4)):
        return 0.9
    for x in NICKNAMES:  # a nickname with a slip
        if len(x) > 4 and edits(short, x, 1) <= 1 and any(y == long for y in NICKNAMES[x].split()):
            return 0.9
    return 0.0


def record(row: dict) -> dict | None:
    """What is compared of a patient: name parts, birth date, telephone numbers, e-mail addresses, places."""
    family, given = [], []
    for name in row["name"] or []:
        if name is None:
            continue
        f, g = name["family"] or "", [x for x in name["given"] or [] if x]
        if "," in f and not g:
            f, _, rest = f.partition(",")
            g = [rest]
        if (name["use"] or "") == "nickname" and (family or given):
            continue
        family += [p for p in parts_of(f) if p not in family]
        given += [p for p in parts_of(" ".join(g)) if p not in given]
    family = [p for p in family if p not in PARTICLES] or family
    given = [p for p in given if p not in PARTICLES] or given
    if not family and not given:
        return None
    phones, mails = set(), set()
    for t in row["telecom"] or []:
        if t is None or not t["value"]:
            continue
        if "@" in t["value"]:
            mails.add(fold(t["value"].strip()))
        elif len(d := re.sub(r"\D", "", t["value"])) >= 7:
            phones.add(d[-10:])
    places = set()
    for a in row["address"] or []:
        if a is None:
            continue
        text = " ".join(x for x in [*(a["line"] or []), a["city"] or "", a["postalCode"] or ""] if x)
        zips = re.findall(r"(?<!\d)\d{5}(?!\d)", text)
        house = re.findall(r"(?<![\d#])(?<!apt)(?<!apt )(?<!# )(?<!-)\b\d{1,4}\b(?!-)", re.sub(r"(?i)(?:apt|apartment|unit|suite|ste|#)\.?\s*#?\s*\w+", "", text))
        if zips and house:
            places.add(f"{zips[-1]}/{house[0]}")
    return {
        "family": family, "given": given, "gender": row["gender"] if row["gender"] in ("male", "female") else None,
        "born": row["born"], "phones": sorted(phones), "mails": sorted(mails), "places": sorted(places),
    }


def shared_keys(r: dict) -> list[str]:
    """What two records of one person may share."""
    out = [*(f"p{x}" for x in r["phones"]), *(f"m{x}" for x in r["mails"]), *(f"a{x}" for x in r["places"])]
    if r["born"] and len(r["born"]) == 10:
        y, m, d = r["born"].split("-")
        out.append(f"b{y}{min(m, d)}{max(m, d)}")
    return out


def initial(part: str) -> bool:
    return len(part) == 1 and part.isascii()


def indexed_parts(r: dict) -> list[str]:
    """The parts of a name, wherever they stand, and the names that its nicknames stand for. Initials only if there is
    nothing else."""
    every = {*r["family"], *r["given"]}
    parts = sorted({p for p in every if not initial(p)} or every, key=lambda p: (-len(p), p))
    return list(dict.fromkeys(parts + [full for p in r["given"] + r["family"] for full in NICKNAMES.get(p, "").split()]))


def _born(a: str | None, b: str | None) -> str:
    """same, part (one is less precise), near (a slip), none (not given), other."""
    if not a or not b:
        return "none"
    if a == b:
        return "same" if len(a) == 10 else "part"
    if len(a) != len(b):
        return "part" if a.startswith(b) or b.startswith(a) else "other"
    if len(a) < 10:
        return "other"
    x, y = a.split("-"), b.split("-")
    if x[0] == y[0] and x[1] == y[2] and x[2] == y[1]:
        return "near"
    differ = sum(p != q for p, q in zip(x, y))
    if edits(a.replace("-", ""), b.replace("-", ""), 1) <= 1 or (differ == 1 and x[0] == y[0]):
        return "near"
    if x[1:] == y[1:] and abs(int(x[0]) - int(y[0])) in (1, 10):
        return "near"
    days = abs(np.datetime64(a) - np.datetime64(b)).astype(int)
    return "near" if days <= 1 or (days % 365 <= 2 and days < 370) else "other"


def _two_slips(a: str | None, b: str | None) -> bool:
    """Whether two full dates can each be one slip away from a third: no part of them is far apart."""
    if not a or not b or len(a) < 10 or len(b) < 10:
        return False
    (ya, ma, da), (yb, mb, db) = a.split("-"), b.split("-")
    year = edits(ya, yb, 1) <= 1 or abs(int(ya) - int(yb)) in (1, 10)
    if {ma, da} == {mb, db}:
        return year
    close = [year, edits(ma, mb, 1) <= 1, edits(da, db, 1) <= 1 or abs(int(da) - int(db)) <= 1]
    return all(close) and (ya == yb) + (ma == mb) + (da == db) >= 1


def name_agreement(a: dict, b: dict) -> tuple[float, float]:
    """(family, given): how well they agree, with the parts in whichever role fits better."""

    def one(fa, ga, fb, gb):
        pairs = [(similar(x, y), x == y) for x in fa for y in fb if not initial(x) and not initial(y)]
        fam = 1.0 if any(e for _, e in pairs) else 0.9 if any(s for s, _ in pairs) else 0.0
        if not ga or not gb:
            return fam, 0.3 if fam else 0.0
        first = same_given(ga[0], gb[0])
        if first < 0.9:
            cross = max((same_given(x, y) for x in ga for y in gb if not initial(x) and not initial(y)), default=0.0)
            first = max(first, 0.6 * cross)
        elif len(ga) > 1 and len(gb) > 1 and same_given(ga[1], gb[1]) == 0:
            first -= 0.3
        return fam, first

    ways = [one(a["family"], a["given"], b["family"], b["given"])]
    if not min(ways[0]):
        for x, y in (((a["given"], a["family"]), (b["family"], b["given"])), ((a["family"], a["given"]), (b["given"], b["family"]))):
            ways.append(one(x[0], x[1], y[0], y[1]))
        every_a, every_b = a["family"] + a["given"], b["family"] + b["given"]
        met = [(x, y) for x in every_a for y in every_b if not initial(x) and not initial(y) and (similar(x, y) or same_given(x, y) >= 0.9)]
        if len({x for x, _ in met}) >= 2 and len({y for _, y in met}) >= 2 and any(x in a["given"] and y in b["given"] or (x in a["given"]) != (y in b["given"]) for x, y in met):
            ways.append((0.9, 0.9))
    return max(ways, key=lambda w: (min(w), sum(w)))


def one_person(a: dict, b: dict, mild: bool = False) -> bool:
    """Whether two records are of one person. mild: both agree with a third record already."""
    # What needs no names comes first: most pairs of a household or a birthday end here.
    mail = not set(a["mails"]).isdisjoint(b["mails"])
    born = _born(a["born"], b["born"])
    other_gender = a["gender"] and b["gender"] and a["gender"] != b["gender"]
    if not mail and ((other_gender and born != "same") or (born == "other" and not (mild and _two_slips(a["born"], b["born"])))):
        return False
    phone = not set(a["phones"]).isdisjoint(b["phones"])
    place = not set(a["places"]).isdisjoint(b["places"])
    if not (mail or phone or place or mild or born == "same"):
        return False
    family, given = name_agreement(a, b)
    if given < 0.3 or (other_gender and not mail and given < 0.9):
        return False
    if mild and born == "same":
        return given >= 0.5
    if mild and family and given >= 0.9 and _two_slips(a["born"], b["born"]):
        return True
    if born == "same" and place and given >= 0.9:
        return True
    if not family:  # a changed family name
        return given >= 0.9 and ((born == "same" and (mail or phone)) or (mail and born != "other"))
    if born == "same":
        return given >= 0.5 or mail
    if born == "part":
        return given >= 0.5 and (mail or phone or place or mild)
    if born == "near":
        return given >= 0.5 and (mail or phone or place or (mild and given >= 0.9))
    if born == "none":
        return (mail and given >= 0.5) or (given >= 0.6 and (phone or place or mild))
    return mail and given >= 0.9


def _features(patient: DataFrame, sites: DataFrame) -> DataFrame:
    """(id, features, shared, parts) of each id with a name."""
    known = {r.source_system: (r.zone_name, r.locale) for r in sites.select("source_system", "zone_name", "locale").collect()}
    once = patient.where("id is not null").groupBy("id").agg(
        F.min(F.struct("name", "gender", "birthDate", "telecom", "address", "source_system")).alias("p")
    )
    rows = once.select("id", "p.*")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = Normaliser(known)
        for b in batches:
            rows = b.to_pylist()
            born = norm([r["birthDate"] for r in rows], [r["source_system"] for r in rows], np.ones(len(rows), bool))
            ids, features, shared, parts = [], [], [], []
            for r, d in zip(rows, born):
                x = record(r | {"born": d})
                if x is None:
                    continue
                ids.append(r["id"])
                features.append(json.dumps(x, ensure_ascii=False))
                shared.append(shared_keys(x))
                parts.append(indexed_parts(x))
            lists = [pa.array(c, pa.list_(pa.string())) for c in (shared, parts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(features, pa.string()), *lists], ["id", "features", "shared", "parts"])

    return rows.mapInArrow(make, "id string, features string, shared array<string>, parts array<string>")


def _keys(every: DataFrame) -> DataFrame:
    """(id, shared, index, probe): the facts that several records share, and the keys of the names of those that have any.

    Each shared fact goes with each key to index and each key to look up; they are multiplied where they are hashed.
    """
    facts = every.select("id", F.explode("shared").alias("s"))
    several = facts.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s")
    kept = facts.join(several, "s", "left_semi").groupBy("id").agg(F.collect_list("s").alias("shared"))
    rows = kept.join(every.select("id", "parts"), "id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("parts").to_pylist()
            out = ([list(dict.fromkeys(k for p in parts for k in fn(p))) for parts in names] for fn in (index_keys, probe_keys))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("shared"), *(pa.array(c, pa.list_(pa.string())) for c in out)], ["id", "shared", "index", "probe"])

    return rows.mapInArrow(make, "id string, shared array<string>, index array<string>, probe array<string>")


def hashed_keys(df: DataFrame, name: str, id_column: str, shared: str, keys: str) -> DataFrame:
    """(name, t): a hash of each shared fact with each key of a row."""
    one = df.select(F.col(id_column).alias(name), F.explode(shared).alias("s"), F.col(keys).alias("k"))
    return one.select(name, "s", F.explode("k").alias("k")).select(name, F.xxhash64("s", "k").alias("t"))


def _judge(pairs: DataFrame, features: DataFrame, mild: bool) -> DataFrame:
    """The pairs (id_a, id_b) that are one person."""
    a = features.select(F.col("id").alias("id_a"), F.col("features").alias("fa"))
    b = features.select(F.col("id").alias("id_b"), F.col("features").alias("fb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fa, fb = batch.column("fa").to_pylist(), batch.column("fb").to_pylist()
            keep = [k for k, (x, y) in enumerate(zip(fa, fb)) if one_person(features_of(x), features_of(y), mild)]
            yield batch.select(["id_a", "id_b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", "fa", "fb").mapInArrow(verify, "id_a string, id_b string")


def person_pairs(patient: DataFrame, sites: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of ids that are one person.

    sites: the fixed table of sources, for the order of day and month. Records that agree with a third one are compared
    again until no pair is new, so groups come out whole however long their chains are.
    """
    every = materialise(_features(patient, sites))
    keys = materialise(_keys(every))
    index = hashed_keys(keys, "i", "id", "shared", "index")
    probe = hashed_keys(keys, "j", "id", "shared", "probe")
    met = probe.join(index, "t").where("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    features = every.select("id", "features")
    links = fresh = materialise(_judge(met.distinct(), features, mild=False))
    while not fresh.isEmpty():
        # What is compared again meets through a fresh link; the other pairs were compared in an earlier round.
        via = _both_ways(fresh).alias("x").join(_both_ways(links).alias("y"), F.col("x.m") == F.col("y.m")).where("x.n <> y.n")
        more = via.select(F.least("x.n", "y.n").alias("id_a"), F.greatest("x.n", "y.n").alias("id_b")).distinct().join(links, ["id_a", "id_b"], "left_anti")
        fresh = materialise(_judge(more, features, mild=True))
        links = links.unionByName(fresh)
    return links


def _both_ways(links: DataFrame) -> DataFrame:
    """(m, n): each pair in both orders."""
    return links.select(F.col("id_a").alias("m"), F.col("id_b").alias("n")).unionByName(links.select(F.col("id_b").alias("m"), F.col("id_a").alias("n")))
