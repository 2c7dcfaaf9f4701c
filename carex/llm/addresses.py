"""Postal addresses of one place that are written differently (problem 6).

Rewrites are mined, not listed. In each round all streets are normalised by the rewrites known so far and matched again:
addresses that agree in postal code, house number and the street's name are aligned token by token with the way their
place is written most often. A pair of tokens, one an abbreviation of the other, is kept as a rewrite (blvd -> boulevard)
if it replaces each other in several contexts and significantly more often than the frequency of the longer one lets
expect (likelihood ratio test). Rounds end when no new rewrite appears. What street types are abbreviated to is known
from these rewrites only. The usual city of a postal code and the usual code of a city are counted likewise and fill in
for missing ones; a city that no code has is corrected to the alike cities of codes.

Two entries are one place if house number, street (within a typo), and, where both have them, flat, type of street,
direction, further words, postal code or city agree. Candidates meet in an inverted index over the place (code or city),
the house number and segments of the street's name, so a group is never larger than what one town has of one number and
street, however common both are.

Null and edge cases: entries without a house number or a street's name are in no pair; null entries keep their
position. A missing part does not contradict. An entry with neither code nor city is compared within its patient
only. Rows delivered again count once. Empty tables give no pairs; extra columns are ignored. Equal entries are one
writing, compared once and then expanded, as every pair of entries is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from carex.llm.names import edits, fold, hashed_keys, index_keys, probe_keys, similar
from carex.session import materialise

# Directions and what is written for them in one or two letters, which no alignment can tell from initials.
DIRECTIONS = {
    "n": "north", "s": "south", "e": "east", "w": "west", "no": "north", "so": "south", "ne": "northeast", "nw": "northwest",
    "se": "southeast", "sw": "southwest", "north": "north", "south": "south", "east": "east", "west": "west",
    "northeast": "northeast", "northwest": "northwest", "southeast": "southeast", "southwest": "southwest",
    "nord": "north", "sud": "south", "ost": "east",
}
# Types of street in full, and words before a street's name.
TYPES = frozenset(
    "street avenue boulevard lane road drive court place terrace parkway square highway circle trail way alley crescent"
    " close row mews strasse platz allee weg gasse ring ufer rue chemin".split()
)
BEFORE = frozenset("saint fort mount old olde new great little upper lower port lake".split())
GERMAN = re.compile(r"^(\w{4,}?)(strasse|str|platz|pl|allee|weg|gasse)$")
UNIT = re.compile(r"(?:\b(?:apartment|apt|appt|unit|suite|ste|flat|room|rm|floor|wohnung|whg)\b\.?|#)\s*(?:#|nr\.?|no\.?)?\s*(\d+\s?[a-z]?|[a-z]\d*)\b|\b(?:apt|unit|suite|ste)\.?(\d+[a-z]?|[a-z])\b", re.I)
CARE = re.compile(r"^\s*(?:c/o|care of|attn:?|z\.?\s?hd\.?)\b", re.I)
ZIP = re.compile(r"(?<![\w#])(?:[a-z]{1,2}-)?(\d{5})(?:-\d{4})?(?!\d)", re.I)
MOST_REWRITES = 100_000
ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)")
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut",
    "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa",
    "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire",
    "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio",
    "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota",
    "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia",
    "wi": "wisconsin", "wy": "wyoming",
}
STATE_AT_END = re.compile(r"[\s,]+(" + "|".join(sorted([*STATES, *STATES.values()], key=len, reverse=True)) + r")\.?\s*$")


def _state(text: str | None) -> str:
    s = re.sub(r"[^a-z ]", "", fold(text or "")).strip()
    return STATES.get(s, s)


def _letters(text: str) -> str:
    return re.sub(r"[^a-z]", "", fold(text).replace("ae", "a").replace("oe", "o").replace("ue", "u"))


def parse(address: dict) -> dict | None:
    """House number, flat, street tokens, postal code, city and state of an entry; None without number or street."""
    segments = [s for line in address["line"] or [] if line for s in re.split(r"[,;\n]", line) if s.strip() and not CARE.match(s)]
    code = ZIP.search(address["postalCode"] or "")
    zip5, city, state = code[1] if code else "", _letters(address["city"] or ""), _state(address["state"])
    # Parts of the town at the end of the lines.
    if segments and not (code and city):
        last = segments[-1]
        if len(segments) > 1 or ZIP.search(last):
            m = list(ZIP.finditer(last))
            found = m[-1] if m and (len(segments) > 1 or m[-1].start() > 0) else None
            rest = last
            if found:
                zip5 = zip5 or found[1]
                before, after = last[: found.start()], last[found.end() :]
                rest = after if after.strip() and not before.strip() else before
            if s := STATE_AT_END.search(" " + fold(rest)):
                state = state or _state(s[1])
                rest = (" " + rest)[: s.start()]
            if (found or s) and len(segments) > 1:
                town = rest.strip()
                if not town and len(segments) > 2 and not re.search(r"\d", segments[-2]) and not UNIT.search(segments[-2]):
                    town, segments = segments[-2], segments[:-1]
                if not re.search(r"\d", town):
                    city = city or _letters(town)
                    segments = segments[:-1]
            elif not found and not s and len(segments) > 1 and not city and not re.search(r"\d|#", last) and not UNIT.search(last):
                if any(re.search(r"\d", x) for x in segments[:-1]):
                    city, segments = _letters(last), segments[:-1]
    unit, kept = "", []
    for s in segments:
        if m := UNIT.search(s):
            unit = unit or re.sub(r"\s", "", (m[1] or m[2])).lower()
            s = s[: m.start()] + " " + s[m.end() :]
        if s.strip(" .,-"):
            kept.append(s)
    text = re.sub(r"\b([ns])\.\s?([ew])\.", r"\1\2 ", fold(" ".join(kept)))
    text = re.sub(r"(?<=\w)-str\b\.?", " strasse", text)
    tokens = re.findall(r"\d+(?:st|nd|rd|th)\b|[^\W\d_]+|\d+[a-z]?\b", text.replace("-", " "))
    words = [t for t in tokens if not t[0].isdigit() or ORDINAL.fullmatch(t)]
    numbers = [t for t in tokens if t[0].isdigit() and not ORDINAL.fullmatch(t)]
    if not numbers or not words:
        return None
    if tokens[0] != numbers[0] and words[-1] in ("nr", "no", "nummer"):
        words = words[:-1]
    street: list[str] = []
    for w in words:
        if (m := GERMAN.match(w)) and m[1] not in TYPES:
            street += [m[1], {"str": "strasse", "pl": "platz"}.get(m[2], m[2])]
        else:
            street.append(w)
    street = [w for w in street if w not in ("nr", "the")] or street
    if tokens[0] != numbers[0] and len(street) > 1 and street[-1] in ("str", "st"):
        street[-1] = "strasse"  # the number stands behind the street
    return {"house": numbers[0], "unit": unit, "street": street, "zip": zip5, "city": city, "state": state}


def rewritten(street: list[str], rewrites: dict[str, str]) -> list[str]:
    """A street after all rewrites. st is a word before the name where a name follows it, and a type at the end."""
    out = []
    for i, w in enumerate(street):
        seen = set()
        while (n := rewrites.get(f"^{w}" if i < len(street) - 1 and len(street[i + 1]) > 3 and i <= 1 else w, rewrites.get(w))) and w not in seen:
            seen.add(w)
            w = n
        out.append(w)
    return out


def layout(street: list[str]) -> dict:
    """Name, type (within a slip), direction and words before the name of a normalised street."""
    words, direction = [], ""
    for i, w in enumerate(street):
        if w in DIRECTIONS and len(street) > 1 and (i == 0 or i == len(street) - 1) and not direction:
            direction = DIRECTIONS[w]
        else:
            words.append(w)
    kind = next((w for w in reversed(words[1:]) if w in TYPES), "")
    if not kind and len(words) > 1 and len(words[-1]) > 4 and (slip := next((t for t in sorted(TYPES) if len(t) > 4 and edits(words[-1], t, 1) <= 1), "")):
        kind = words[-1] = slip
    rest = [w for k, w in enumerate(words) if not (w == kind and k > 0)]
    before = [w for w in rest if w in BEFORE]
    name = [w for w in rest if w not in BEFORE] or rest
    if not kind and len(name) > 1 and (len(name[-1]) <= 4 or len(name[-1]) < max(map(len, name))):  # a type that no rewrite knows
        kind, name = name[-1], name[:-1]
    return {"name": max(name, key=len), "others": sorted(x for x in name if x != max(name, key=len)), "kind": kind, "direction": direction, "before": before}


@lru_cache(maxsize=100_000)
def _alike(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 4 and similar(a, b))


def same_place(a: dict, b: dict) -> bool:
    """Whether two parsed and laid out entries denote one place, apart from where it is."""
    if a["house"] != b["house"] or not _alike(a["name"], b["name"]):
        return False
    if any(a[c] and b[c] and a[c] != b[c] for c in ("unit", "direction")):
        return False
    if a["kind"] and b["kind"] and not _alike(a["kind"], b["kind"]):
        return False
    return all(not a[c] or not b[c] or any(_alike(x, y) for x in a[c] for y in b[c]) for c in ("before", "others"))


def same_town(a: dict, b: dict) -> bool:
    """Whether what two entries say of code and town agrees; False if either says nothing."""
    state = not a["state"] or not b["state"] or a["state"] == b["state"]
    city = any(_alike(x, y) for x in {a["city"], a["town"]} for y in {b["city"], b["town"]} if x and y)
    if a["code"] and b["code"]:
        return a["code"] == b["code"] or (city and state and edits(a["code"], b["code"], 1) <= 1)
    return city and state


def alike(a: Column, b: Column) -> Column:
    """`_alike` as a column; null where only the distance with swaps can tell."""
    short = F.least(F.length(a), F.length(b))
    most = F.when(short < 6, 1).otherwise(2)
    distance = F.levenshtein(a, b, 4)
    return F.when(a == b, True).when(short < 4, False).when((distance >= 0) & (distance <= most), True).when((distance < 0) | (distance > 2 * most), False)


def same_street(a: str, b: str) -> Column:
    """`same_place` over the columns of two structs, null where undecided."""

    def x(c: str) -> Column:
        return F.col(f"{a}.{c}")

    def y(c: str) -> Column:
        return F.col(f"{b}.{c}")

    def fits(c: str, test: Column) -> Column:
        return (x(c) == "") | (y(c) == "") | test

    def some(c: str) -> Column:
        return (F.size(x(c)) == 0) | (F.size(y(c)) == 0) | F.exists(x(c), lambda p: F.exists(y(c), lambda q: alike(p, q)))

    same = (x("house") == y("house")) & fits("unit", x("unit") == y("unit")) & fits("direction", x("direction") == y("direction"))
    return same & alike(x("name"), y("name")) & fits("kind", alike(x("kind"), y("kind"))) & some("before") & some("others")


def same_where(a: str, b: str) -> Column:
    """`same_town` over the columns of two structs, null where undecided."""

    def x(c: str) -> Column:
        return F.col(f"{a}.{c}")

    def y(c: str) -> Column:
        return F.col(f"{b}.{c}")

    state = (x("state") == "") | (y("state") == "") | (x("state") == y("state"))
    city = F.lit(False)
    for p in ("city", "town"):
        for q in ("city", "town"):
            city = city | ((x(p) != "") & (y(q) != "") & alike(x(p), y(q)))
    near = F.levenshtein(x("code"), y("code"), 2)
    one_slip = F.when(near == 1, True).when(near == 2, F.lit(None).cast("boolean")).otherwise(False)
    return F.when((x("code") != "") & (y("code") != ""), (x("code") == y("code")) | (city & state & one_slip)).otherwise(city & state)


def _entries(patient: DataFrame) -> DataFrame:
    """(id, pos, parsed) of each entry with a house number and a street."""
    once = patient.where("id is not null").groupBy("id").agg(F.max("address").alias("address"))
    rows = once.select("id", F.posexplode("address").alias("pos", "a")).where("a is not null").select("id", "pos", "a.line", "a.city", "a.state", "a.postalCode")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "pos", "house", "unit", "street", "zip", "city", "state"]
        for b in batches:
            found = [(k, p) for k, r in enumerate(b.to_pylist()) if (p := parse(r))]
            at = pa.array([k for k, _ in found], pa.int64())
            cols = [pa.array([" ".join(p[c]) if c == "street" else p[c] for _, p in found], pa.string()) for c in names[2:]]
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("pos").take(at), *cols], names)

    return rows.mapInArrow(make, "id string, pos int, house string, unit string, street string, zip string, city string, state string")


def aligned(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """The token pairs that replace each other between two writings that otherwise agree; '^' marks a place before
    the name."""
    if len(a) != len(b) or len(a) < 2 or a == b:
        return []
    differ = [i for i in range(len(a)) if a[i] != b[i]]
    agree = [x for i, x in enumerate(a) if i not in differ and len(x) > 2]
    if len(differ) > 2 or not agree:
        return []
    out = []
    for i in differ:
        short, long = sorted((a[i], b[i]), key=lambda w: (len(w), w))
        if len(short) < len(long) and short[0] == long[0] and re.match(".*".join(map(re.escape, short)), long):
            mark = "^" if i < len(a) - 1 and len(a[i + 1]) > 3 and i <= 1 else ""
            out.append((mark + short, long))
    return out


def mine_rewrites(writings: DataFrame, least_contexts: int = 3, significance: float = 10.83) -> dict[str, str]:
    """The significant rewrites. writings: zip, house, street, n (how often it is written so), distinct.

    Each writing is aligned with the most frequent one of its postal code, house number and name only, so the work
    grows with the writings and not with their pairs. A rewrite must hold in `least_contexts` contexts (the tokens that
    agree), so a misspelt name of one street is none, must be what its token is most often replaced by, and its
    likelihood ratio against the frequency of the longer token must exceed `significance` (chi-square, 0.1 %). The result
    is a vocabulary of abbreviations: it grows with the language and not with the rows. More than MOST_REWRITES are
    refused with an error.
    """
    rewrites: dict[str, str] = {}
    while True:
        known = dict(rewrites)

        def normalise(batches: Iterator[pa.RecordBatch], known: dict = known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                plain = [rewritten(x.split(), known) for x in b.column("street").to_pylist()]
                made = [pa.array([layout(x)["name"] for x in plain], pa.string()), pa.array([" ".join(x) for x in plain], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column("zip"), b.column("house"), b.column("n"), *made], ["zip", "house", "n", "name", "street"])

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for x, y in zip(b.column("street").to_pylist(), b.column("usual").to_pylist()):
                    x, y = x.split(), y.split()
                    rest = " ".join(p for p, q in zip(x, y) if p == q)
                    rows += [(*p, rest) for p in aligned(x, y)]
                cols = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["short", "long", "context"])

        place = ["zip", "house", "name"]
        named = writings.mapInArrow(normalise, "zip string, house string, n long, name string, street string")
        named = materialise(named.groupBy(*place, "street").agg(F.sum("n").alias("n")))
        usual = named.groupBy(*place).agg(F.max_by("street", F.struct("n", F.length("street"), "street")).alias("usual"))
        beside = named.join(usual, place).where("street <> usual").select("street", "usual").distinct()
        pairs = materialise(beside.mapInArrow(align, "short string, long string, context string").distinct())
        counts = pairs.groupBy("short", "long").agg(F.count(F.lit(1)).alias("n"))
        tokens = named.select(F.explode(F.split("street", " ")).alias("long")).groupBy("long").agg(F.count(F.lit(1)).alias("uses"))
        total = named.agg(F.sum(F.size(F.split("street", " "))).alias("all_uses"))
        of_short = W.partitionBy("short")
        tested = counts.join(tokens, "long").join(F.broadcast(total)).withColumn("trials", F.sum("n").over(of_short))
        n, trials, chance = F.col("n"), F.col("trials"), F.col("uses") / F.col("all_uses")
        miss = trials - n
        ratio = 2 * (n * F.ln(n / (trials * chance)) + F.when(miss > 0, miss * F.ln(miss / (trials * (1 - chance)))).otherwise(0.0))
        kept = tested.where((n >= least_contexts) & (n > trials * chance) & (n * 2 >= trials) & (ratio >= significance)).select("short", "long")
        new = {r.short: r.long for r in kept.limit(MOST_REWRITES + 1).collect() if r.short not in rewrites}
        if not new:
            return rewrites
        rewrites |= new
        if len(rewrites) > MOST_REWRITES:
            raise ValueError(f"more than {MOST_REWRITES} rewrites: these are no abbreviations of a language")


def fill_towns(distinct: DataFrame, towns: DataFrame) -> DataFrame:
    """The distinct writings with fix (the city, corrected), town (the usual city of the code, or fix) and code (that of
    the city where none is written), and whether the code is trusted: it is of the written city, and no more frequent code of
    that city is one digit or one swap away.

    towns: zip, city, state, n.
    """
    # Codes one slip apart share one of these keys: a digit left open, or two neighbours in order.
    digits = [F.substring("zip", k, 1) for k in range(1, 6)]
    open_digit = [F.concat(*[F.lit("_") if j == k else d for j, d in enumerate(digits)]) for k in range(5)]
    ordered = [F.concat(F.lit(str(k)), *[F.least(d, digits[k + 1]) if j == k else F.greatest(digits[k], d) if j == k + 1 else d for j, d in enumerate(digits)]) for k in range(4)]
    slips = towns.where("length(zip) = 5").select("city", "state", "zip", "n", F.explode(F.array(*open_digit, *ordered)).alias("k"))
    of_slip = slips.groupBy("city", "state", "k").agg(F.max_by("zip", F.struct("n", F.col("zip"))).alias("best"))
    suspect = slips.join(of_slip, ["city", "state", "k"]).where("zip <> best").select("zip", "city", "state", F.lit(True).alias("suspect")).distinct()
    town_of = towns.groupBy("zip").agg(F.max_by("city", F.struct("n", F.col("city"))).alias("usual_city"))
    code_of = towns.groupBy("city", "state").agg(F.max_by("zip", F.struct("n", F.col("zip"))).alias("usual_zip"), F.max("n").alias("n"))
    code_of = code_of.where("n >= 2").drop("n")
    # A city is corrected to the closest one of its state (of any, if none is given) that is alike and at least five times
    # as frequent.
    cities = materialise(distinct.where("city <> ''").groupBy("city", "state").agg(F.count(F.lit(1)).alias("n")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([fn(x) for x in b.column("city").to_pylist()] for fn in (index_keys, probe_keys))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.list_(pa.string())) for c in out)], [*b.schema.names, "index", "probe"])

    keyed = materialise(cities.mapInArrow(keys, "city string, state string, n long, index array<string>, probe array<string>"))
    index = keyed.select(F.col("state").alias("usual_state"), F.col("city").alias("usual"), F.col("n").alias("usual_n"), F.explode("index").alias("k"))
    probe = keyed.select("state", "city", "n", F.explode("probe").alias("k"))
    met = probe.join(index, "k").where("(state = '' or state = usual_state) and usual_n >= 5 * n").where(F.coalesce(alike(F.col("city"), F.col("usual")), F.lit(True)))
    closest = F.struct(F.levenshtein("city", "usual"), -F.col("usual_n"), F.col("usual"))
    corrected = met.groupBy("city", "state").agg(F.min_by("usual", closest).alias("corrected"))
    own = F.coalesce("corrected", "city")
    return (
        distinct.join(town_of, "zip", "left").join(code_of, ["city", "state"], "left").join(corrected, ["city", "state"], "left").join(suspect, ["zip", "city", "state"], "left")
        .select(
            *distinct.columns,
            F.coalesce("usual_city", own).alias("town"),
            own.alias("fix"),
            F.when(F.col("zip") == "", F.coalesce("usual_zip", F.lit(""))).otherwise(F.col("zip")).alias("code"),
            F.coalesce(F.col("corrected").isNull() & ((F.col("usual_city") == F.col("city")) & F.col("suspect").isNull() | (F.col("usual_zip").isNotNull() & (F.col("zip") == ""))), F.lit(False)).alias("trusted"),
        )
    )


WHOLE = ["zip", "city", "state", "house", "unit", "street"]
LAID = "name string, kind string, direction string, before array<string>, others array<string>"


def laid_writings(entries: DataFrame) -> DataFrame:
    """One row a writing: w (its identity), what is compared, and the keys of the street's name."""
    writings = entries.where("zip <> ''").groupBy("zip", "house", "street").agg(F.count(F.lit(1)).alias("n"))
    rewrites = mine_rewrites(materialise(writings))
    towns = materialise(entries.where("zip <> '' and city <> ''").groupBy("zip", "city", "state").agg(F.count(F.lit(1)).alias("n")))
    filled = fill_towns(entries.select("w", *WHOLE).dropDuplicates(["w"]), towns)
    kept = ["w", "house", "unit", "city", "state", "town", "fix", "code", "trusted"]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [layout(rewritten(x.split(), rewrites)) for x in b.column("street").to_pylist()]
            cols = [pa.array([m[c] for m in made], pa.string()) for c in ("name", "kind", "direction")]
            cols += [pa.array([m[c] for m in made], pa.list_(pa.string())) for c in ("before", "others")]
            cols += [pa.array([fn(m["name"]) for m in made], pa.list_(pa.string())) for fn in (index_keys, probe_keys)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], [*kept, "name", "kind", "direction", "before", "others", "index", "probe"])

    ddl = f"w string, house string, unit string, city string, state string, town string, fix string, code string, trusted boolean, {LAID}, index array<string>, probe array<string>"
    return materialise(filled.select(*kept, "street").mapInArrow(lay, ddl))


def writing_links(laid: DataFrame) -> DataFrame:
    """(wa, wb), wa < wb: the pairs of different writings that denote one place wherever they stand."""
    by_code, by_town = F.concat(F.lit("z"), "code"), F.concat(F.lit("t"), "town")
    by_city = F.concat(F.lit("t"), "fix")
    all_places = F.array_distinct(F.array_compact(F.array(F.when(F.col("code") != "", by_code), F.when(F.col("town") != "", by_town), F.when(F.col("fix") != "", by_city))))
    # A trusted code is looked up alone: who has another code and the same town has a code that is not trusted, and looks up the town.
    looked_up = F.when(F.col("trusted") & (F.col("code") != ""), F.array(by_code)).otherwise(all_places)
    at = laid.select("w", "index", "probe", F.transform(all_places, lambda p: F.concat(p, F.lit("/"), F.col("house"))).alias("places"), F.transform(looked_up, lambda p: F.concat(p, F.lit("/"), F.col("house"))).alias("asked"))
    index, probe = hashed_keys(at, "i", "w", "places", "index"), hashed_keys(at, "j", "w", "asked", "probe")
    met = probe.join(index, "t").where("i <> j").select(F.least("i", "j").alias("wa"), F.greatest("i", "j").alias("wb")).distinct()
    return judged(met, laid, lambda a, b: same_place(a, b) and same_town(a, b), same_street("a", "b") & same_where("a", "b"))


def judged(met: DataFrame, laid: DataFrame, exact: Callable[[dict, dict], bool], test: Column) -> DataFrame:
    """The pairs (and further columns) of `met` that pass: by the column `test`, and by `exact` where that is null."""
    compared = ["house", "unit", "city", "state", "town", "code", "name", "kind", "direction", "before", "others"]
    a = laid.select(F.col("w").alias("wa"), F.struct(*compared).alias("a"))
    b = laid.select(F.col("w").alias("wb"), F.struct(*compared).alias("b"))
    columns = met.columns
    tested = materialise(met.join(a, "wa").join(b, "wb").withColumn("same", test).where("same is null or same"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = [k for k, (p, q) in enumerate(zip(x.column("a").to_pylist(), x.column("b").to_pylist())) if exact(p, q)]
            yield x.select(columns).take(pa.array(keep, pa.int64()))

    left = tested.where("same is null").select(*met.columns, "a", "b").mapInArrow(verify, met.schema)
    return tested.where("same").select(met.columns).unionByName(left)


def identified(entries: DataFrame) -> DataFrame:
    """The entries with w, a digest of 128 bits of how they are written."""
    return entries.withColumn("w", F.md5(F.to_json(F.struct(*WHOLE))))


def place_pairs(patient: DataFrame) -> DataFrame:
    """(id_a, pos_a, id_b, pos_b): the pairs of entries that denote one place, the smaller one first."""
    entries = materialise(identified(_entries(patient)))
    laid = laid_writings(entries)
    of = entries.select(F.struct("id", "pos").alias("x"), "w")
    other = of.select(F.col("x").alias("y"), F.col("w").alias("wb"))
    links = writing_links(laid)
    # Equal writings that say where they are; of one writing each pair of entries meets twice, of two writings once.
    placed = laid.where("code <> '' or town <> ''").select(F.col("w").alias("wa"), F.col("w").alias("wb"))
    pairs = links.unionByName(placed).join(of.withColumnRenamed("w", "wa"), "wa").join(other, "wb").where("wa <> wb or x < y").select("x", "y")
    # Entries that do not say where they are meet those of their patient.
    nowhere = laid.where("code = '' and town = ''").select("w")
    mine = entries.join(nowhere, "w", "left_semi").select("id", "house", F.col("pos").alias("pos_x"), F.col("w").alias("wa"))
    theirs = entries.select("id", "house", F.col("pos").alias("pos_y"), F.col("w").alias("wb"))
    near = mine.join(theirs, ["id", "house"]).where("pos_x <> pos_y").select("id", "pos_x", "pos_y", "wa", "wb")
    near = judged(near, laid, same_place, same_street("a", "b")).select(F.struct("id", F.col("pos_x").alias("pos")).alias("x"), F.struct("id", F.col("pos_y").alias("pos")).alias("y"))
    low, high = F.least("x", "y"), F.greatest("x", "y")
    near = near.select(low.alias("x"), high.alias("y")).distinct()
    both = pairs.select(low.alias("x"), high.alias("y")).unionByName(near)
    return both.select(F.col("x.id").alias("id_a"), F.col("x.pos").alias("pos_a"), F.col("y.id").alias("id_b"), F.col("y.pos").alias("pos_b"))


def place_writings(patient: DataFrame) -> DataFrame:
    """(writing, entries, linked_writings, pairs): each way of writing that says where it is, as a class of equal
    entries, with how many entries it has, how many other writings denote the same place, and the pairs of entries within
    it. The work grows with the writings and links and not with the pairs of entries."""
    entries = materialise(identified(_entries(patient)))
    laid = laid_writings(entries)
    links = writing_links(laid)
    degree = links.select(F.col("wa").alias("w")).unionByName(links.select(F.col("wb").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("linked_writings"))
    sizes = entries.groupBy("w").agg(F.count(F.lit(1)).alias("entries")).join(laid.where("code <> '' or town <> ''").select("w"), "w", "left_semi")
    n = F.col("entries")
    return sizes.join(degree, "w", "left").select(F.col("w").alias("writing"), "entries", F.coalesce("linked_writings", F.lit(0)).alias("linked_writings"), (n * (n - 1) / 2).cast("long").alias("pairs"))
