"""Mixed timestamp formats and time zones (problem 3).

Texts are tokenised into shape masks (digits become 9, letters a, all else stays), each distinct mask is mapped to a
parser once, and all texts of one mask are converted together: a mask fixes the place of every field, so a field is
a slice of a matrix of characters. Times on a wall clock go through versioned tables of zone transitions.

Null and edge cases: null, empty and blank texts, dates or times that do not exist, times without a date, and days without a year have no normal form. A numeric day and month are read in the
order of the source's locale; of an unknown source only where both orders give one day. A time without a zone of an
unknown source, and one that its clock showed never or twice, has no normal form. Digits beyond the millisecond are
cut off. Texts of any length are read whole. Repeated rows repeat in the result (a caller whose keys repeat drops them before, see `timestamp_rows`); tables
without rows give none; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from carex.functions.zones import ABBREVIATIONS, local_to_utc, tz_version, zone_names

WIDTH = 80  # texts up to this length share one matrix; longer ones have matrices of their own length
MOST_CHARS = 4_000_000  # of one matrix of longer texts

# Names of the months in English, German and French, in lower case without points.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4,
    "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "maerz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10,
    "dezember": 12, "mär": 3, "mrz": 3, "okt": 10, "dez": 12,
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "aout": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12, "janv": 1, "févr": 2, "fevr": 2,
    "avr": 4, "juil": 7, "déc": 12,
}
WEEKDAYS = {"mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6}

DATE = "|".join(
    (
        r"(?P<Y0>9999)-(?P<M0>99)-(?P<D0>99)",
        r"(?P<Y1>9999)/(?P<M1>99)/(?P<D1>99)",
        r"(?P<A>99?)(?P<sep>[/.\-])(?P<B>99?)(?P=sep)(?P<Y2>9999)",
        r"(?P<N3>a+)\.? (?P<D3>99?),? (?P<Y3>9999)",
        r"(?P<D4>99?)\.?[ -](?P<N4>a+)\.?[ -](?P<Y4>9999)",
        r"(?P<Y5>9999)-(?P<J5>999)",
        r"(?P<Y6>9999)-(?P<M6>99)",
        r"(?P<Y7>9999)",
    )
)
TIME = r"(?P<h>99?):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>aa|a\.a\.)(?!a))?"
ZONE = r"(?: ?(?P<off>[+\-]99:?(?:99)?)| ?\[(?P<zb>[a/_+\-9]+)\]| ?(?P<zn>a[a/_+\-9]*))"
SHAPES = [
    re.compile(rf"(?:(?P<wd>aaa), )?(?:{DATE})(?:(?P<t>a|,? (?:(?P<at>a{{1,2}}) )?){TIME}(?:{ZONE})?)?"),
    re.compile(rf"(?P<Y8>9999)(?P<M8>99)(?P<D8>99)(?:(?P<t>a?)(?P<h>99)(?P<m>99)(?P<s>99)?(?:[.,](?P<f>9+))?(?:{ZONE})?)?"),
]
EPOCH = re.compile(r"9{10}|9{13}")

_SPACES = {0x00A0: " ", 0x202F: " ", 0x2009: " ", 0x2212: "-", 0x2013: "-", 0x2011: "-"}


def _class_table() -> np.ndarray:
    table = np.full(0x250, ord("?"), dtype=np.uint8)
    table[:128] = np.arange(128)
    for c in range(0x250):
        if chr(c).isalpha():
            table[c] = ord("a")
    table[48:58] = ord("9")
    return table


_CLASSES = _class_table()


def _clean(text: str | None) -> str:
    if text is None:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_SPACES))
    return text.strip()


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for k in range(*span):
        out = out * 10 + (chars[:, k].astype(np.int64) - 48)
    return out


def _words(texts: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lower-case slices, and the place of each text's slice among them."""
    return np.unique(np.array([t[span[0] : span[1]].lower() for t in texts], dtype=object).astype(str), return_inverse=True)


def _looked_up(texts: np.ndarray, span: tuple[int, int], find: Callable[[str], int | None], missing: int) -> np.ndarray:
    words, where = _words(texts, span)
    return np.array([missing if (v := find(w)) is None else v for w in words], dtype=np.int64)[where]


def days_of(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days since 1970, ok) of the proleptic calendar."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    length = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - first
    return first + d - 1, ok & (d <= length)


class MaskParser:
    """Converts texts of one mask. Built once for each distinct mask of a process."""

    def __init__(self, mask: str, version: str):
        self.version, self.epoch, self.spans = version, None, None
        if EPOCH.fullmatch(mask):
            self.epoch = len(mask)
            return
        for shape in SHAPES:
            if m := shape.fullmatch(mask):
                self.spans = {re.sub(r"\d$", "", k): m.span(k) for k, v in m.groupdict().items() if v is not None}
                self.kind = next((re.sub(r"\D", "", k) for k, v in m.groupdict().items() if v is not None and re.fullmatch(r"Y\d", k)), "")
                break

    def _offsets(self, texts, chars, zones, n) -> tuple[str, np.ndarray | None, np.ndarray]:
        """('fixed', offsets in seconds, ok) or ('zone', names, ok) or ('none', None, ok)."""
        s, yes = self.spans, np.ones(n, dtype=bool)
        if "off" in s:
            a, b = s["off"]
            sign = np.where(chars[:, a] == 45, -1, 1)
            hours = _number(chars, (a + 1, a + 3))
            minutes = _number(chars, (b - 2, b)) if b - a > 3 else np.zeros(n, dtype=np.int64)
            return "fixed", sign * (hours * 3600 + minutes * 60), (hours <= 14) & (minutes <= 59)
        span = s.get("zb") or s.get("zn")
        if not span:
            return "none", None, yes
        words, where = _words(texts, span)
        fixed = [ABBREVIATIONS.get(w) for w in words]
        if all(x is not None for x in fixed):
            return "fixed", (np.array(fixed, dtype=np.int64) * 60)[where], yes
        names = [w if w in ABBREVIATIONS else zone_names().get(w, "") if "/" in w else "" for w in words]
        own = np.array([w == "uhr" for w in words])[where]
        fine = np.array([x != "" for x in names])[where]
        return "zone", np.where(own, zones, np.array(names, dtype=object)[where]), fine | own

    def __call__(self, texts: np.ndarray, chars: np.ndarray, zones: np.ndarray, month_first: np.ndarray, date_only: np.ndarray) -> np.ndarray:
        """zones: zone name of each source's clock, '' if unknown; month_first: 1, 0, or -1 if unknown."""
        n = len(texts)
        out = np.full(n, None, dtype=object)
        if self.epoch:
            ms = _number(chars, (0, self.epoch)) * (1000 if self.epoch == 10 else 1)
            return np.where(date_only, None, _instants(ms))
        if self.spans is None:
            return out
        s = self.spans
        y = _number(chars, s["Y"])
        ok = np.ones(n, dtype=bool)
        if "J" in s:
            j = _number(chars, s["J"])
            jan, fine = days_of(y, np.ones_like(y), np.ones_like(y))
            days = jan + j - 1
            nxt, _ = days_of(y + 1, np.ones_like(y), np.ones_like(y))
            ok &= fine & (j >= 1) & (days < nxt)
        elif "A" in s:
            a, b = _number(chars, s["A"]), _number(chars, s["B"])
            md, ok_md = days_of(y, a, b)
            dm, ok_dm = days_of(y, b, a)
            either = (ok_md ^ ok_dm) | (ok_md & ok_dm & (md == dm))
            days = np.where(month_first == 1, md, np.where(month_first == 0, dm, np.where(ok_dm, dm, md)))
            ok &= np.where(month_first == 1, ok_md, np.where(month_first == 0, ok_dm, either))
        elif "D" in s:
            m = _number(chars, s["M"]) if "M" in s else _looked_up(texts, s["N"], MONTHS.get, 0)
            days, fine = days_of(y, m, _number(chars, s["D"]))
            ok &= fine
        elif "M" in s:
            m = _number(chars, s["M"])
            ok &= (y >= 1) & (m >= 1) & (m <= 12)
            return np.where(ok, np.array([t[s["Y"][0] : s["M"][1]] for t in texts], dtype=object), None)
        else:
            return np.where((y >= 1), np.array([t[s["Y"][0] : s["Y"][1]] for t in texts], dtype=object), None)
        if "wd" in s:
            ok &= _looked_up(texts, s["wd"], WEEKDAYS.get, -1) == (days + 3) % 7
        if "h" in s:
            h, mi = _number(chars, s["h"]), _number(chars, s["m"])
            sec = _number(chars, s["s"]) if "s" in s else np.zeros(n, dtype=np.int64)
            if s.get("t", (0, 0))[1] - s.get("t", (0, 0))[0] == 1 and "at" not in s:
                sep = chars[:, s["t"][0]]
                ok &= (sep == 32) | (sep == 84) | (sep == 116) | (sep == 44)
            if "at" in s:
                ok &= _looked_up(texts, s["at"], {"à": 1, "um": 1, "at": 1, "a": 1}.get, 0) == 1
            if "ap" in s:
                half = _looked_up(texts, s["ap"], {"am": 0, "pm": 1, "a.m.": 0, "p.m.": 1}.get, -1)
                ok &= (half >= 0) & (h >= 1) & (h <= 12)
                h = h % 12 + 12 * half
            ok &= (h <= 23) & (mi <= 59) & (sec <= 59)
            ms = np.zeros(n, dtype=np.int64)
            if "f" in s:
                a, b = s["f"]
                ms = _number(chars, (a, min(b, a + 3))) * 10 ** max(0, 3 - (b - a))
        if "h" not in s:
            return np.where(ok, days.astype("datetime64[D]").astype(str).astype(object), None)
        local = days * 86400 + h * 3600 + mi * 60 + sec
        kind, value, fine = self._offsets(texts, chars, zones, n)
        dates = np.where(ok & fine, days.astype("datetime64[D]").astype(str).astype(object), None)
        ok &= fine
        utc = np.zeros(n, dtype=np.int64)
        if kind == "fixed":
            utc = local - value
        else:
            names = value if kind == "zone" else zones
            known = np.zeros(n, dtype=bool)
            for name in set(names[ok & ~date_only]):
                at = np.flatnonzero(names == name)
                if name in ABBREVIATIONS:
                    utc[at], known[at] = local[at] - ABBREVIATIONS[name] * 60, True
                elif name:
                    utc[at], known[at] = local_to_utc(local[at], name, self.version)
            ok &= known
        return np.where(date_only, dates, np.where(ok, _instants(utc * 1000 + ms), None))


def _instants(ms: np.ndarray) -> np.ndarray:
    text = np.datetime_as_string(ms.astype("datetime64[ms]"), unit="ms").astype(object)
    return text + "Z"


class Normaliser:
    """Normal forms of batches of texts; keeps a parser for each mask it has met."""

    def __init__(self, sites: dict[str, tuple[str | None, str | None]], version: str | None = None):
        self.sites, self.version, self.parsers = sites, version or tz_version(), {}

    def __call__(self, texts: list[str | None], sources: list[str | None], date_only: np.ndarray) -> np.ndarray:
        out = np.full(len(texts), None, dtype=object)
        if not len(texts):
            return out
        clean = np.array([_clean(t) for t in texts], dtype=object)
        site = [self.sites.get(s, (None, None)) for s in sources]
        zones = np.array([z or "" for z, _ in site], dtype=object)
        first = np.array([-1 if loc is None else int(loc == "en-US") for _, loc in site])
        size = np.array([len(t) for t in clean])
        groups = [(WIDTH, np.flatnonzero(size <= WIDTH))]
        for n in np.unique(size[size > WIDTH]):
            rows, most = np.flatnonzero(size == n), max(1, MOST_CHARS // int(n))
            groups += [(int(n), rows[k : k + most]) for k in range(0, len(rows), most)]
        for width, rows in groups:
            if len(rows):
                out[rows] = self._convert(clean[rows].astype(f"U{width}"), width, zones[rows], first[rows], date_only[rows])
        return out

    def _convert(self, clean: np.ndarray, width: int, zones: np.ndarray, first: np.ndarray, date_only: np.ndarray) -> np.ndarray:
        """The normal forms of texts of at most `width` characters, mask by mask."""
        out = np.full(len(clean), None, dtype=object)
        chars = np.ascontiguousarray(clean).view(np.uint32).reshape(len(clean), width)
        masks = np.where(chars < len(_CLASSES), _CLASSES[np.minimum(chars, len(_CLASSES) - 1)], ord("?")).astype(np.uint8)
        masks, where = np.unique(np.ascontiguousarray(masks).view(f"S{width}").ravel(), return_inverse=True)
        order = np.argsort(where, kind="stable")
        for mask, rows in zip(masks, np.split(order, np.flatnonzero(np.diff(where[order])) + 1)):
            mask = mask.decode("ascii")
            if not mask:
                continue
            parser = self.parsers.get(mask) or MaskParser(mask, self.version)
            if width <= WIDTH:
                self.parsers[mask] = parser
            out[rows] = parser(clean[rows], chars[rows], zones[rows], first[rows], date_only[rows])
        return out


def timestamp_rows(df: DataFrame, table_name: str, key: str, fields: dict[str, bool], unique: bool = True) -> DataFrame:
    """One narrow row for each non-null text. fields: column -> whether it is a date without a time of day.

    unique: whether `key` is unique; if not, repeated rows are dropped here, which costs a shuffle.
    """
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("field_name"), F.lit(d).alias("date_only"), F.col(c).alias("text"))
            for c, d in fields.items()
        ]
    )
    rows = df.select(F.col(key).cast("string").alias("row_key"), "source_system", F.explode(cells).alias("c"))
    rows = rows.where("c.text is not null and row_key is not null").select(
        F.lit(table_name).alias("table_name"), "row_key", "c.field_name", "c.date_only", "c.text", "source_system"
    )
    return rows if unique else rows.distinct()


def normal_forms(rows: DataFrame, sites: DataFrame, version: str | None = None) -> DataFrame:
    """(table_name, row_key, field_name, normal_form) of each text that has one.

    sites: the fixed table of sources, one row a source system. `version` pins the release of the zone tables: a
    worker with another release fails rather than converting by other rules.
    """
    known = {r.source_system: (r.zone_name, r.locale) for r in sites.select("source_system", "zone_name", "locale").collect()}
    want = version or tz_version()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tz_version() != want:
            raise RuntimeError(f"zone tables are of release {tz_version()}, not {want}")
        norm = Normaliser(known, want)
        for b in batches:
            flags = b.column("date_only").to_numpy(zero_copy_only=False).astype(bool)
            forms = norm(b.column("text").to_pylist(), b.column("source_system").to_pylist(), flags)
            keep = pa.array(np.flatnonzero(forms != None))  # noqa: E711
            taken = b.select(["table_name", "row_key", "field_name"]).take(keep)
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(forms[keep.to_numpy()], pa.string())], ["table_name", "row_key", "field_name", "normal_form"])

    return rows.mapInArrow(convert, "table_name string, row_key string, field_name string, normal_form string")
