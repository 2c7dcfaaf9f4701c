"""Versioned transition tables of time zones, for vectorised conversion."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import numpy as np

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
FIRST_YEAR, RULES_YEAR, LAST_YEAR = 1900, 2100, 2500
# The calendar and its weekdays repeat after 400 years, and so do the rules of a zone beyond RULES_YEAR.
CYCLE = 146_097 * 86_400
RULES = int((datetime(RULES_YEAR, 1, 1, tzinfo=timezone.utc) - EPOCH).total_seconds())

# Abbreviations and their offsets in minutes, as printed by clocks of the zones that sources use.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60,
    "mesz": 120, "eet": 120, "eest": 180, "ist": 330, "jst": 540, "aest": 600, "aedt": 660, "acst": 570,
    "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}


def tz_version() -> str:
    """The release of the zone database that the tables are built from."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


@lru_cache(maxsize=1)
def zone_names() -> dict[str, str]:
    return {z.lower(): z for z in available_timezones()}


@lru_cache(maxsize=None)
def transitions(zone: str, version: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, offset): from start[i] on, in UTC seconds, the zone is offset[i] seconds ahead of UTC.

    Found by stepping through the years and bisecting each change, once per zone and release and process.
    """
    z = ZoneInfo(zone)

    def offset(at: int) -> int:
        return int((EPOCH + timedelta(seconds=at)).astimezone(z).utcoffset().total_seconds())

    start = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - EPOCH).total_seconds())
    end = int((datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc) - EPOCH).total_seconds())
    at, off = [-(2**62)], [offset(start)]
    step, now = 14 * 86400, start
    while now < end:
        there = min(now + step, end)
        if (new := offset(there)) != off[-1]:
            low, high = now, there
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == off[-1] else (low, mid)
            at.append(high)
            off.append(new)
        now = there
    return np.array(at, dtype=np.int64), np.array(off, dtype=np.int64)


def local_to_utc(local: np.ndarray, zone: str, version: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(utc seconds, ok): ok only where the zone's clock showed the local time exactly once."""
    at, off = transitions(zone, version or tz_version())
    shift = np.maximum((local - RULES) // CYCLE, 0) * CYCLE
    local = local - shift
    until = np.append(at[1:], 2**62)
    i = np.searchsorted(at, local - 86400, side="right") - 1
    last = np.searchsorted(at, local + 86400, side="right") - 1
    hits, utc = np.zeros(len(local), dtype=np.int64), np.zeros(len(local), dtype=np.int64)
    for k in range(int((last - i).max(initial=-1)) + 1):
        j = np.minimum(i + k, len(at) - 1)
        u = local - off[j]
        hit = (i + k <= last) & (at[j] <= u) & (u < until[j])
        hits += hit
        utc = np.where(hit, u, utc)
    return utc + shift, hits == 1
