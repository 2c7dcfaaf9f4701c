"""Dates of the languages: literals of any precision, durations, differences, boundaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

UNITS = ("year", "month", "week", "day", "hour", "minute", "second")


def date_literal(text: str, typed):
    """A day, or a moment whose missing parts are the lowest; a time of day stays a text."""
    if text.startswith("T"):
        return typed(F.lit(text[1:]), T.StringType())
    if re.fullmatch(r"\d{4}(-\d\d){0,2}", text):
        whole = text + "-01-01"[len(text) - 4 :] if len(text) < 10 else text
        return typed(F.lit(whole).cast("date"), T.DateType())
    day, _, clock = text.partition("T")
    zone = re.search(r"(Z|[+-]\d\d:\d\d)$", clock)
    clock = clock[: zone.start()] if zone else clock
    full = f"{day}T{(clock or '00') + ':00:00'[len(clock) - 2 if len(clock) < 8 else 6 :]}"
    if zone and zone[1] != "Z":
        return typed(F.to_utc_timestamp(F.lit(full.replace("T", " ")), F.lit(zone[1])).cast("timestamp_ntz"), T.TimestampNTZType())
    return typed(F.lit(full).cast("timestamp_ntz"), T.TimestampNTZType())


def duration(unit: str, a: Column, b: Column) -> Column:
    """Whole periods from a to b."""
    return F.expr("1").cast("bigint") * F.timestamp_diff(unit.upper(), a, b)


def difference(unit: str, a: Column, b: Column) -> Column:
    """Boundaries of the unit crossed from a to b."""
    if unit == "week":
        return F.floor(F.datediff(F.date_trunc("week", b), F.date_trunc("week", a)) / 7).cast("bigint")
    if unit == "day":
        return F.datediff(b, a).cast("bigint")
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    if unit == "month":
        return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")
    return F.timestamp_diff(unit.upper(), F.date_trunc(unit, a), F.date_trunc(unit, b)).cast("bigint")


def plus(at: Column, amount: Column, unit: str) -> Column:
    return F.timestamp_add(unit.upper(), amount.cast("int"), at)


_CLOCK = r"([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?"
_ZONE = r"(Z|[+-]\d\d:\d\d)"


def end_days(text: Column) -> tuple[Column, Column, Column]:
    """(size, first, last): the days at the ends of a date text of any precision; null if it denotes no date.

    size is 4 for a year, 7 for a month, 10 for a day or a moment of that day."""
    size = F.when(text.rlike(r"^\d{4}$"), 4).when(text.rlike(r"^\d{4}-\d\d$"), 7).when(text.rlike(rf"^\d{{4}}-\d\d-\d\d([T ]{_CLOCK}{_ZONE}?)?$"), 10)
    first = F.concat(F.substring(text, 1, 10), F.when(size == 4, "-01-01").when(size == 7, "-01").when(size == 10, "")).try_cast("date")
    last = F.when(size == 4, F.concat(text, F.lit("-12-31")).try_cast("date")).when(size == 7, F.last_day(first)).otherwise(first)
    return size, first, last


def boundary(text: Column, high: bool) -> Column:
    """The earliest or latest text that a date, moment or time of any precision may stand for; null for other texts."""
    size, first, last = end_days(text)
    clock, zone = F.regexp_extract(text, rf"(?:^|[T ])({_CLOCK}){_ZONE}?$", 1), F.regexp_extract(text, rf":\d\d(?:\.\d+)?{_ZONE}$", 1)
    whole = "23:59:59.999" if high else "00:00:00.000"
    filled = F.concat(clock, F.substring(F.lit(whole), F.length(clock) + 1, F.lit(12)))
    day = F.date_format(last if high else first, "yyyy-MM-dd")
    moment = F.concat(day, F.lit("T"), filled, F.when(zone != "", zone).otherwise("-12:00" if high else "+14:00"))
    return F.when(text.rlike(rf"^{_CLOCK}$"), filled).when(size < 10, day).when(size == 10, moment)
