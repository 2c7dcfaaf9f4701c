"""Relations and operations of intervals with open, closed and unknown ends."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from carex.functions.path_compiler import Typed, interval_of, is_interval, is_period, moment, number


def _bounds(t: Typed, precision: str | None, moments: bool) -> tuple[Column, Column, Column, Column]:
    """low, high and whether each is within; a point is an interval of itself. A null end does not bound."""
    if is_interval(t) or is_period(t):
        low, high, lc, hc, at = interval_of(t)
    else:
        low = high = moment(t) if moments else number(t)
        lc = hc = F.lit(True)
    if moments:
        low, high = low.cast("timestamp_ntz"), high.cast("timestamp_ntz")
        if precision:
            low, high = F.date_trunc(precision, low), F.date_trunc(precision, high)
    return low, high, lc, hc


def _has_moments(t: Typed) -> bool:
    if is_period(t):
        return True
    if is_interval(t):
        return interval_of(t)[4]
    return isinstance(t.dtype, (T.DateType, T.TimestampNTZType, T.TimestampType))


def timing(op: str, a: Typed, b: Typed, precision: str | None) -> Column:
    if op == "references":
        key = F.concat(F.lit("Patient/"), b.one().col) if not isinstance(b.dtype, T.StructType) else b.one().col.getField("id")
        ref = a.one().col.getField("reference") if isinstance(a.dtype, T.StructType) else a.one().col
        return F.element_at(F.split(ref, "/"), -1) == F.element_at(F.split(key, "/"), -1)
    moments = _has_moments(a) or _has_moments(b)
    (al, ah, alc, ahc), (bl, bh, blc, bhc) = _bounds(a, precision, moments), _bounds(b, precision, moments)
    starts_in = bl.isNull() | (al > bl) | ((al == bl) & (blc | ~alc))
    ends_in = bh.isNull() | (ah < bh) | ((ah == bh) & (bhc | ~ahc))
    a_before = (ah < bl) | ((ah == bl) & ~(ahc & blc))
    b_before = (bh < al) | ((bh == al) & ~(bhc & alc))
    same = (al == bl) & (ah == bh) & (alc == blc) & (ahc == bhc)
    if op in ("during", "included in"):
        return starts_in & ends_in
    if op in ("properly included in", "properly during"):
        return starts_in & ends_in & ~same
    if op in ("includes", "properly includes"):
        return timing({"includes": "included in"}.get(op, "properly included in"), b, a, precision)
    if op == "overlaps":
        return ~(a_before | b_before)
    if op == "overlaps before":
        return ~(a_before | b_before) & (al < bl)
    if op == "overlaps after":
        return ~(a_before | b_before) & (ah > bh)
    if op == "before":
        return a_before
    if op == "after":
        return b_before
    if op in ("on or before", "same or before"):
        return ah <= bl
    if op in ("on or after", "same or after"):
        return al >= bh
    if op == "same as":
        return same
    step = F.expr("interval 1 day") if moments else F.lit(1)
    meets_before = ((ah == bl) & (ahc != blc)) | ((ah + step == bl) & ahc & blc)
    meets_after = ((bh == al) & (bhc != alc)) | ((bh + step == al) & bhc & alc)
    if op == "meets":
        return meets_before | meets_after
    if op == "meets before":
        return meets_before
    if op == "meets after":
        return meets_after
    if op == "starts":
        return (al == bl) & (alc == blc) & ends_in
    if op == "ends":
        return (ah == bh) & (ahc == bhc) & starts_in
    raise ValueError(f"no relation is named {op}")


def _make(t: Typed, low: Column, high: Column, lc: Column, hc: Column) -> Typed:
    return Typed(F.struct(low.alias("low"), high.alias("high"), lc.alias("lowClosed"), hc.alias("highClosed")), t.dtype)


def intersection(a: Typed, b: Typed) -> Typed:
    (al, ah, alc, ahc, _), (bl, bh, blc, bhc, _) = interval_of(a), interval_of(b)
    low, high = F.greatest(al, bl), F.least(ah, bh)
    lc = F.when(al == bl, alc & blc).when(al > bl, alc).otherwise(blc)
    hc = F.when(ah == bh, ahc & bhc).when(ah < bh, ahc).otherwise(bhc)
    made = _make(a, low, high, lc, hc)
    return Typed(F.when(timing("overlaps", a, b, None), made.col), made.dtype)


def union(a: Typed, b: Typed) -> Typed:
    (al, ah, alc, ahc, _), (bl, bh, blc, bhc, _) = interval_of(a), interval_of(b)
    lc = F.when(al == bl, alc | blc).when(al < bl, alc).otherwise(blc)
    hc = F.when(ah == bh, ahc | bhc).when(ah > bh, ahc).otherwise(bhc)
    made = _make(a, F.least(al, bl), F.greatest(ah, bh), lc, hc)
    return Typed(F.when(timing("overlaps", a, b, None) | timing("meets", a, b, None), made.col), made.dtype)


def difference(a: Typed, b: Typed) -> Typed:
    """What of a lies outside b: none, one or two intervals."""
    (al, ah, alc, ahc, _), (bl, bh, blc, bhc, _) = interval_of(a), interval_of(b)
    left = F.when((al < bl) | ((al == bl) & alc & ~blc), _make(a, al, F.least(ah, bl), alc, F.when(ah < bl, ahc).otherwise(~blc)).col)
    right = F.when((ah > bh) | ((ah == bh) & ahc & ~bhc), _make(a, F.greatest(al, bh), ah, F.when(al > bh, alc).otherwise(~bhc), ahc).col)
    whole = F.array(a.one().col)
    return Typed(F.when(~timing("overlaps", a, b, None), whole).otherwise(F.filter(F.array(left, right), lambda x: x.isNotNull())), a.dtype, True)


def collapse(t: Typed) -> Typed:
    """Overlapping or touching closed intervals of a list merged, in order."""
    ordered = F.array_sort(F.filter(t.array(), lambda x: x.isNotNull()))
    empty = F.slice(ordered, 1, 0)

    def merge(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(
            last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"),
            last["lowClosed"].alias("lowClosed"), F.when(last["high"] >= x["high"], last["highClosed"]).otherwise(x["highClosed"]).alias("highClosed"),
        )
        touch = last["high"] >= x["low"]
        return F.when(F.size(done) == 0, F.array(x)).when(
            touch, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        ).otherwise(F.concat(done, F.array(x)))

    return Typed(F.aggregate(ordered, empty, merge), t.dtype, True)
