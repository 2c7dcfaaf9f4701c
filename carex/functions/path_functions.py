"""Operators and functions of the languages, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from carex.functions import calendar as cal, intervals as iv
from carex.functions.path_compiler import (
    FHIR_TYPES, NUMERIC, TIME, Scope, Typed, boolean, comparable_pair, compile_tree, field_of, interval_of, is_interval,
    is_period, literal, moment, number, text, union_of, unify,
)
from carex.functions.path_parser import PathError

BOOL, STR, INT, LONG, DBL = T.BooleanType(), T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _size(t: Typed) -> Column:
    return F.size(F.filter(t.array(), lambda x: x.isNotNull()))


def _arith(op: str, a: Typed, b: Typed) -> Typed:
    if isinstance(b.one().dtype, T.StructType) and "unit" in b.one().dtype.fieldNames() and (isinstance(a.dtype, TIME) or isinstance(a.dtype, STR.__class__)):
        return _add_time(op, a, b)
    if op in ("+", "&") and (isinstance(a.dtype, T.StringType) or isinstance(b.dtype, T.StringType) or op == "&"):
        x, y = text(a), text(b)
        return Typed(F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))) if op == "&" else F.concat(x, y), STR)
    if is_interval(a.one()) and is_interval(b.one()) and op == "-":
        return iv.difference(a, b)
    x, y = number(a), number(b)
    whole = all(isinstance(t.one().dtype, (T.IntegerType, T.LongType)) for t in (a, b))
    if op in ("div", "mod"):
        y = F.when(y != 0, y)
        if op == "mod":
            return Typed(x % y, LONG if whole else DBL)
        q = x.cast("double") / y.cast("double")
        return Typed(F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long"), LONG)
    if op == "/":
        return Typed(F.try_divide(x.cast("double"), y.cast("double")), DBL)
    if op == "^":
        return Typed(F.pow(x.cast("double"), y.cast("double")), DBL)
    if not whole:
        x, y = x.cast("double"), y.cast("double")
    return Typed({"+": x + y, "-": x - y, "*": x * y}[op], LONG if whole else DBL)


def _add_time(op: str, a: Typed, b: Typed) -> Typed:
    q = b.one().col
    amount = q.getField("value") if op == "+" else -q.getField("value")
    out = None
    for unit in cal.UNITS:
        added = cal.plus(moment(a), amount, unit)
        test = F.regexp_replace(q.getField("unit"), "s$", "") == unit
        out = F.when(test, added) if out is None else out.when(test, added)
    return Typed(out.cast("timestamp_ntz"), T.TimestampNTZType())


def _equal(a: Typed, b: Typed) -> Column:
    if a.many and b.many:
        return F.when((_size(a) > 0) & (_size(b) > 0), a.array() == b.array().cast(T.ArrayType(a.dtype)))
    x, y = comparable_pair(a, b)
    return x == y


def _equivalent(a: Typed, b: Typed) -> Column:
    if a.many or b.many:
        return F.sort_array(F.transform(a.array(), lambda x: F.lower(F.trim(x.cast("string"))))) == F.sort_array(
            F.transform(b.array(), lambda x: F.lower(F.trim(x.cast("string"))))
        )
    if any(isinstance(x.dtype, NUMERIC) for x in (a, b)):
        return number(a).cast("double").eqNullSafe(number(b).cast("double"))
    return F.lower(F.trim(text(a))).eqNullSafe(F.lower(F.trim(text(b))))


def _contains(items: Typed, x: Typed) -> Column:
    if is_interval(items.one()) or is_period(items.one()):
        return iv.timing("included in", x, items, None)
    one = x.one()
    found = F.exists(items.array(), lambda e: comparable_pair(Typed(e, items.dtype), one)[0] == comparable_pair(Typed(e, items.dtype), one)[1])
    return F.when(one.col.isNotNull(), F.coalesce(found, F.lit(False)))


def binary(op: str, left, right, s: Scope) -> Typed:
    a, b = compile_tree(left, s), compile_tree(right, s)
    if op in ("and", "or"):
        x, y = boolean(a), boolean(b)
        return Typed(x & y if op == "and" else x | y, BOOL)
    if op == "xor":
        return Typed(boolean(a) != boolean(b), BOOL)
    if op == "implies":
        return Typed(~boolean(a) | boolean(b), BOOL)
    if op == "=":
        return Typed(_equal(a, b), BOOL)
    if op == "!=":
        return Typed(~_equal(a, b), BOOL)
    if op in ("~", "!~"):
        same = _equivalent(a, b)
        return Typed(same if op == "~" else ~same, BOOL)
    if op in ("<", "<=", ">", ">="):
        x, y = comparable_pair(a, b)
        return Typed({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], BOOL)
    if op == "in":
        return Typed(_contains(b, a), BOOL)
    if op == "contains":
        return Typed(_contains(a, b), BOOL)
    if op in ("|", "union", "intersect", "except") and is_interval(a.one()) and is_interval(b.one()) and not a.many:
        return {"intersect": iv.intersection, "except": iv.difference}.get(op, iv.union)(a, b)
    if op in ("|", "union"):
        return union_of(a, b, True)
    if op == "intersect":
        return Typed(F.array_intersect(a.array(), b.array().cast(T.ArrayType(a.dtype))), a.dtype, True)
    if op == "except":
        return Typed(F.array_except(a.array(), b.array().cast(T.ArrayType(a.dtype))), a.dtype, True)
    return _arith(op, a, b)


# Functions: name -> builder(base, arguments, scope). base is None for a call without one.
REGISTRY: dict[str, Callable[[Typed, list, Scope], Typed]] = {}


def register_function(*names: str):
    """Adds a function of the languages: builder(base, argument trees, scope) -> Typed."""

    def keep(fn):
        for n in names:
            REGISTRY[n] = fn
        return fn

    return keep


def call(base, name: str, args: list, s: Scope) -> Typed:
    b = compile_tree(base, s) if base is not None else None
    fn = REGISTRY.get(name) or REGISTRY.get(name[:1].lower() + name[1:])
    if fn is None:
        raise PathError(f"no function is named {name!r}")
    if b is None and name[0].isupper() and args and name not in NULLARY:
        b, args = compile_tree(args[0], s), args[1:]  # Count(x) is x.count()
    return fn(b if b is not None else s.this, args, s)


NULLARY = {"Now", "Today", "TimeOfDay", "DateTime", "Date", "Time", "Coalesce", "Quantity", "Code", "Tuple", "AgeInYears", "AgeInMonths", "AgeInYearsAt", "AgeInMonthsAt", "AgeInDays", "AgeInDaysAt", "CalculateAgeInYears", "CalculateAgeInYearsAt", "CalculateAgeInMonths", "CalculateAgeInDays", "Message"}


def _arg(args, k, s) -> Typed:
    return compile_tree(args[k], s)


def _lambda(t: Typed, tree, s: Scope, finish=boolean):
    return lambda x, i: finish(compile_tree(tree, s.inner(Typed(x, t.dtype), index=i)))


def _type_name(tree) -> str:
    while tree[0] == "member":
        if tree[1] in (("name", "System"), ("name", "FHIR")):
            return tree[2]
        tree = tree[1]
    return tree[1]


@register_function("exists")
def _exists(b, args, s):
    kept = F.filter(b.array(), _lambda(b, args[0], s)) if args else F.filter(b.array(), lambda x: x.isNotNull())
    return Typed(F.size(kept) > 0, BOOL)


@register_function("empty")
def _empty(b, args, s):
    return Typed(_size(b) == 0, BOOL)


@register_function("count")
def _count(b, args, s):
    return Typed(_size(b), INT)


@register_function("length")
def _length(b, args, s):
    return Typed(F.length(b.col), INT) if not b.many and isinstance(b.dtype, T.StringType) else _count(b, args, s)


@register_function("first")
def _first(b, args, s):
    return Typed(F.get(F.filter(b.array(), lambda x: x.isNotNull()), F.lit(0)), b.dtype)


@register_function("last")
def _last(b, args, s):
    return Typed(F.try_element_at(F.filter(b.array(), lambda x: x.isNotNull()), F.lit(-1)), b.dtype)


@register_function("where")
def _where(b, args, s):
    out = F.filter(b.array(), _lambda(b, args[0], s))
    return Typed(out, b.dtype, True)


@register_function("select")
def _select(b, args, s):
    seen = []

    def one(x, i):
        t = compile_tree(args[0], s.inner(Typed(x, b.dtype), index=i))
        seen.append(t)
        return t.array()

    out = F.flatten(F.transform(b.array(), one))
    return Typed(out, seen[0].dtype, True)


@register_function("distinct")
def _distinct(b, args, s):
    return Typed(F.array_distinct(b.array()), b.dtype, True)


@register_function("isDistinct")
def _is_distinct(b, args, s):
    return Typed(F.size(b.array()) == F.size(F.array_distinct(b.array())), BOOL)


@register_function("combine")
def _combine(b, args, s):
    return union_of(b, _arg(args, 0, s), False)


@register_function("union")
def _union(b, args, s):
    return union_of(b, _arg(args, 0, s), True)


@register_function("intersect")
def _intersect(b, args, s):
    return Typed(F.array_intersect(b.array(), _arg(args, 0, s).array().cast(T.ArrayType(b.dtype))), b.dtype, True)


@register_function("exclude", "except")
def _exclude(b, args, s):
    other = _arg(args, 0, s).array().cast(T.ArrayType(b.dtype))
    return Typed(F.filter(b.array(), lambda x: ~F.coalesce(F.array_contains(other, x), F.lit(False))), b.dtype, True)


@register_function("tail")
def _tail(b, args, s):
    return Typed(F.slice(b.array(), F.lit(2), F.greatest(F.size(b.array()), F.lit(1))), b.dtype, True)


@register_function("skip")
def _skip(b, args, s):
    n = F.greatest(_arg(args, 0, s).col.cast("int"), F.lit(0))
    return Typed(F.slice(b.array(), n + 1, F.greatest(F.size(b.array()), F.lit(1))), b.dtype, True)


@register_function("take")
def _take(b, args, s):
    return Typed(F.slice(b.array(), F.lit(1), F.greatest(_arg(args, 0, s).col.cast("int"), F.lit(0))), b.dtype, True)


@register_function("single", "singleton from")
def _single(b, args, s):
    return Typed(F.when(F.size(b.array()) == 1, F.get(b.array(), F.lit(0))), b.dtype)


@register_function("all")
def _all(b, args, s):
    return Typed(F.forall(F.transform(b.array(), _lambda(b, args[0], s)), lambda x: F.coalesce(x, F.lit(False))), BOOL)


def _fold(name: str, quantifier, wanted: bool):
    def fn(b, args, s):
        return Typed(quantifier(b.array(), lambda x: F.coalesce(x.cast("boolean") == wanted, F.lit(False))), BOOL)

    register_function(name)(fn)


for _n, _q, _w in (("allTrue", F.forall, True), ("allFalse", F.forall, False), ("anyTrue", F.exists, True), ("anyFalse", F.exists, False)):
    _fold(_n, _q, _w)


@register_function("subsetOf")
def _subset(b, args, s):
    return Typed(F.size(F.array_except(b.array(), _arg(args, 0, s).array().cast(T.ArrayType(b.dtype)))) == 0, BOOL)


@register_function("supersetOf")
def _superset(b, args, s):
    return Typed(F.size(F.array_except(_arg(args, 0, s).array().cast(T.ArrayType(b.dtype)), b.array())) == 0, BOOL)


@register_function("contains")
def _contains_fn(b, args, s):
    x = _arg(args, 0, s)
    if not b.many and isinstance(b.dtype, T.StringType):
        return Typed(F.contains(b.col, text(x)), BOOL)
    return Typed(_contains(b, x), BOOL)


@register_function("in")
def _in(b, args, s):
    return Typed(_contains(_arg(args, 0, s), b), BOOL)


def _child_arrays(b: Typed) -> Typed:
    if not isinstance(b.dtype, T.StructType):
        return Typed(F.array().cast("array<string>"), STR, True)
    parts = []
    for name in b.dtype.fieldNames():
        f = field_of(Typed(b.array(), b.dtype, True), name)
        parts.append(F.transform(f.array(), lambda x: F.to_json(x)) if isinstance(f.dtype, T.StructType) else f.array().cast("array<string>"))
    return Typed(F.concat(*parts), STR, True)


@register_function("children")
def _children(b, args, s):
    """Values one level down, as texts (objects as JSON)."""
    whole = b if b.fields is None else Typed(F.struct(*[(t.col).alias(n) for n, t in b.fields.items()]), b.dtype)
    return _child_arrays(whole)


@register_function("descendants")
def _descendants(b, args, s):
    """Values of all levels, as texts; a schema has a bounded depth, so the levels are unrolled."""
    whole = b if b.fields is None else Typed(F.struct(*[(t.col).alias(n) for n, t in b.fields.items()]), b.dtype)
    out, level = [], [whole]
    while level:
        out += [_child_arrays(x).array() for x in level]
        level = [
            f
            for x in level
            if isinstance(x.dtype, T.StructType)
            for n in x.dtype.fieldNames()
            if isinstance((f := field_of(Typed(x.array(), x.dtype, True), n)).dtype, T.StructType)
        ]
    return Typed(F.concat(*out), STR, True)


@register_function("repeat")
def _repeat(b, args, s):
    """Transitive closure: the schema bounds its depth."""
    found, level, seen = [], b, set()
    while True:
        level = _select(level, args, s)
        found.append(level)
        kind = level.dtype.simpleString()
        # Types nest finitely: a path that leads nowhere gives texts, and a type that comes again leads to itself.
        if not isinstance(level.dtype, T.StructType) or kind in seen:
            break
        seen.add(kind)
    if isinstance(found[-1].dtype, T.StringType) and isinstance(found[0].dtype, T.StructType):
        found.pop()
    kinds = {f.dtype.simpleString() for f in found}
    if len(kinds) == 1:
        return Typed(F.array_distinct(F.concat(*[f.array() for f in found])), found[0].dtype, True)
    # Levels of several types: an element has the fields of all, those of its own type filled.
    names: dict[str, T.DataType] = {}
    for f in found:
        for x in f.dtype.fields:
            if not (isinstance(names.get(x.name), T.ArrayType) or x.name in names):
                names[x.name] = x.dataType if not isinstance(x.dataType, (T.ArrayType, T.StructType)) else STR
    whole = T.StructType([T.StructField(n, d) for n, d in names.items()])

    def widen(f: Typed) -> Column:
        def one(x: Column) -> Column:
            made = [((F.to_json(x[n]) if isinstance(f.dtype[n].dataType, (T.ArrayType, T.StructType)) else x[n]).cast(d) if n in f.dtype.fieldNames() else F.lit(None).cast(d)).alias(n) for n, d in names.items()]
            return F.struct(*made)

        return F.transform(f.array(), one)

    return Typed(F.array_distinct(F.concat(*[widen(f) for f in found])), whole, True)


@register_function("aggregate")
def _aggregate(b, args, s):
    start = _arg(args, 1, s) if len(args) > 1 else literal(None, b.dtype)
    dtype = DBL if isinstance(start.dtype, NUMERIC) else start.dtype

    def step(total, x):
        return compile_tree(args[0], s.inner(Typed(x, b.dtype), total=Typed(total, dtype))).one().col.cast(dtype)

    return Typed(F.aggregate(b.array(), start.col.cast(dtype), step), dtype)


@register_function("iif")
def _iif(b, args, s):
    c, t = boolean(_arg(args, 0, s)), _arg(args, 1, s).one()
    f = _arg(args, 2, s).one() if len(args) > 2 else literal(None, t.dtype)
    x, y = unify(t, f)
    return Typed(F.when(c, x).when(~c, y), t.dtype if x is t.col else STR)


@register_function("flatten")
def _flatten(b, args, s):
    return Typed(F.flatten(b.col), b.dtype.elementType, True) if b.many and isinstance(b.dtype, T.ArrayType) else Typed(b.array(), b.dtype, True)


@register_function("distinctBy")
def _distinct_by(b, args, s):
    keys = F.transform(b.array(), _lambda(b, args[0], s, text))
    return Typed(F.filter(b.array(), lambda x, i: ~F.exists(F.slice(keys, F.lit(1), i), lambda k: k.eqNullSafe(F.get(keys, i)))), b.dtype, True)


@register_function("sortBy")
def _sort_by(b, args, s):
    pairs = F.transform(b.array(), lambda x, i: F.struct(compile_tree(args[0], s.inner(Typed(x, b.dtype), index=i)).one().col.alias("k"), i.alias("i"), x.alias("x")))
    keyed = F.transform(F.sort_array(F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), p["i"].alias("i"))), asc=len(args) < 2 or args[1] != ("lit", False, "boolean")), lambda p: F.get(b.array(), p["i"]))
    return Typed(keyed, b.dtype, True)


@register_function("groupBy")
def _group_by(b, args, s):
    keys = F.transform(b.array(), _lambda(b, args[0], s, text))
    out = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.filter(b.array(), lambda x, i: F.get(keys, i).eqNullSafe(k)).alias("elements")))
    return Typed(out, T.StructType([T.StructField("key", STR), T.StructField("elements", T.ArrayType(b.dtype))]), True)


@register_function("partitionBy")
def _partition_by(b, args, s):
    test = _lambda(b, args[0], s)
    yes = F.filter(b.array(), lambda x, i: F.coalesce(test(x, i), F.lit(False)))
    no = F.filter(b.array(), lambda x, i: ~F.coalesce(test(x, i), F.lit(False)))
    a = T.ArrayType(b.dtype)
    return Typed(F.struct(yes.alias("matching"), no.alias("nonMatching")), T.StructType([T.StructField("matching", a), T.StructField("nonMatching", a)]))


@register_function("frequencies")
def _frequencies(b, args, s):
    out = F.transform(F.array_distinct(b.array()), lambda v: F.struct(v.alias("value"), F.size(F.filter(b.array(), lambda x: x.eqNullSafe(v))).alias("count")))
    return Typed(out, T.StructType([T.StructField("value", b.dtype), T.StructField("count", INT)]), True)


@register_function("duplicates")
def _duplicates(b, args, s):
    return Typed(F.filter(F.array_distinct(b.array()), lambda v: F.size(F.filter(b.array(), lambda x: x == v)) > 1), b.dtype, True)


@register_function("isSorted")
def _is_sorted(b, args, s):
    return Typed(b.array() == F.array_sort(b.array()), BOOL)


@register_function("indexer")
def _indexer(b, args, s):
    x = F.get(b.array(), _arg(args, 0, s).col.cast("int"))
    return Typed(F.coalesce(x, _arg(args, 1, s).col.cast(b.dtype)) if len(args) > 1 else x, b.dtype)


# Strings
def _string(name: str, fn, dtype=STR):
    register_function(name)(lambda b, args, s: Typed(fn(text(b), *[_arg(args, k, s).one().col for k in range(len(args))]), dtype))


def _substring(x, start, size=None):
    inside = (start >= 0) & (start < F.length(x))
    return F.when(inside, F.substring(x, start + 1, size if size is not None else F.length(x)))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("\\Q"), x, F.lit("\\E"))


for _name, _fn, _type in (
    ("substring", _substring, STR), ("startsWith", F.startswith, BOOL), ("endsWith", F.endswith, BOOL), ("upper", F.upper, STR), ("toUpper", F.upper, STR),
    ("lower", F.lower, STR), ("toLower", F.lower, STR), ("trim", F.trim, STR), ("replace", F.replace, STR), ("indexOf", lambda x, y: F.position(y, x) - 1, INT),
    ("matches", lambda x, r: F.regexp_like(x, r), BOOL), ("replaceMatches", lambda x, r, y: F.regexp_replace(x, r, y), STR),
):
    _string(_name, _fn, _type)


@register_function("split")
def _split(b, args, s):
    return Typed(F.split(text(b), _quoted(_arg(args, 0, s).col)), STR, True)


@register_function("toChars")
def _to_chars(b, args, s):
    return Typed(F.split(text(b), ""), STR, True)


@register_function("join")
def _join(b, args, s):
    sep = _arg(args, 0, s).col if args else F.lit("")
    items = F.transform(b.array(), lambda x: x.cast("string"))
    return Typed(F.coalesce(F.call_function("array_join", items, sep), F.lit("")), STR)


for _name, _fn in (("urlEncode", F.url_encode), ("urlDecode", F.url_decode), ("base64Encode", lambda x: F.base64(F.encode(x, "UTF-8"))), ("base64Decode", lambda x: F.decode(F.unbase64(x), "UTF-8"))):
    _string(_name, _fn)


# Conversions
def _to_boolean(x: Column) -> Column:
    x = F.lower(x)
    return F.when(x.isin("true", "t", "yes", "y", "1", "1.0"), True).when(x.isin("false", "f", "no", "n", "0", "0.0"), False)


_TO = {
    "Boolean": (lambda t: _to_boolean(text(t)), BOOL), "String": (text, STR), "Integer": (lambda t: text(t).try_cast("int"), INT), "Long": (lambda t: text(t).try_cast("long"), LONG),
    "Decimal": (lambda t: text(t).try_cast("double"), DBL), "Date": (lambda t: text(t).try_cast("date"), T.DateType()), "DateTime": (lambda t: text(t).try_cast("timestamp_ntz"), T.TimestampNTZType()),
    "Time": (lambda t: F.when(text(t).rlike(r"^\d\d(:\d\d(:\d\d(\.\d+)?)?)?$"), text(t)), STR),
}
for _name, (_fn, _type) in _TO.items():
    register_function(f"to{_name}")(lambda b, args, s, _fn=_fn, _type=_type: Typed(_fn(b), _type))
    register_function(f"convertsTo{_name}")(lambda b, args, s, _fn=_fn: Typed(F.when(b.one().col.isNotNull(), _fn(b).isNotNull()), BOOL))


@register_function("toQuantity", "quantity")
def _to_quantity(b, args, s):
    t = T._parse_datatype_string("struct<value:double,unit:string>")
    if args:
        return Typed(F.struct(number(_arg(args, 0, s)).cast("double").alias("value"), text(_arg(args, 1, s)).alias("unit")), t)
    x = text(b)
    value = F.regexp_extract(x, r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")
    return Typed(F.when(value.isNotNull(), F.struct(value.alias("value"), F.regexp_replace(F.regexp_extract(x, r"^\s*[+-]?\d+(?:\.\d+)?\s*(.*?)\s*$", 1), "'", "").alias("unit"))), t)


@register_function("ofType", "as")
def _of_type(b, args, s):
    name = _type_name(args[0])
    if b.choices is not None:
        option = b.choices.get(name[:1].upper() + name[1:])
        return field_of(b.parent, option) if option else Typed(F.lit(None).cast(FHIR_TYPES.get(name, "string")), T._parse_datatype_string(FHIR_TYPES.get(name, "string")))
    want = FHIR_TYPES.get(name)
    if want is None or isinstance(b.dtype, T.StructType):
        return b
    dtype = T._parse_datatype_string(want)
    if b.dtype == dtype:
        return b
    return Typed(F.filter(F.transform(b.col, lambda x: x.try_cast(dtype)), lambda x: x.isNotNull()), dtype, True) if b.many else Typed(b.col.try_cast(dtype), dtype)


@register_function("is")
def _is(b, args, s):
    name = _type_name(args[0])
    if b.choices is not None:
        option = b.choices.get(name[:1].upper() + name[1:])
        return Typed(_size(field_of(b.parent, option)) > 0 if option else F.lit(False), BOOL)
    want = FHIR_TYPES.get(name)
    same = isinstance(b.dtype, T.StructType) if want is None else b.dtype.simpleString().split("(")[0] == want.split("(")[0]
    if want and not same and isinstance(b.dtype, T.StringType):
        return Typed(F.when(b.one().col.isNotNull(), b.one().col.try_cast(want).isNotNull()), BOOL)
    return Typed(F.when(b.one().col.isNotNull() if b.fields is None else F.lit(True), F.lit(same)), BOOL)


# Numbers
def _math(name: str, fn, dtype=DBL):
    register_function(name)(lambda b, args, s: Typed(fn(number(b).cast("double"), *[number(_arg(args, k, s)) for k in range(len(args))]), dtype))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


for _name, _fn, _type in (
    ("ceiling", lambda x: F.ceil(x).cast("long"), LONG), ("floor", lambda x: F.floor(x).cast("long"), LONG), ("truncate", lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"), LONG),
    ("round", lambda x, p=None: F.round(x, p.cast("int") if p is not None else 0), DBL), ("sqrt", lambda x: _finite(F.sqrt(x)), DBL), ("exp", F.exp, DBL), ("ln", lambda x: F.when(x > 0, F.ln(x)), DBL),
    ("log", lambda x, b=None: F.when(x > 0, F.ln(x) / F.ln(b if b is not None else F.lit(10.0))), DBL), ("power", lambda x, n: F.pow(x, n.cast("double")), DBL),
    ("add", lambda x, y: x + y, DBL), ("subtract", lambda x, y: x - y, DBL), ("multiply", lambda x, y: x * y, DBL), ("divide", lambda x, y: F.try_divide(x, y.cast("double")), DBL),
):
    _math(_name, _fn, _type)


@register_function("abs")
def _abs(b, args, s):
    t = b.one()
    return Typed(F.abs(number(t)), t.dtype if isinstance(t.dtype, NUMERIC) else DBL)


@register_function("precision")
def _precision(b, args, s):
    x = text(b)
    return Typed(F.when(x.rlike(r"^\d{4}-|^\d{4}$|^\d\d:"), F.length(F.regexp_replace(F.regexp_replace(x, r"(Z|[+-]\d\d:\d\d)$", ""), r"\D", ""))).otherwise(F.length(F.regexp_extract(x, r"\.(\d+)$", 1))), INT)


def _numbers(b: Typed, args, s) -> Column:
    if args:
        return F.array(number(b).cast("double"), *[number(_arg(args, k, s)).cast("double") for k in range(len(args))])
    t = b
    get = (lambda x: x.getField("value").cast("double")) if isinstance(t.dtype, T.StructType) else (lambda x: x.try_cast("double"))
    return F.filter(F.transform(t.array(), get), lambda x: x.isNotNull())


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def _mean(a: Column) -> Column:
    return F.try_divide(_sum(a), F.size(a))


def _variance(a: Column, sample: bool) -> Column:
    m = _mean(a)
    return F.try_divide(_sum(F.transform(a, lambda x: (x - m) * (x - m))), F.size(a) - (1 if sample else 0))


def _percentile(a: Column, p: Column) -> Column:
    o = F.array_sort(a)
    at = (F.size(o) - 1) * p
    low = F.floor(at).cast("int")
    return F.get(o, low) + (F.get(o, F.least(low + 1, F.size(o) - 1)) - F.get(o, low)) * (at - low)


def _mode(a: Column) -> Column:
    best = F.array_max(F.transform(F.array_distinct(a), lambda v: F.struct(F.size(F.filter(a, lambda x: x == v)).alias("n"), (-v).alias("v"))))
    return -best["v"]


for _name, _fn in {
    "sum": lambda a: F.when(F.size(a) > 0, _sum(a)), "avg": _mean, "product": lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(1.0), lambda t, x: t * x)),
    "median": lambda a: _percentile(a, F.lit(0.5)), "mode": _mode, "stdDev": lambda a: F.sqrt(_variance(a, True)), "variance": lambda a: _variance(a, True),
    "populationStdDev": lambda a: F.sqrt(_variance(a, False)), "populationVariance": lambda a: _variance(a, False),
}.items():
    register_function(_name)(lambda b, args, s, _fn=_fn: Typed(_fn(_numbers(b, args, s)), DBL))


@register_function("min", "least")
def _min(b, args, s):
    return Typed(F.array_min(_numbers(b, args, s)), DBL) if args or isinstance(b.dtype, NUMERIC) else Typed(F.array_min(b.array()), b.dtype)


@register_function("max", "greatest")
def _max(b, args, s):
    return Typed(F.array_max(_numbers(b, args, s)), DBL) if args or isinstance(b.dtype, NUMERIC) else Typed(F.array_max(b.array()), b.dtype)


@register_function("percentile")
def _percentile_fn(b, args, s):
    p = number(_arg(args, 0, s)).cast("double")
    return Typed(_percentile(_numbers(b, [], s), F.when(p > 1, p / 100).otherwise(p)), DBL)


def _step(sign: int):
    def fn(b, args, s):
        t = b.one()
        if isinstance(t.dtype, T.DateType):
            return Typed(F.date_add(t.col, sign), t.dtype)
        if isinstance(t.dtype, TIME):
            return Typed(F.timestamp_add("MILLISECOND", F.lit(sign), t.col), t.dtype)
        return Typed(number(t) + sign, t.dtype)

    return fn


register_function("predecessor")(_step(-1))
register_function("successor")(_step(1))


# Time
@register_function("now")
def _now(b, args, s):
    return Typed(F.lit(s.as_of).cast("timestamp_ntz") if s.as_of else F.localtimestamp(), T.TimestampNTZType())


@register_function("today")
def _today(b, args, s):
    return Typed(F.lit(s.as_of).cast("date") if s.as_of else F.current_date(), T.DateType())


@register_function("timeOfDay")
def _time_of_day(b, args, s):
    return Typed(F.date_format(_now(b, args, s).col, "HH:mm:ss"), STR)


for _unit in ("year", "month", "day", "hour", "minute", "second"):
    register_function(f"{_unit} from")(lambda b, args, s, _u=_unit: Typed(getattr(F, _u)(moment(b)), INT))


@register_function("date from")
def _date_from(b, args, s):
    return Typed(moment(b).cast("date"), T.DateType())


@register_function("time from")
def _time_from(b, args, s):
    return Typed(F.date_format(moment(b), "HH:mm:ss"), STR)


@register_function("dateTime", "date")
def _date_time(b, args, s):
    parts = [_arg(args, k, s).col.cast("int") for k in range(len(args))] + [F.lit(1)] * max(0, 3 - len(args))
    parts += [F.lit(0)] * (6 - len(parts))
    made = F.try_make_timestamp_ntz(*parts[:6])  # null for what no calendar has
    return Typed(made.cast("date"), T.DateType()) if len(args) <= 3 else Typed(made, T.TimestampNTZType())


for _unit in ("year", "month", "week", "day", "hour", "minute"):
    register_function(f"start of {_unit} of")(lambda b, args, s, _u=_unit: Typed(F.date_trunc(_u, moment(b)).cast("timestamp_ntz"), T.TimestampNTZType()))
    register_function(f"end of {_unit} of")(
        lambda b, args, s, _u=_unit: Typed(F.timestamp_add("MILLISECOND", F.lit(-1), cal.plus(F.date_trunc(_u, moment(b)).cast("timestamp_ntz"), F.lit(1), _u)), T.TimestampNTZType())
    )


def _age(unit: str, name: str):
    """AgeIn…() and AgeIn…(born) as of now; AgeIn…At(at), CalculateAgeIn…At(born, at) at a time."""
    at_time, given = name.endswith("At"), 2 if name.startswith("Calculate") and name.endswith("At") else 1

    def fn(b, args, s):
        trees = list(args)
        at = moment(compile_tree(trees.pop(), s)) if at_time and trees else _now(b, [], s).col
        born = compile_tree(trees[0], s) if trees else b if b.fields is None else field_of(b, "birthDate")
        if born is None or len(args) > given:
            raise PathError(f"{name} has no birth date here, or too many arguments")
        if not isinstance(born.dtype, T.StringType):
            return Typed(cal.duration(unit, moment(born), at), LONG)
        # A year or a month has an age only if its first and its last day give the same.
        most, least = (cal.duration(unit, x.cast("timestamp_ntz"), at) for x in cal.end_days(born.one().col)[1:])
        return Typed(F.when(least == most, most), LONG)

    return fn


for _unit, _names in (("year", ("AgeInYears", "AgeInYearsAt", "CalculateAgeInYears", "CalculateAgeInYearsAt")), ("month", ("AgeInMonths", "AgeInMonthsAt", "CalculateAgeInMonths")), ("day", ("AgeInDays", "AgeInDaysAt", "CalculateAgeInDays"))):
    for _name in _names:
        register_function(_name)(_age(_unit, _name))


def _boundary(high: bool):
    def fn(b, args, s):
        t = b.one()
        if isinstance(t.dtype, NUMERIC):
            places = t.dtype.scale if isinstance(t.dtype, T.DecimalType) else None
            x = t.col.cast("string")
            scale = F.lit(places) if places is not None else F.length(F.regexp_extract(x, r"\.(\d+)$", 1))
            half = F.lit(0.5) * F.pow(F.lit(10.0), -scale)
            out = t.col.cast("double") + half if high else t.col.cast("double") - half
            return Typed(F.round(out, 12), DBL)
        return Typed(cal.boundary(text(t), high), STR)

    return fn


register_function("lowBoundary")(_boundary(False))
register_function("highBoundary")(_boundary(True))


# Intervals
@register_function("start of")
def _start(b, args, s):
    return field_of(b.one(), "start") if is_period(b.one()) else field_of(b.one(), "low")


@register_function("end of")
def _end(b, args, s):
    return field_of(b.one(), "end") if is_period(b.one()) else field_of(b.one(), "high")


@register_function("width of", "size of", "width")
def _width(b, args, s):
    low, high, _, _, moments = interval_of(b)
    return Typed(F.datediff(high, low).cast("long") if moments else (high - low).cast("double"), LONG if moments else DBL)


@register_function("point from")
def _point(b, args, s):
    low, high, *_ = interval_of(b)
    return Typed(F.when(low == high, low), b.one().dtype["low"].dataType)


@register_function("collapse")
def _collapse(b, args, s):
    return iv.collapse(b)


@register_function("expand")
def _expand(b, args, s):
    low, high, lc, hc, _ = interval_of(b)
    n = number(_arg(args, 0, s))
    return Typed(F.struct((low - n).cast(b.dtype["low"].dataType).alias("low"), (high + n).cast(b.dtype["high"].dataType).alias("high"), lc.alias("lowClosed"), hc.alias("highClosed")), b.dtype)


for _op in ("overlaps", "before", "after", "meets", "starts", "ends", "during", "includes"):
    register_function(_op)(lambda b, args, s, _op=_op: Typed(iv.timing(_op, b, _arg(args, 0, s), None), BOOL))


# Clinical documents
@register_function("getValue", "value of")
def _get_value(b, args, s):
    t = b.one()
    if isinstance(t.dtype, T.StructType):
        if "value" in t.dtype.fieldNames():
            return field_of(t, "value")
        if "family" in t.dtype.fieldNames():
            given = F.array_join(field_of(t, "given").array(), " ") if "given" in t.dtype.fieldNames() else F.lit("")
            return Typed(F.concat_ws(", ", t.col.getField("family"), given), STR)
    return t


@register_function("extension")
def _extension(b, args, s):
    ext = field_of(b, "extension")
    if ext is None:
        return Typed(F.array().cast("array<string>"), STR, True)
    url = _arg(args, 0, s).col
    return Typed(F.filter(ext.array(), lambda e: e.getField("url") == url), ext.dtype, True)


@register_function("getResourceKey")
def _resource_key(b, args, s):
    return Typed(F.concat(F.lit(f"{s.resource_type}/"), field_of(s.root, "id").col.cast("string")), STR)


@register_function("getReferenceKey")
def _reference_key(b, args, s):
    ref = field_of(b, "reference") or b
    want = f"{_type_name(args[0])}/" if args else ""
    if ref.many:
        return Typed(F.filter(ref.col, lambda x: x.startswith(want)), STR, True)
    return Typed(F.when(ref.col.startswith(want), ref.col), STR)


# Units of one dimension, which alone can be compared.
DIMENSIONS = {
    "mass": "kg g mg ug ng [lb_av] [oz_av] [stone_av]", "length": "m cm mm um km [in_i] [ft_i] [mi_i]", "time": "s min h d wk mo a year month week day hour minute second",
    "temperature": "Cel K [degF]", "pressure": "mm[Hg] cm[Hg] kPa Pa bar", "mass concentration": "g/L g/dL mg/dL mg/L ug/mL kg/m3", "substance concentration": "mol/L mmol/L umol/L nmol/L",
    "share": "% 1 {ratio}", "volume": "L dL mL uL m3",
}


@register_function("comparable")
def _comparable(b, args, s):
    """Whether two quantities have units of one dimension; units of no known one compare with themselves only."""
    table = F.create_map(*[F.lit(x) for d, units in DIMENSIONS.items() for u in units.split() for x in (u, d)])
    x, y = (t.one().col.getField("unit") for t in (b, _arg(args, 0, s)))
    return Typed(F.coalesce(F.try_element_at(table, x) == F.try_element_at(table, y), x == y), BOOL)


def _subsumption(up: bool):
    def fn(b, args, s):
        """Over the constant %hierarchy: a map from a code to itself and its ancestors (terminology.hierarchy_map)."""
        if "hierarchy" not in s.constants:
            raise PathError("subsumes needs the constant %hierarchy")
        ancestors = s.constants["hierarchy"].col
        x, y = text(b), text(_arg(args, 0, s))
        low, high = (y, x) if up else (x, y)
        known = F.try_element_at(ancestors, low)
        return Typed(F.when(x.isNotNull() & y.isNotNull(), F.coalesce(F.array_contains(known, high), low == high)), BOOL)

    return fn


register_function("subsumes")(_subsumption(True))
register_function("subsumedBy")(_subsumption(False))


@register_function("message")
def _message(b, args, s):
    return _arg(args, 0, s)


@register_function("error")
def _error(b, args, s):
    """Fails on a row that reaches it, with the message."""
    return Typed(F.raise_error(text(_arg(args, 0, s))).cast("string"), STR)


# Nulls
@register_function("isNull")
def _is_null(b, args, s):
    return Typed(_size(b) == 0 if b.many else b.col.isNull(), BOOL)


@register_function("isNotNull")
def _is_not_null(b, args, s):
    return Typed(~_is_null(b, args, s).col, BOOL)


@register_function("isTrue")
def _is_true(b, args, s):
    return Typed(F.coalesce(boolean(b), F.lit(False)), BOOL)


@register_function("isFalse")
def _is_false(b, args, s):
    return Typed(F.coalesce(~boolean(b), F.lit(False)), BOOL)


@register_function("not")
def _not(b, args, s):
    return Typed(~boolean(b), BOOL)


@register_function("coalesce", "ifNull")
def _coalesce(b, args, s):
    items = [_arg(args, k, s).one() for k in range(len(args))]
    if b is not s.this:
        items.insert(0, b.one())
    return Typed(F.coalesce(*unify(*items)), items[0].dtype if len({x.dtype.simpleString() for x in items}) == 1 else (DBL if all(isinstance(x.dtype, NUMERIC) for x in items) else STR))


@register_function("nullIf")
def _null_if(b, args, s):
    return Typed(F.when(~F.coalesce(_equal(b, _arg(args, 0, s)), F.lit(False)), b.one().col), b.one().dtype)


@register_function("code", "concept", "toConcept")
def _code(b, args, s):
    return b


@register_function("withinNormalRange")
def _within(b, args, s):
    x = number(b).cast("double")
    return Typed((x >= number(_arg(args, 0, s))) & (x <= number(_arg(args, 1, s))), BOOL)


@register_function("memberOf", "inValueSet")
def _member_of(b, args, s):
    """Whether a code, a coding or any coding of a concept is in a list of codes."""
    codes = _arg(args, 0, s).array().cast("array<string>")
    if isinstance(b.dtype, T.StructType) and "coding" in b.dtype.fieldNames():
        b = field_of(b, "coding")
    if isinstance(b.dtype, T.StructType) and "code" in b.dtype.fieldNames():
        b = field_of(b, "code")
    return Typed(F.exists(b.array(), lambda c: F.array_contains(codes, F.trim(c.cast("string")))), BOOL)


@register_function("reduceBy")
def _reduce_by(b, args, s):
    return _aggregate(b, args, s)


@register_function("deepFlatten")
def _deep_flatten(b, args, s):
    t = b
    while t.many and isinstance(t.dtype, T.ArrayType):
        t = Typed(F.flatten(t.col), t.dtype.elementType, True)
    return Typed(F.array_distinct(t.array()), t.dtype, True)


def _by_key(name: str):
    def fn(b, args, s):
        other = _arg(args, 0, s)
        keys = F.transform(other.array(), lambda y: text(compile_tree(args[1], s.inner(Typed(y, other.dtype)))))
        mine = _lambda(b, args[1], s, text)
        if name == "unionBy":
            own = F.transform(b.array(), mine)
            fresh = F.filter(other.array(), lambda y: ~F.coalesce(F.array_contains(own, text(compile_tree(args[1], s.inner(Typed(y, other.dtype))))), F.lit(False)))
            return Typed(F.concat(b.array(), fresh.cast(T.ArrayType(b.dtype))), b.dtype, True)
        inside = lambda x, i: F.coalesce(F.array_contains(keys, mine(x, i)), F.lit(False))
        return Typed(F.filter(b.array(), inside if name == "intersectBy" else lambda x, i: ~inside(x, i)), b.dtype, True)

    return fn


for _name in ("unionBy", "intersectBy", "exceptBy"):
    register_function(_name)(_by_key(_name))


@register_function("slice")
def _slice(b, args, s):
    """slice(url): the extensions of one address; slice(name, discriminator): the elements whose field `discriminator`
    is `name`."""
    if len(args) < 2:
        return _extension(b, args, s)
    name, field = text(_arg(args, 0, s)), args[1][1]
    one = field_of(Typed(F.lit(None), b.dtype), field)
    if one is None:
        raise PathError(f"there is no field {field!r} to tell slices apart")
    return Typed(F.filter(b.array(), lambda x: field_of(Typed(x, b.dtype), field).one().col.cast("string") == name), b.dtype, True)


@register_function("checkModifiers")
def _check_modifiers(b, args, s):
    """The element itself if all its modifier extensions are among the given addresses."""
    ext = field_of(b.one() if b.fields is None else b, "modifierExtension")
    if ext is None:
        return b
    known = F.array(*[_arg(args, k, s).col for k in range(len(args))])
    fine = F.forall(ext.array(), lambda e: F.array_contains(known, e.getField("url")))
    return Typed(F.when(fine, b.one().col), b.dtype)


@register_function("elementDefinition")
def _element_definition(b, args, s):
    return Typed(F.lit(b.dtype.simpleString()), STR)

