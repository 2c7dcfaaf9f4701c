"""Compiles expression trees to columns.

Every value is a `Typed`: a column, its Spark type and whether it is a collection (an array of that type). The
schema of the frame tells cardinalities, so navigation is getField and transform, filters and quantifiers are
higher-order functions, and no row leaves the JVM.

Empty collections and nulls are the same thing; logic is three-valued.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T

from carex.functions import calendar as cal
from carex.functions.path_parser import PathError, parse

NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.DecimalType, T.ShortType, T.ByteType)
TIME = (T.TimestampNTZType, T.TimestampType, T.DateType)
FHIR_TYPES = {
    "string": "string", "code": "string", "id": "string", "uri": "string", "url": "string", "canonical": "string", "uuid": "string",
    "oid": "string", "markdown": "string", "base64Binary": "string", "boolean": "boolean", "integer": "int", "positiveInt": "int",
    "unsignedInt": "int", "integer64": "bigint", "decimal": "decimal(38,12)", "date": "date", "dateTime": "timestamp_ntz", "instant": "timestamp_ntz",
    "time": "string", "String": "string", "Boolean": "boolean", "Integer": "int", "Long": "bigint", "Decimal": "decimal(38,12)", "Date": "date", "DateTime": "timestamp_ntz", "Time": "string",
}


@dataclass
class Typed:
    col: Column | None
    dtype: T.DataType
    many: bool = False
    choices: dict[str, str] | None = None
    parent: Typed | None = None
    fields: dict[str, Typed] | None = None

    def array(self) -> Column:
        if self.many:
            return F.coalesce(self.col, F.array().cast(T.ArrayType(self.dtype)))
        return F.when(self.col.isNotNull(), F.array(self.col)).otherwise(F.array().cast(T.ArrayType(self.dtype)))

    def one(self) -> Typed:
        return Typed(F.get(self.col, F.lit(0)), self.dtype) if self.many else self


@dataclass
class Scope:
    this: Typed
    root: Typed
    resource_type: str | None = None
    constants: dict[str, Typed] = field(default_factory=dict)
    names: dict[str, Typed] = field(default_factory=dict)
    index: Column | None = None
    total: Typed | None = None
    as_of: str | None = None

    def inner(self, this: Typed, **more) -> Scope:
        kept = {k: getattr(self, k) for k in ("root", "resource_type", "constants", "names", "index", "total", "as_of")}
        return Scope(this=this, **(kept | more))


def literal(value, dtype: T.DataType | str) -> Typed:
    dtype = T._parse_datatype_string(dtype) if isinstance(dtype, str) else dtype
    return Typed(F.lit(value).cast(dtype), dtype)


def root_of(schema: T.StructType, columns: Callable[[str], Column] = F.col) -> Typed:
    """The row itself as the start of all paths."""
    fields = {}
    for f in schema.fields:
        many = isinstance(f.dataType, T.ArrayType)
        fields[f.name] = Typed(columns(f"`{f.name}`"), f.dataType.elementType if many else f.dataType, many)
    return Typed(None, schema, fields=fields)


def field_of(t: Typed, name: str) -> Typed | None:
    """Member access; over a collection it maps and flattens, without nulls."""
    if t.fields is not None:
        if name in t.fields:
            return t.fields[name]
    elif not isinstance(t.dtype, T.StructType):
        return None
    names = list(t.fields) if t.fields is not None else t.dtype.fieldNames()
    if name not in names:
        options = {n[len(name) :]: n for n in names if n.startswith(name) and n[len(name) : len(name) + 1].isupper()}
        if not options:
            return None
        if len(options) == 1:
            only = field_of(t, next(iter(options.values())))
            return Typed(only.col, only.dtype, only.many, choices=options, parent=t)
        texts = [field_of(t, n) for n in options.values()]
        texts = [x for x in texts if not x.many and not isinstance(x.dtype, T.StructType)]
        col = F.coalesce(*[x.col.cast("string") for x in texts]) if texts else F.lit(None).cast("string")
        return Typed(col, T.StringType(), False, choices=options, parent=t)
    dtype = t.dtype[name].dataType
    inner_many = isinstance(dtype, T.ArrayType)
    element = dtype.elementType if inner_many else dtype
    if not t.many:
        return Typed(t.col.getField(name), element, inner_many)
    out = F.transform(t.col, lambda x: x.getField(name))
    if inner_many:
        out = F.flatten(F.filter(out, lambda x: x.isNotNull()))
    return Typed(F.filter(out, lambda x: x.isNotNull()), element, True)


def text(t: Typed) -> Column:
    return t.one().col.cast("string")


def number(t: Typed) -> Column:
    t = t.one()
    if isinstance(t.dtype, NUMERIC):
        return t.col
    if isinstance(t.dtype, T.StructType) and "value" in t.dtype.fieldNames():
        return t.col.getField("value")
    return t.col.try_cast("double")


def moment(t: Typed) -> Column:
    t = t.one()
    return t.col.cast("timestamp_ntz") if isinstance(t.dtype, TIME) else t.col.try_cast("timestamp_ntz")


def boolean(t: Typed) -> Column:
    t = t.one() if not t.many else Typed(F.get(t.col, F.lit(0)), t.dtype)
    if isinstance(t.dtype, T.BooleanType):
        return t.col
    if isinstance(t.dtype, T.StringType):
        return F.lower(t.col).try_cast("boolean")
    return F.when(t.col.isNotNull(), True)


def is_interval(t: Typed) -> bool:
    return isinstance(t.dtype, T.StructType) and {"low", "high"} <= set(t.dtype.fieldNames())


def is_period(t: Typed) -> bool:
    return isinstance(t.dtype, T.StructType) and {"start", "end"} <= set(t.dtype.fieldNames())


def interval_of(t: Typed) -> tuple[Column, Column, Column, Column, bool]:
    """low, high, low closed, high closed, whether its points are moments. A period is a closed interval of moments."""
    t = t.one()
    if is_period(t):
        return moment(field_of(t, "start")), moment(field_of(t, "end")), F.lit(True), F.lit(True), True
    low, high = t.col.getField("low"), t.col.getField("high")
    at = isinstance(t.dtype["low"].dataType, TIME)
    if "lowClosed" not in t.dtype.fieldNames():
        return low, high, F.lit(True), F.lit(True), at
    return low, high, t.col.getField("lowClosed"), t.col.getField("highClosed"), at


def comparable_pair(a: Typed, b: Typed) -> tuple[Column, Column]:
    a, b = a.one(), b.one()
    if isinstance(a.dtype, TIME) or isinstance(b.dtype, TIME):
        return moment(a), moment(b)
    numbers = [isinstance(x.dtype, NUMERIC) or (isinstance(x.dtype, T.StructType) and "value" in x.dtype.fieldNames()) for x in (a, b)]
    if any(numbers):
        return number(a).cast("double"), number(b).cast("double")
    if isinstance(a.dtype, T.BooleanType) != isinstance(b.dtype, T.BooleanType):
        return boolean(a), boolean(b)
    return a.col, b.col


def unify(*items: Typed) -> list[Column]:
    """The columns of values in one common type."""
    types = {x.dtype.simpleString() for x in items}
    if len(types) == 1:
        return [x.col for x in items]
    if all(isinstance(x.dtype, (*NUMERIC, T.NullType)) for x in items):
        return [x.col.cast("double") for x in items]
    return [x.col.cast("string") for x in items]


def common_type(*items: Typed) -> T.DataType:
    real = [x.dtype for x in items if not isinstance(x.dtype, T.NullType)]
    if len({x.simpleString() for x in real}) <= 1:
        return real[0] if real else T.StringType()
    return T.DoubleType() if all(isinstance(x, NUMERIC) for x in real) else T.StringType()


def union_of(a: Typed, b: Typed, distinct: bool) -> Typed:
    dtype = common_type(a, b)
    both = F.concat(*[x.array().cast(T.ArrayType(dtype)) for x in (a, b)])
    return Typed(F.array_distinct(both) if distinct else both, dtype, True)


def each(t: Typed, scope: Scope, tree, finish: Callable[[Typed], Column]) -> Callable:
    """A two-argument lambda over the elements that compiles `tree` with the element as $this."""
    return lambda x, i: finish(compile_tree(tree, scope.inner(Typed(x, t.dtype), index=i)))


def compile_tree(tree, s: Scope) -> Typed:
    kind = tree[0]
    if kind == "lit":
        value, what = tree[1], tree[2]
        if what == "decimal":
            digits = len(value.split(".")[1])
            return literal(value, T.DecimalType(max(len(value.replace(".", "")), digits + 1), digits))
        return literal(value, {"null": "void", "long": "bigint", "integer": "int"}.get(what, what))
    if kind == "quantity":
        value = F.lit(tree[1]).cast("double").alias("value")
        return Typed(F.struct(value, F.lit(tree[2]).alias("unit")), T._parse_datatype_string("struct<value:double,unit:string>"))
    if kind == "date":
        return cal.date_literal(tree[1], Typed)
    if kind == "const":
        if tree[1] in ("context", "resource", "rootResource"):
            return s.root
        if tree[1] not in s.constants:
            raise PathError(f"no constant is named {tree[1]!r}")
        return s.constants[tree[1]]
    if kind == "var":
        if tree[1] == "$this":
            return s.this
        if tree[1] == "$index" and s.index is not None:
            return Typed(s.index, T.IntegerType())
        if tree[1] == "$total" and s.total is not None:
            return s.total
        raise PathError(f"{tree[1]} has no value here")
    if kind == "name":
        return name_of(tree[1], s)
    if kind == "member":
        base = compile_tree(tree[1], s)
        return field_of(base, tree[2]) or Typed(F.lit(None).cast("string"), T.StringType())
    if kind == "index":
        base, at = compile_tree(tree[1], s), compile_tree(tree[2], s)
        if isinstance(at.dtype, T.StringType):
            raise PathError("an element is chosen by a number")
        if not base.many:
            return Typed(F.when(at.col == 0, base.col), base.dtype)
        return Typed(F.when(at.col >= 0, F.get(base.col, at.one().col.cast("int"))), base.dtype)
    if kind == "un":
        x = compile_tree(tree[2], s)
        if tree[1] == "not":
            return Typed(~boolean(x), T.BooleanType())
        x = x.one()
        return Typed(-x.col if tree[1] == "-" else x.col, x.dtype)
    if kind == "bin":
        from carex.functions.path_functions import binary

        return binary(tree[1], tree[2], tree[3], s)
    if kind == "timing":
        from carex.functions.intervals import timing

        return Typed(timing(tree[1], compile_tree(tree[2], s), compile_tree(tree[3], s), tree[4]), T.BooleanType())
    if kind == "between":
        a, b = compile_tree(tree[2], s), compile_tree(tree[3], s)
        fn = cal.difference if tree[4] else cal.duration
        return Typed(fn(tree[1], moment(a), moment(b)), T.LongType())
    if kind == "interval":
        low, high = compile_tree(tree[1], s).one(), compile_tree(tree[2], s).one()
        dtype = common_type(low, high)
        cols = [low.col.cast(dtype).alias("low"), high.col.cast(dtype).alias("high"), F.lit(tree[3]).alias("lowClosed"), F.lit(tree[4]).alias("highClosed")]
        kinds = [("low", dtype), ("high", dtype), ("lowClosed", T.BooleanType()), ("highClosed", T.BooleanType())]
        return Typed(F.struct(*cols), T.StructType([T.StructField(n, d) for n, d in kinds]))
    if kind == "list":
        items = [compile_tree(x, s).one() for x in tree[1]]
        if not items:
            return Typed(F.array().cast("array<string>"), T.StringType(), True)
        dtype = common_type(*items)
        return Typed(F.array(*[x.col.cast(dtype) for x in items]), dtype, True)
    if kind == "tuple":
        items = [(n, compile_tree(x, s)) for n, x in tree[1]]
        types = [T.StructField(n, T.ArrayType(x.dtype) if x.many else x.dtype) for n, x in items]
        return Typed(F.struct(*[x.col.alias(n) for n, x in items]), T.StructType(types))
    if kind in ("if", "case"):
        branches, other = ([(tree[1], tree[2])], tree[3]) if kind == "if" else (tree[1], tree[2])
        values = [compile_tree(v, s).one() for _, v in branches] + [compile_tree(other, s).one()]
        dtype = common_type(*values)
        out = None
        for (c, _), v in zip(branches, values):
            test, col = boolean(compile_tree(c, s)), v.col.cast(dtype)
            out = F.when(test, col) if out is None else out.when(test, col)
        return Typed(out.otherwise(values[-1].col.cast(dtype)), dtype)
    if kind == "call":
        from carex.functions.path_functions import call

        return call(tree[1], tree[2], tree[3], s)
    raise PathError(f"{kind} is no expression here")


def name_of(name: str, s: Scope) -> Typed:
    if name in s.names:
        return s.names[name]
    if (found := field_of(s.this, name)) is not None:
        return found
    if name == s.resource_type or (s.this is s.root and name in ("Resource", "DomainResource")):
        return s.root
    return Typed(F.lit(None).cast("string"), T.StringType())


def compile_path(path: str, schema: T.StructType, resource_type: str | None = None, constants: dict[str, Typed] | None = None, as_of: str | None = None) -> Typed:
    """An expression over the rows of a frame with this schema. as_of: the time that now and today stand for."""
    root = root_of(schema)
    return compile_tree(parse(path), Scope(root, root, resource_type, constants or {}, as_of=as_of))
