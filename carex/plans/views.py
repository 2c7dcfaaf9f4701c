"""Tabular views over resources: columns, nested selects, for-each unnesting, unions, filters and constants.

A view becomes one projection. Every select node yields an array of rows (structs); siblings multiply by nested
transforms, unions concatenate, for-each maps and flattens, and a single generator unnests the result. The plan has
one scan and no join, and only the columns that the paths name are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from carex.functions.path_compiler import FHIR_TYPES, Scope, Typed, boolean, compile_tree, literal, root_of
from carex.functions.path_parser import PathError, parse

CONSTANT_TYPES = {
    "valueString": "string", "valueBoolean": "boolean", "valueInteger": "int", "valueDecimal": "double", "valueInteger64": "bigint",
    "valuePositiveInt": "int", "valueUnsignedInt": "int", "valueDate": "string", "valueDateTime": "string", "valueInstant": "string",
    "valueTime": "string", "valueCode": "string", "valueId": "string", "valueOid": "string", "valueUri": "string", "valueUrl": "string",
    "valueUuid": "string", "valueBase64Binary": "string", "valueCanonical": "string",
}


class ViewError(ValueError):
    """A view that cannot be compiled."""


@dataclass
class Rows:
    """Columns of one row (fixed), or an array of rows."""

    names: list[str]
    types: list[T.DataType]
    fixed: list[Column] | None = None
    array: Column | None = None

    def as_array(self) -> Column:
        if self.array is not None:
            return self.array
        return F.array(F.struct(*[c.cast(t).alias(n) for c, t, n in zip(self.fixed, self.types, self.names)]))

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in zip(self.names, self.types)])


@dataclass
class ViewDefinition:
    resource: str
    select: list[dict]
    where: list[dict] = field(default_factory=list)
    constant: list[dict] = field(default_factory=list)
    name: str | None = None

    @classmethod
    def of(cls, view: dict) -> ViewDefinition:
        if not isinstance(view, dict) or not view.get("resource"):
            raise ViewError("a view names its resource")
        if not isinstance(view.get("select"), list) or not view["select"]:
            raise ViewError("a view has at least one select")
        return cls(view["resource"], view["select"], view.get("where") or [], view.get("constant") or [], view.get("name"))


def constants_of(view: ViewDefinition) -> dict[str, Typed]:
    out = {}
    for c in view.constant:
        values = [k for k in c if k.startswith("value")]
        if not re.fullmatch(r"[A-Za-z_]\w*", str(c.get("name", ""))) or len(values) != 1 or values[0] not in CONSTANT_TYPES:
            raise ViewError(f"a constant has a name and one value: {c}")
        out[c["name"]] = literal(c[values[0]], CONSTANT_TYPES[values[0]])
    return out


def _path(text) -> tuple:
    try:
        return parse(text)
    except PathError as e:
        raise ViewError(str(e)) from e


def _column(c: dict, s: Scope, nested: bool) -> tuple[str, T.DataType, Column]:
    if not isinstance(c, dict) or not c.get("name") or not re.fullmatch(r"[A-Za-z_]\w*", c["name"]):
        raise ViewError(f"a column has a name of letters, digits and underscores: {c}")
    t = compile_tree(_path(c.get("path")), s)
    if c.get("collection"):
        dtype = T.ArrayType(t.dtype)
        return c["name"], dtype, t.array()
    if t.many and c.get("collection") is False and not nested:
        raise ViewError(f"column {c['name']!r} may hold more than one value")
    one = t.one()
    want = FHIR_TYPES.get(c["type"]) if c.get("type") else None
    if want and not isinstance(one.dtype, T.StructType):
        if want in ("date", "timestamp_ntz") and isinstance(one.dtype, T.StringType):
            want = "string"  # kept as written: the precision is part of the value
        want = "double" if want.startswith("decimal") else want
        dtype = T._parse_datatype_string(want)
        return c["name"], dtype, one.col if one.dtype == dtype else one.col.try_cast(dtype)
    if isinstance(one.dtype, T.NullType):
        return c["name"], T.StringType(), one.col.cast("string")
    return c["name"], one.dtype, one.col


def _times(a: Rows, b: Rows) -> Rows:
    names, types = a.names + b.names, a.types + b.types
    if len(set(names)) < len(names):
        raise ViewError(f"two columns have one name: {sorted(n for n in names if names.count(n) > 1)}")
    if a.array is None and b.array is None:
        return Rows(names, types, a.fixed + b.fixed)

    def both(x, y):
        return F.struct(*[x[n].alias(n) for n in a.names], *[y[n].alias(n) for n in b.names])

    left, right = a.as_array(), b.as_array()
    return Rows(names, types, array=F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: both(x, y)))))


def _node(node: dict, s: Scope, nested: bool = False) -> Rows:
    each, or_null = node.get("forEach"), node.get("forEachOrNull")
    if each is not None or or_null is not None:
        focus = compile_tree(_path(each if each is not None else or_null), s)
        kept: list[Rows] = []

        def inner(x: Column) -> Column:
            rows = _body(node, s.inner(Typed(x, focus.dtype)), True)
            kept.append(rows)
            return rows.as_array()

        unnested = F.flatten(F.transform(focus.array(), inner))
        rows = kept[0]
        if or_null is not None:
            empty = F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in zip(rows.names, rows.types)]))
            unnested = F.when(F.size(focus.array()) == 0, empty).otherwise(unnested)
        return Rows(rows.names, rows.types, array=unnested)
    return _body(node, s, nested)


def _body(node: dict, s: Scope, nested: bool) -> Rows:
    out = Rows([], [], [])
    for key, part in node.items():
        if key == "column":
            cols = [_column(c, s, nested) for c in part]
            out = _times(out, Rows([n for n, _, _ in cols], [t for _, t, _ in cols], [c for _, _, c in cols]))
        elif key == "select":
            for inner in part:
                out = _times(out, _node(inner, s, nested))
        elif key == "unionAll":
            branches = [_node(b, s, nested) for b in part]
            if not branches or any(b.names != branches[0].names for b in branches):
                raise ViewError("the branches of a union have the same columns in the same order")
            dtype = T.ArrayType(branches[0].struct())
            out = _times(out, Rows(branches[0].names, branches[0].types, array=F.concat(*[b.as_array().cast(dtype) for b in branches])))
    if "where" in node:
        conditions = [boolean(compile_tree(_path(w["path"]), s)) for w in node["where"]]
        test = conditions[0]
        for c in conditions[1:]:
            test = test & c
        out = Rows(out.names, out.types, array=F.when(test, out.as_array()).otherwise(F.slice(out.as_array(), 1, 0)))
    if not out.names:
        raise ViewError("a select has columns")
    return out


def view_rows(resources: DataFrame, view: dict | ViewDefinition, as_of: str | None = None) -> DataFrame:
    """The rows of a view over the resources of its type. Works on batches and on streams."""
    v = view if isinstance(view, ViewDefinition) else ViewDefinition.of(view)
    root = root_of(resources.schema)
    s = Scope(root, root, v.resource, constants_of(v), as_of=as_of)
    df = resources
    for w in v.where:
        test = compile_tree(_path(w.get("path")), s)
        if not isinstance(test.dtype, (T.BooleanType, T.StringType)) or (isinstance(test.dtype, T.StringType) and test.fields is None and not test.many and _path(w["path"])[0] not in ("name", "member", "call")):
            raise ViewError(f"a filter is a boolean: {w}")
        if not isinstance(test.dtype, T.BooleanType):
            raise ViewError(f"a filter is a boolean: {w}")
        df = df.where(boolean(test))
    body = _body({"select": v.select}, s, False)
    if body.array is None:
        return df.select(*[c.cast(t).alias(n) for c, t, n in zip(body.fixed, body.types, body.names)])
    return df.select(F.inline(body.array))


class ViewBuilder:
    """Builds views step by step."""

    def __init__(self, resource: str):
        self.view: dict = {"resource": resource, "select": []}

    def columns(self, *cols: tuple, **paths: str) -> ViewBuilder:
        made = [dict(zip(("name", "path", "type"), c)) for c in cols] + [{"name": n, "path": p} for n, p in paths.items()]
        self.view["select"].append({"column": made})
        return self

    def for_each(self, path: str, or_null: bool = False, **paths: str) -> ViewBuilder:
        made = [{"name": n, "path": p} for n, p in paths.items()]
        self.view["select"].append({"forEachOrNull" if or_null else "forEach": path, "column": made})
        return self

    def union_all(self, *branches: dict) -> ViewBuilder:
        self.view["select"].append({"unionAll": list(branches)})
        return self

    def where(self, path: str) -> ViewBuilder:
        self.view.setdefault("where", []).append({"path": path})
        return self

    def constant(self, name: str, **value) -> ViewBuilder:
        self.view.setdefault("constant", []).append({"name": name, **value})
        return self

    def build(self) -> dict:
        ViewDefinition.of(self.view)
        return self.view


def preset(name: str) -> dict:
    """A ready view by name."""
    return PRESETS[name]()


PRESETS = {
    "patient_demographics": lambda: ViewBuilder("Patient").columns(id="id", family="name.first().family", given="name.first().given.join(' ')", gender="gender", birth_date="birthDate", active="active").build(),
    "patient_addresses": lambda: ViewBuilder("Patient").columns(patient_id="id").for_each("address", use="use", lines="line.join(', ')", city="city", state="state", postal_code="postalCode", country="country").build(),
    "patient_contacts": lambda: ViewBuilder("Patient").columns(patient_id="id").for_each("telecom", system="system", value="value", use="use").build(),
    "observation_values": lambda: ViewBuilder("Observation").columns(id="id", subject="subject.reference", code="code.coding.first().code", display="code.coding.first().display", effective="effectiveDateTime", value="valueQuantity.value", unit="valueQuantity.unit").build(),
    "vital_signs": lambda: ViewBuilder("Observation").columns(id="id", subject="subject.reference", code="code.coding.first().code", value="valueQuantity.value", unit="valueQuantity.unit").where("category.coding.where(code = 'vital-signs').exists()").build(),
    "lab_results": lambda: ViewBuilder("Observation").columns(id="id", subject="subject.reference", code="code.coding.first().code", value="valueQuantity.value", unit="valueQuantity.unit").where("category.coding.where(code = 'laboratory').exists()").build(),
    "claim_adjudications": lambda: {
        "resource": "ClaimResponse",
        "select": [
            {"column": [{"name": "id", "path": "id"}, {"name": "patient", "path": "patient.reference"}]},
            {"forEach": "item", "column": [{"name": "item_no", "path": "itemSequence"}], "select": [{"forEach": "adjudication", "column": [{"name": "category", "path": "category.text"}, {"name": "amount", "path": "amount"}]}]},
        ],
    },
}


def template(name: str, **parameters) -> dict:
    """A view from a template with parameters; those that are None add no condition. `template_names` lists them."""
    if name not in TEMPLATES:
        raise ValueError(f"there is no template {name!r}; there are {template_names()}")
    return TEMPLATES[name](**parameters)


def template_names() -> list[str]:
    return sorted(TEMPLATES)


def _text(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _one_of(path: str, values) -> str:
    """A condition that a path has one of some values."""
    return f"{path} in ({' | '.join(_text(v) for v in ([values] if isinstance(values, str) else values))})"


def _conditions(view: ViewBuilder, **wanted) -> dict:
    """The view with a condition for each path (dots written __) that has a value or values."""
    for path, values in wanted.items():
        if values is not None:
            view.where(_one_of(path.replace("__", "."), values))
    return view.build()


def _observations(codes=None, category=None, status=None, **columns) -> dict:
    view = ViewBuilder("Observation").columns(id="id", subject="subject.reference", code="code.coding.first().code", effective="effectiveDateTime", value="valueQuantity.value", unit="valueQuantity.unit", **columns)
    if codes is not None:
        view.where(f"code.coding.exists({_one_of('code', codes)})")
    if category is not None:
        view.where(f"category.coding.exists({_one_of('code', category)})")
    return _conditions(view, status=status)


def _coded(resource: str, at: str, status=None, codes=None, **columns) -> dict:
    """Records of a type with subject, code and a time."""
    view = ViewBuilder(resource).columns(id="id", subject="subject.reference", code="code.coding.first().code", display="code.coding.first().display", at=at, **columns)
    if codes is not None:
        view.where(f"code.coding.exists({_one_of('code', codes)})")
    return _conditions(view, status=status)


def _medications(status=None, intent=None) -> dict:
    view = ViewBuilder("MedicationRequest").columns(id="id", subject="subject.reference", medication="medicationCodeableConcept.coding.first().code", display="medicationCodeableConcept.text", authored="authoredOn", status="status")
    return _conditions(view, status=status, intent=intent)


def _encounters(status=None, kind=None) -> dict:
    view = ViewBuilder("Encounter").columns(id="id", subject="subject.reference", status="status", kind="class.code", start="period.start", end="period.end")
    return _conditions(view, status=status, **{"class__code": kind})


def _reports(status=None, codes=None) -> dict:
    return _coded("DiagnosticReport", "effectiveDateTime", status, codes, conclusion="conclusion")


def _identifiers(resource="Patient", system=None) -> dict:
    path = "identifier" if system is None else f"identifier.where({_one_of('system', system)})"
    return ViewBuilder(resource).columns(id="id").for_each(path, system="system", value="value", use="use").build()


def _demographics(gender=None, active=None) -> dict:
    view = ViewBuilder("Patient").columns(id="id", family="name.first().family", given="name.first().given.join(' ')", gender="gender", birth_date="birthDate")
    if active is not None:
        view.where("active" if active else "active.not()")
    return _conditions(view, gender=gender)


TEMPLATES = {
    "demographics": _demographics,
    "identifiers": _identifiers,
    "observations": _observations,
    "vital_signs": lambda **k: _observations(category="vital-signs", **k),
    "lab_results": lambda **k: _observations(category="laboratory", **k),
    "medications": _medications,
    "encounters": _encounters,
    "diagnostic_reports": _reports,
    "conditions": lambda codes=None: _coded("Condition", "onsetDateTime", codes=codes, clinical="clinicalStatus.coding.first().code"),
    "procedures": lambda status=None, codes=None: _coded("Procedure", "performedDateTime", status, codes),
}
