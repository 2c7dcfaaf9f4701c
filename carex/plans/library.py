"""Libraries of definitions: declarations, parameters, included libraries, and the order of dependencies."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from carex.functions.path_compiler import Scope, Typed, compile_tree, literal
from carex.functions.path_parser import Parser, PathError, tokens_of
from carex.plans.population import Population

STATEMENTS = ("library", "using", "include", "codesystem", "valueset", "code", "concept", "parameter", "context", "define")


class LibraryError(ValueError):
    """A library that cannot be read or bound."""


def _plain(token: tuple[str, str, int]) -> str:
    return token[1][1:-1] if token[0] in ("quoted", "string") else token[1]


@dataclass
class Library:
    name: str = ""
    version: str | None = None
    context: str = "Patient"
    includes: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    value_sets: dict[str, str] = field(default_factory=dict)
    code_systems: dict[str, str] = field(default_factory=dict)
    parameters: dict[str, str | None] = field(default_factory=dict)
    defines: dict[str, str] = field(default_factory=dict)
    private: set[str] = field(default_factory=set)

    @classmethod
    def parse(cls, text: str) -> Library:
        """A library from its text. A statement runs to the word that begins the next one."""
        try:
            tokens = tokens_of(text)
        except PathError as e:
            raise LibraryError(str(e)) from e
        starts = [k for k, t in enumerate(tokens) if t[0] == "name" and t[1] in STATEMENTS and cls._begins(tokens, k)]
        if not starts or starts[0] != 0:
            raise LibraryError("a library begins with a statement")
        lib = cls()
        for a, b in zip(starts, [*starts[1:], len(tokens) - 1]):
            lib._statement(tokens[a:b], text[tokens[a][2] : tokens[b][2]])
        return lib

    @staticmethod
    def _begins(tokens, k: int) -> bool:
        """Whether a word is a statement here and not the name of a field or an alias."""
        word, after = tokens[k][1], tokens[k + 1]
        before = tokens[k - 1][1] if k else ""
        if before in (".", ":", ",", "(", "=", "{") or after[1] in (".", ",", ")", "=", "in", "~"):
            return False
        return after[0] in ("name", "quoted") and (word != "code" or after[0] == "quoted")

    def _statement(self, tokens, text: str) -> None:
        word, rest = tokens[0][1], tokens[1:]
        names = [_plain(t) for t in rest]
        if word == "library":
            self.name, self.version = names[0], names[names.index("version") + 1] if "version" in names else None
        elif word == "include":
            alias = names[names.index("called") + 1] if "called" in names else names[0]
            self.includes[alias] = (names[0], names[names.index("version") + 1] if "version" in names else None)
        elif word in ("valueset", "codesystem"):
            (self.value_sets if word == "valueset" else self.code_systems)[names[0]] = names[2] if len(names) > 2 else names[0]
        elif word == "parameter":
            m = re.search(r"\bdefault\b(.*)$", text, re.S)
            self.parameters[names[0]] = m[1].strip() if m else None
        elif word == "context":
            self.context = names[0]
        elif word == "define":
            k = 1 if names[0] in ("private", "public", "function") and rest[1][1] != ":" else 0
            if len(rest) < k + 2 or rest[k + 1][1] != ":":
                raise LibraryError(f"a definition has a name and an expression: {text.strip()[:80]!r}")
            if names[k] in self.defines:
                raise LibraryError(f"{names[k]!r} is defined twice")
            self.defines[names[k]] = text[rest[k + 1][2] - tokens[0][2] + 1 :].strip()
            if names[0] == "private" and k:
                self.private.add(names[k])

    def order(self) -> list[str]:
        """Definitions so that each comes after those it uses."""
        uses, out, state = dependencies(self), [], {}

        def visit(name: str, path: tuple) -> None:
            if state.get(name) == 1:
                raise LibraryError(f"{' uses '.join([*path, name])}: definitions go round in a circle")
            if name not in state:
                state[name] = 1
                for n in sorted(uses[name]):
                    visit(n, (*path, name))
                state[name] = 2
                out.append(name)

        for n in self.defines:
            visit(n, ())
        return out

    def bind(self, population: Population, libraries: dict[str, Library] | None = None, parameters: dict | None = None) -> Callable[[str], DataFrame]:
        """A function that gives the rows of a definition over a population. Nothing runs before it is asked."""
        self.order()
        unknown = set(parameters or {}) - set(self.parameters)
        if unknown:
            raise LibraryError(f"there are no parameters {sorted(unknown)}")
        values: dict[str, Typed] = {}
        root = Typed(None, T.StructType([]), fields={})
        for name, default in self.parameters.items():
            if parameters and name in parameters:
                v = parameters[name]
                values[name] = literal(v, {bool: "boolean", int: "int", float: "double", str: "string"}[type(v)])
            elif default is not None:
                values[name] = compile_tree(Parser(default).whole(), Scope(root, root, as_of=population.as_of))
        mine = Population(dict(population.tables), population.value_sets, population.as_of, {**population.parameters, **values}, dict(self.defines))
        for alias, (name, version) in self.includes.items():
            found = (libraries or {}).get(name)
            if found is None or (version and found.version and found.version != version):
                raise LibraryError(f"library {name!r}{f' version {version}' if version else ''} is not here")
            run = found.bind(population, libraries)
            for d in found.defines:
                if d not in found.private:
                    mine.foreign[f"{alias}.{d}"] = lambda d=d, run=run: run(d)
        return mine.run


def per_patient(run: Callable[[str], DataFrame], patients: DataFrame, names: list[str], columns: dict[str, str] | None = None) -> DataFrame:
    """One row a patient: id and, for each definition, the number of its rows of that patient.

    A definition's rows name their patient by `columns` (default: id, or the reference of subject or patient).
    """
    from carex.operators.references import reference_key

    out = patients.select("id").distinct()
    for k, name in enumerate(names):
        rows = run(name)
        field = (columns or {}).get(name) or next(c for c in ("subject", "patient", "id") if c in rows.columns)
        key = F.col(field) if isinstance(rows.schema[field].dataType, T.StringType) else F.col(field)["reference"]
        counted = rows.groupBy(reference_key(key).alias(f"__k{k}")).agg(F.count(F.lit(1)).alias(f"__n{k}"))
        out = out.join(counted, F.col("id") == F.col(f"__k{k}"), "left").withColumn(name, F.coalesce(f"__n{k}", F.lit(0))).drop(f"__k{k}", f"__n{k}")
    return out


def dependencies(lib: Library) -> dict[str, set[str]]:
    """The definitions of the library that each definition names."""
    out = {}
    for name, text in lib.defines.items():
        names = {_plain(t) for t in tokens_of(text) if t[0] in ("name", "quoted")}
        out[name] = (names & set(lib.defines)) - ({name} if name not in names else set())
    return out
