"""Population queries: retrieve, with and without, let, where, return, aggregate, sort, set operations, libraries.

A query compiles to one lazy plan. Relationships are semi- and anti-joins whose equalities Catalyst turns into hash
or merge joins, lets are expressions that are put in where they are used, and a library is a set of named plans.
Nothing is run before an action, and nothing is collected but the codes of a value set of checked size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from carex.functions.path_compiler import Scope, Typed, boolean, compile_tree, root_of
from carex.functions.path_parser import Parser, PathError
from carex.operators.references import reference_key
from carex.operators.terminology import canonical_system
from carex.session import materialise

AGGREGATES = {
    "Count": lambda c: F.count(c), "Sum": F.sum, "Avg": F.avg, "Min": F.min, "Max": F.max, "StdDev": F.stddev_samp, "Variance": F.var_samp,
    "Median": F.median, "PopulationStdDev": F.stddev_pop, "PopulationVariance": F.var_pop, "Mode": lambda c: F.mode(c, True), "Product": F.product,
}
CLAUSES = ("with", "without", "let", "where", "return", "aggregate", "sort")
MOST_CODES = 1000


class QueryParser(Parser):
    """Statements of the population language. Conditions inside them are expressions of the common grammar."""

    def statement(self):
        left = self.term()
        while self.peek()[1] in ("union", "intersect", "except", "|"):
            op = self.next()[1]
            left = ("set", "union" if op == "|" else op, left, self.term())
        return left

    def whole_statement(self):
        tree = self.statement()
        if self.peek()[0] != "end":
            raise PathError(f"unexpected {self.peek()[1]!r} at {self.peek()[2]} of {self.text!r}")
        return tree

    def term(self):
        kind, value, _ = self.peek()
        if kind == "name" and value in AGGREGATES and self.peek(1)[1] == "(":
            self.at += 2
            inner = self.statement()
            self.need(")")
            return ("fold", value, inner)
        if kind == "name" and value in ("First", "Last", "exists") and self.peek(1)[1] == "(":
            self.at += 2
            inner = self.statement()
            self.need(")")
            return ("pick", value, inner)
        if value == "from" and kind == "name":
            self.next()
            sources = [(self.source(), self.identifier())]
            while self.take(","):
                sources.append((self.source(), self.identifier()))
            return self.clauses(sources)
        src = self.source()
        if self.peek()[0] in ("name", "quoted") and self.peek()[1] not in (*CLAUSES, "union", "intersect", "except"):
            return self.clauses([(src, self.identifier())])
        return src

    def unary(self):
        """exists over rows inside a condition: exists [R], exists ([R] r where ...)."""
        at = 1 if self.peek(1)[1] == "(" else 0
        if self.peek()[1] == "exists" and self.peek()[0] == "name" and self.peek(1 + at)[1] == "[" and self.peek(2 + at)[0] in ("name", "quoted"):
            self.next()
            return ("exists rows", self.source())
        return super().unary()

    def source(self):
        if self.take("("):
            inner = self.statement()
            self.need(")")
            return inner
        if self.take("["):
            resource, code_path, terms = self.identifier(), None, None
            if self.take(":"):
                first = self.identifier()
                if self.take("in") or self.take("~") or self.take("="):
                    code_path, terms = first, self.identifier()
                else:
                    terms = first
            self.need("]")
            return ("retrieve", resource, code_path, terms)
        name = self.identifier()
        while self.peek()[1] == "." and self.peek(1)[0] in ("name", "quoted"):
            self.next()
            name += "." + self.identifier()
        return ("define", name)

    def clauses(self, sources):
        q = {"sources": sources, "relations": [], "let": [], "where": None, "return": None, "distinct": False, "aggregate": None, "sort": []}
        while True:
            if self.peek()[1] in ("with", "without"):
                kind = self.next()[1]
                src, alias = self.source(), self.identifier()
                self.need("such")
                self.need("that")
                q["relations"].append((kind, src, alias, self.expression()))
            elif self.take("let"):
                while True:
                    name = self.identifier()
                    self.need(":")
                    q["let"].append((name, self.expression()))
                    if not self.take(","):
                        break
            elif self.take("where"):
                q["where"] = self.expression()
            elif self.take("return"):
                q["distinct"] = self.take("distinct")
                self.take("all")
                q["return"] = self.expression()
            elif self.take("aggregate"):
                self.take("all")
                name = self.identifier()
                self.need("starting")
                start = self.expression(12)
                self.need(":")
                q["aggregate"] = (name, start, self.expression())
            elif self.take("sort"):
                self.need("by")
                while True:
                    by = self.expression()
                    down = self.take("desc") or self.take("descending")
                    self.take("asc") or self.take("ascending")
                    q["sort"].append((by, down))
                    if not self.take(","):
                        break
            else:
                return ("query", q)


@dataclass
class Population:
    """Resources by type, value sets and definitions against which queries run.

    tables: resource type -> frame of typed rows. value_sets: frame (valueset, system, code).
    as_of: the time that now and today stand for. parameters: name -> value.
    """

    tables: dict[str, DataFrame]
    value_sets: DataFrame | None = None
    as_of: str | None = None
    parameters: dict[str, Typed] = field(default_factory=dict)
    defines: dict[str, str] = field(default_factory=dict)
    foreign: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    _open: list[str] = field(default_factory=list)

    def define(self, name: str, text: str) -> Population:
        self.defines[name] = text
        return self

    def query(self, text: str) -> DataFrame:
        """The rows of a statement."""
        return self._run(QueryParser(text).whole_statement())

    def run(self, name: str) -> DataFrame:
        """The rows of a definition. Definitions may use one another, but not in a circle."""
        if name in self.foreign:
            return self.foreign[name]()
        if name not in self.defines:
            raise PathError(f"nothing is defined as {name!r}")
        if name in self._open:
            raise PathError(f"{' uses '.join([*self._open, name])}: definitions go round in a circle")
        self._open.append(name)
        try:
            return self.query(self.defines[name])
        finally:
            self._open.pop()

    # Sources
    def retrieve(self, resource: str, code_path: str | None = None, terms: str | None = None) -> DataFrame:
        if resource not in self.tables:
            raise PathError(f"there are no resources of type {resource!r}")
        df = self.tables[resource]
        return df if terms is None else self.in_value_set(df, terms, code_path or "code")

    def in_value_set(self, df: DataFrame, name: str, code_path: str = "code") -> DataFrame:
        """Rows with a code of the value set: a literal list where it is small, semi-joins beyond. A code of the set that
        has no system matches under any."""
        codes = self.value_sets.where(F.col("valueset") == name).select(canonical_system(F.col("system")).alias("system"), F.trim("code").alias("vs_code")).distinct()
        few = codes.limit(MOST_CODES + 1).collect()
        path = F.col(code_path).getField("coding") if "coding" not in code_path else F.col(code_path)
        if len(few) <= MOST_CODES:
            wanted = [r.vs_code for r in few if r.system is None]
            pairs = [f"{r.system}|{r.vs_code}" for r in few if r.system is not None]
            return df.where(F.exists(path, lambda c: F.trim(c["code"]).isin(wanted or [None]) | F.concat(canonical_system(c["system"]), F.lit("|"), F.trim(c["code"])).isin(pairs or [None])))
        keyed = materialise(df.withColumn("__row", F.monotonically_increasing_id()))  # written once, so that the numbers stay
        coded = keyed.select("__row", F.explode(path).alias("c")).select("__row", canonical_system(F.col("c.system")).alias("c_system"), F.trim("c.code").alias("c_code"))
        of_system = coded.join(codes.where("system is not null"), (F.col("c_system") == F.col("system")) & (F.col("c_code") == F.col("vs_code")), "left_semi")
        of_any = coded.join(codes.where("system is null"), F.col("c_code") == F.col("vs_code"), "left_semi")
        hits = of_system.unionByName(of_any)
        return keyed.join(hits.select("__row").distinct(), "__row", "left_semi").drop("__row")

    def _run(self, tree) -> DataFrame:
        kind = tree[0]
        if kind == "retrieve":
            return self.retrieve(*tree[1:])
        if kind == "define":
            return self.run(tree[1])
        if kind == "query":
            return self._query(tree[1])
        if kind == "set":
            a, b = self._run(tree[2]), self._run(tree[3])
            if tree[1] == "union":
                return a.unionByName(b).distinct()
            return a.intersect(b.select(a.columns)) if tree[1] == "intersect" else a.subtract(b.select(a.columns))
        if kind == "fold":
            df = self._run(tree[2])
            if tree[1] == "Count" and len(df.columns) != 1:
                return df.agg(F.count(F.lit(1)).alias("value"))
            if len(df.columns) != 1:
                raise PathError(f"{tree[1]} needs one value a row: add return")
            return df.agg(AGGREGATES[tree[1]](F.col(df.columns[0])).alias("value"))
        if kind == "pick":
            if tree[1] == "exists":
                return self._run(tree[2]).agg((F.count(F.lit(1)) > 0).alias("value"))
            inner = tree[2]
            if inner[0] != "query" or not inner[1]["sort"]:
                raise PathError(f"{tree[1]} needs a query with sort by: rows have no order of their own")
            if tree[1] == "Last":
                inner = ("query", inner[1] | {"sort": [(by, not down) for by, down in inner[1]["sort"]], "reverse": True})
            return self._run(inner).limit(1)
        raise PathError(f"{kind} is no statement")

    def _row(self, src, alias: str) -> DataFrame:
        df = self._run(src)
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(alias))

    def _query(self, q: dict) -> DataFrame:
        names: dict[str, Typed] = dict(self.parameters)
        df = None
        for src, alias in q["sources"]:
            rows = self._row(src, alias)
            names[alias] = Typed(F.col(f"`{alias}`"), rows.schema[alias].dataType)
            df = rows if df is None else df.join(rows)  # the where's equalities make it an equi-join
        root = Typed(None, T.StructType([]), fields={})

        def scope(more: dict[str, Typed] | None = None) -> Scope:
            return Scope(root, root, None, {}, names | (more or {}), as_of=self.as_of)

        for name, tree in q["let"]:
            names[name] = compile_tree(tree, scope())
        for kind, src, alias, condition in q["relations"]:
            rows = self._row(src, alias)
            test = boolean(compile_tree(condition, scope({alias: Typed(F.col(f"`{alias}`"), rows.schema[alias].dataType)})))
            df = df.join(rows, test, "left_semi" if kind == "with" else "left_anti")
        for part in conjuncts(q["where"]):
            kept = part[0] != "un" or part[1] != "not" or part[2][0] != "exists rows"
            if kept and part[0] != "exists rows":
                df = df.where(boolean(compile_tree(part, scope())))
                continue
            inner = part[1] if kept else part[2][1]
            own = inner[1] if inner[0] == "query" else None
            if own and len(own["sources"]) == 1 and own["where"] is not None and not (own["let"] or own["relations"] or own["aggregate"]):
                (src, alias), test = own["sources"][0], own["where"]
                rows = self._row(src, alias)
                on = boolean(compile_tree(test, scope({alias: Typed(F.col(f"`{alias}`"), rows.schema[alias].dataType)})))
            else:
                rows, on = self._run(inner).limit(1).select(F.lit(1).alias("__any")), F.lit(True)  # one row says whether there are any
            df = df.join(rows, on, "left_semi" if kept else "left_anti")
        if q["aggregate"] is not None:
            return self._fold(df, q, scope, names)
        if q["return"] is None:
            if len(q["sources"]) == 1:
                alias = q["sources"][0][1]
                sort = [self._order(compile_tree(b, scope({n: Typed(F.col(f"`{alias}`").getField(n), t.dataType.elementType if isinstance(t.dataType, T.ArrayType) else t.dataType, isinstance(t.dataType, T.ArrayType)) for n, t in ((f.name, f) for f in names[alias].dtype.fields)})), d, q.get("reverse", False)) for b, d in q["sort"]]
                df = df.orderBy(*sort) if sort else df
                return df.select(F.col(f"`{alias}`.*"))
            return df
        if q["return"][0] == "tuple":
            made = [(n, compile_tree(x, scope())) for n, x in q["return"][1]]
        else:
            made = [("value", compile_tree(q["return"], scope()))]
        out = df.select(*[t.col.alias(n) for n, t in made])
        out = out.distinct() if q["distinct"] else out
        if q["sort"]:
            r = root_of(out.schema)
            out = out.orderBy(*[self._order(compile_tree(b, Scope(r, r, as_of=self.as_of)), d, q.get("reverse", False)) for b, d in q["sort"]])
        return out

    @staticmethod
    def _order(t: Typed, down: bool, reverse: bool = False) -> Column:
        """Nulls come last, and so first where the order is turned round."""
        c = t.one().col
        if reverse:
            return c.desc_nulls_first() if down else c.asc_nulls_first()
        return c.desc_nulls_last() if down else c.asc_nulls_last()

    def _fold(self, df: DataFrame, q: dict, scope, names) -> DataFrame:
        """aggregate name starting x: e. A sum or product over the rows where e is one, so that it is combined map-side."""
        name, start, tree = q["aggregate"]
        begin = compile_tree(start, scope()).col.cast("double")
        if tree[0] == "bin" and tree[1] in ("+", "*") and ("name", name) in (tree[2], tree[3]):
            other = tree[3] if tree[2] == ("name", name) else tree[2]
            x = compile_tree(other, scope()).one().col.cast("double")
            folded = F.coalesce(F.sum(x), F.lit(0.0)) + begin if tree[1] == "+" else F.coalesce(F.product(x), F.lit(1.0)) * begin
            return df.agg(folded.alias("value"))
        raise PathError("an aggregate over rows adds to, or multiplies, its running value")


def conjuncts(tree) -> list:
    """The parts of a condition that all must hold."""
    if tree is None:
        return []
    return conjuncts(tree[2]) + conjuncts(tree[3]) if tree[:2] == ("bin", "and") else [tree]


def restricted(population: Population, ages: tuple[int | None, int | None] = (None, None), gender: str | None = None, ids: list[str] | None = None) -> Population:
    """The population of the patients of some ages (whole years, both ends included, as of `as_of`), a gender, or ids;
    other resources only where they refer to one of them. Resources without a reference to a patient stay whole."""
    patients = population.tables["Patient"]
    r = root_of(patients.schema)
    s = Scope(r, r, as_of=population.as_of)

    def holds(text: str) -> Column:
        return F.coalesce(boolean(compile_tree(Parser(text).whole(), s)), F.lit(False))

    for age, op in zip(ages, (">=", "<=")):
        if age is not None:
            patients = patients.where(holds(f"AgeInYears() {op} {int(age)}"))
    if gender is not None:
        patients = patients.where(F.col("gender") == gender)
    if ids is not None:
        patients = patients.where(F.col("id").isin(ids))
    known, tables = patients.select(F.col("id").alias("__id")).distinct(), {"Patient": patients}
    for kind, df in population.tables.items():
        ref = next((c for c in ("subject", "patient", "beneficiary") if c in df.columns), None)
        if kind != "Patient":
            tables[kind] = df if ref is None else df.join(known, reference_key(F.col(f"{ref}.reference")) == F.col("__id"), "left_semi")
    return Population(tables, population.value_sets, population.as_of, dict(population.parameters), dict(population.defines), dict(population.foreign))


def by_context(df: DataFrame, reference: str, values: dict[str, tuple[str, str]] | None = None, as_of: str | None = None) -> DataFrame:
    """Rows and statistics per context (what a reference path names): context, n and `values` (name -> (aggregate, path))."""
    r = root_of(df.schema)
    s = Scope(r, r, as_of=as_of)

    def col(path: str) -> Column:
        return compile_tree(Parser(path).whole(), s).one().col

    made = [AGGREGATES[f](col(p)).alias(n) for n, (f, p) in (values or {}).items()]
    return df.groupBy(reference_key(col(reference)).alias("context")).agg(F.count(F.lit(1)).alias("n"), *made)


def group_statistics(df: DataFrame, by: dict[str, str], values: dict[str, tuple[str, str]], as_of: str | None = None) -> DataFrame:
    """Statistics per derived key. by: name -> path; values: name -> (aggregate, path)."""
    r = root_of(df.schema)
    s = Scope(r, r, as_of=as_of)

    def col(path: str) -> Column:
        return compile_tree(Parser(path).whole(), s).one().col

    keys = [col(p).alias(n) for n, p in by.items()]
    return df.groupBy(*keys).agg(*[AGGREGATES[f](col(p)).alias(n) for n, (f, p) in values.items()])


def exact_median(values: DataFrame, column: str, most: int = 100_000) -> float | None:
    """The exact median of a column of any size: the bracket that holds the middle ranks is narrowed by approximate
    quantiles and counts until it has at most `most` rows or one value, and only those are brought to the driver."""
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = rows.count()
    if not n:
        return None
    first, last = (n - 1) // 2, n // 2  # ranks from 0
    inside, below, size = rows, 0, n
    while size > most:
        cuts = sorted(set(inside.agg(F.percentile_approx("v", [k / 50 for k in range(51)], 10_000)).first()[0]))
        if len(cuts) == 1:
            return cuts[0]
        counts = inside.agg(*[F.count_if(F.col("v") < c).alias(f"c{k}") for k, c in enumerate(cuts)], *[F.count_if(F.col("v") <= c).alias(f"e{k}") for k, c in enumerate(cuts)]).first()
        low = max(k for k in range(len(cuts)) if k == 0 or below + counts[f"c{k}"] <= first)
        high = min(k for k in range(len(cuts)) if k == len(cuts) - 1 or below + counts[f"e{k}"] > last)
        if low == high:
            return cuts[low]
        held = counts[f"e{high}"] - counts[f"c{low}"]
        if held >= size:  # a bracket of two values that repeat
            upto = [below + counts[f"e{k}"] for k in range(len(cuts))]
            of = [next(c for c, u in zip(cuts, upto) if u > rank) for rank in (first, last)]
            return sum(of) / 2
        below += counts[f"c{low}"]
        inside, size = inside.where((F.col("v") >= cuts[low]) & (F.col("v") <= cuts[high])), held
    kept = sorted(r.v for r in inside.collect())
    return (kept[first - below] + kept[last - below]) / 2


def patient_windows(df: DataFrame, patient: Column, at: Column, value: Column, tie: Column) -> DataFrame:
    """Per row: its number within the patient by time, the patient's rows and mean, and the side of the median.

    No task holds a patient or the population: numbers are given within a patient's month and moved on by the rows of
    its earlier months, counts and means are joined back (a hot patient is split by the planner), and the median comes
    from `exact_median`.
    """
    rows = df.select(patient.alias("patient"), at.alias("at"), value.alias("value"), tie.alias("tie")).withColumn("month", F.date_trunc("month", "at"))
    middle = exact_median(rows, "value")
    months = rows.groupBy("patient", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.count("value").alias("c"))
    of_patient, so_far = W.partitionBy("patient"), W.partitionBy("patient").orderBy("month")
    months = months.select(
        F.col("patient").alias("p"), F.col("month").alias("m"), (F.sum("n").over(so_far) - F.col("n")).alias("before"),
        F.sum("n").over(of_patient).alias("patient_record_count"), F.try_divide(F.sum("s").over(of_patient), F.sum("c").over(of_patient)).alias("patient_avg"),
    )
    within = rows.withColumn("k", F.row_number().over(W.partitionBy("patient", "month").orderBy("at", "tie")))
    joined = within.join(months, F.col("patient").eqNullSafe(F.col("p")) & F.col("month").eqNullSafe(F.col("m")))
    side = F.when(F.col("value") > middle, "Above").when(F.col("value") < middle, "Below").when(F.col("value").isNotNull(), "At Median") if middle is not None else F.lit(None).cast("string")
    return joined.select("patient", "at", "value", "tie", F.lit(middle).cast("double").alias("population_median"), (F.col("k") + F.col("before")).alias("record_sequence"), "patient_record_count", "patient_avg", side.alias("side"))


def most_recent(df: DataFrame, key: Column, at: Column, tie: Column) -> DataFrame:
    """The latest row of each key, by one map-side combined aggregate."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(key.alias("__key")).agg(F.max_by(whole, F.struct(at, tie)).alias("r")).select("r.*")
