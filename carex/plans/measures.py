"""Quality measures: populations as boolean columns per subject, scores and reports from one aggregate."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from carex.functions.path_compiler import Scope, boolean, compile_tree, number, root_of
from carex.functions.path_parser import parse

POPULATIONS = (
    "initial-population", "denominator", "denominator-exclusion", "denominator-exception", "numerator", "numerator-exclusion",
    "measure-population", "measure-population-exclusion",
)
NEEDS = {
    "denominator": "initial-population", "denominator-exclusion": "denominator", "denominator-exception": "denominator", "numerator": "denominator",
    "numerator-exclusion": "numerator", "measure-population": "initial-population", "measure-population-exclusion": "measure-population",
}
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


@dataclass
class Measure:
    """criteria: population -> boolean path over a subject's row; observation and stratifiers: paths."""

    name: str
    scoring: str = "proportion"
    criteria: dict[str, str] = field(default_factory=dict)
    observation: str | None = None
    stratifiers: dict[str, str] = field(default_factory=dict)


def membership(subjects: DataFrame, measure: Measure, subject: str = "id", as_of: str | None = None) -> DataFrame:
    """One row a subject: a boolean for each population; a subject is in a population only if in those it builds on."""
    unknown = set(measure.criteria) - set(POPULATIONS)
    if unknown:
        raise ValueError(f"no population is named {sorted(unknown)}")
    root = root_of(subjects.schema)
    s = Scope(root, root, as_of=as_of)
    made: dict[str, Column] = {}

    def of(name: str) -> Column:
        if name not in made:
            own = F.coalesce(boolean(compile_tree(parse(measure.criteria[name]), s)), F.lit(False)) if name in measure.criteria else F.lit(name in ("initial-population", "denominator", "measure-population"))
            made[name] = own & of(NEEDS[name]) if name in NEEDS else own
        return made[name]

    cols = [of(p).alias(p) for p in POPULATIONS]
    extra = [number(compile_tree(parse(measure.observation), s)).cast("double").alias("observation")] if measure.observation else []
    extra += [compile_tree(parse(p), s).one().col.alias(n) for n, p in measure.stratifiers.items()]
    return subjects.select(F.col(subject).alias("subject"), *cols, *extra)


def population_counts(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Subjects in each population, and in what counts for the score: numerator and denominator after exclusions.

    A subject of an exception counts as such only outside the numerator.
    """
    excluded = F.col("denominator-exclusion")
    numer = F.col("numerator") & ~excluded & ~F.col("numerator-exclusion")
    denom = F.col("denominator") & ~excluded & ~(F.col("denominator-exception") & ~F.col("numerator"))
    counts = [F.count_if(F.col(f"`{p}`")).alias(p.replace("-", "_")) for p in POPULATIONS]
    return members.groupBy(*(by or [])).agg(*counts, F.count_if(numer).alias("numerator_count"), F.count_if(denom).alias("denominator_count"))


def proportion(counts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Score in percent with the Wilson interval; null without a denominator."""
    n, z = F.col("denominator_count").cast("double"), Z[confidence]
    p = F.try_divide(F.col("numerator_count").cast("double"), n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    reach = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = n > 0
    return counts.select(
        "*",
        F.when(some, p * 100).alias("score"),
        F.when(some, F.greatest(F.lit(0.0), middle - reach) * 100).alias("ci_low"),
        F.when(some, F.least(F.lit(1.0), middle + reach) * 100).alias("ci_high"),
    )


def ratio(counts: DataFrame) -> DataFrame:
    return counts.withColumn("score", F.try_divide(F.col("numerator_count").cast("double"), F.col("denominator_count").cast("double")))


def continuous(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Statistics of the observation over the measure population without its exclusions."""
    rows = members.where(F.col("measure-population") & ~F.col("measure-population-exclusion") & F.col("observation").isNotNull())
    x = F.col("observation")
    return rows.groupBy(*(by or [])).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.sum(x).alias("sum"), F.stddev_samp(x).alias("stdev"), F.var_samp(x).alias("variance"),
    )


def wilson(successes: int, total: int, confidence: float = 0.95) -> tuple[float, float] | None:
    """The interval for counts that are already on the driver."""
    if not total:
        return None
    z, p = Z[confidence], successes / total
    middle = (p + z * z / (2 * total)) / (1 + z * z / total)
    reach = z * math.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    return max(0.0, middle - reach), min(1.0, middle + reach)


def measure_report(counts: DataFrame, measure: Measure, period: tuple[str, str]) -> DataFrame:
    """A summary report document for each row of counts."""
    groups = F.array(
        *[
            F.struct(F.struct(F.array(F.struct(F.lit(p).alias("code"))).alias("coding")).alias("code"), F.col(p.replace("-", "_")).alias("count"))
            for p in POPULATIONS
            if p in measure.criteria or p in ("initial-population", "denominator")
        ]
    )
    doc = F.struct(
        F.lit("MeasureReport").alias("resourceType"), F.lit("complete").alias("status"), F.lit("summary").alias("type"), F.lit(measure.name).alias("measure"),
        F.struct(F.lit(period[0]).alias("start"), F.lit(period[1]).alias("end")).alias("period"), F.array(F.struct(groups.alias("population"))).alias("group"),
    )
    return counts.select(F.to_json(doc).alias("report"))


def cohort(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many subjects the initial population has."""
    return members.groupBy(*(by or [])).agg(F.count_if(F.col("initial-population")).alias("cohort"))


def nearest_rank(values: DataFrame, column: str, parts: list[float]) -> DataFrame:
    """Percentiles that are values themselves (nearest rank)."""
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    return rows.agg(*[F.expr(f"percentile_disc({p}) within group (order by v)").alias(f"p{round(p * 100)}") for p in parts])


def subject_list(members: DataFrame, population: str) -> DataFrame:
    """The subjects of a population."""
    return members.where(F.col(f"`{population}`")).select("subject")


def individual_reports(members: DataFrame, measure: Measure) -> DataFrame:
    """One report document a subject."""
    groups = F.array(*[F.struct(F.lit(p).alias("code"), F.col(f"`{p}`").cast("int").alias("count")) for p in POPULATIONS])
    doc = F.struct(
        F.lit("MeasureReport").alias("resourceType"), F.lit("individual").alias("type"), F.lit(measure.name).alias("measure"),
        F.struct(F.concat(F.lit("Patient/"), F.col("subject")).alias("reference")).alias("subject"), groups.alias("population"),
    )
    return members.select("subject", F.to_json(doc).alias("report"))


def report_bundles(reports: DataFrame, pages: int = 1) -> DataFrame:
    """(page, bundle): bundle documents of the reports (column report), each report in one page by its hash; `pages` says
    over how many documents they are spread, so that no document grows with the subjects."""
    page = F.pmod(F.xxhash64("report"), F.lit(pages)).cast("int")
    entry = F.concat(F.lit('{"resource":'), F.col("report"), F.lit("}"))
    listed = reports.groupBy(page.alias("page")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    head = F.concat(F.lit('{"resourceType":"Bundle","type":"collection","total":'), F.size("e").cast("string"), F.lit(',"entry":['))
    return listed.select("page", F.concat(head, F.array_join("e", ","), F.lit("]}")).alias("bundle"))
