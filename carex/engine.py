"""One entry to the engine: load, view, query, keep, export, measure."""

from __future__ import annotations

from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession

from carex.plans.library import Library
from carex.plans.measures import Measure, membership, population_counts, proportion
from carex.plans.population import Population
from carex.plans.views import preset, view_rows
from carex.sources import store


@dataclass
class Engine:
    """Typed frames by resource type. Every method but export, profile and create gives a lazy frame."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    value_sets: DataFrame | None = None
    as_of: str | None = None

    def register(self, resource_type: str, rows: DataFrame) -> Engine:
        self.tables[resource_type] = rows
        return self

    def load_documents(self, path: str | list[str], schemas: dict[str, str] | None = None) -> Engine:
        """Files of documents; a type without a schema gets the one that fits all its documents."""
        rows = store.read_documents(self.spark, path)
        kinds = list(schemas) if schemas else [r.resource_type for r in store.resource_counts(rows).collect()]
        for kind in kinds:
            ddl = (schemas or {}).get(kind) or f"struct<{store.inferred_schema(rows, kind)}>"
            self.tables[kind] = store.typed(rows, kind, ddl)
        return self

    def view(self, view: dict | str) -> DataFrame:
        """The rows of a view, or of a preset by name."""
        view = preset(view) if isinstance(view, str) else view
        return view_rows(self.tables[view["resource"]], view, self.as_of)

    def population(self) -> Population:
        return Population(self.tables, self.value_sets, self.as_of)

    def query(self, text: str) -> DataFrame:
        return self.population().query(text)

    def library(self, text: str, libraries: dict[str, Library] | None = None, parameters: dict | None = None):
        """A function from the names of a library's definitions to their rows."""
        return Library.parse(text).bind(self.population(), libraries, parameters)

    def measure(self, measure: Measure, resource_type: str = "Patient", by: list[str] | None = None) -> DataFrame:
        return proportion(population_counts(membership(self.tables[resource_type], measure, as_of=self.as_of), by))

    def create(self, view: dict | str, name: str, materialised: bool = False) -> None:
        store.create_view(self.view(view), name, materialised)

    def export(self, view: dict | str, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
        store.export(self.view(view), path, form, mode)

    def batch(self, views: dict[str, dict | str], folder: str, form: str = "parquet", parallel: int = 4) -> list[store.BatchResult]:
        return store.run_batch({n: self.view(v) for n, v in views.items()}, folder, form, parallel)

    @staticmethod
    def profile(df: DataFrame) -> dict:
        """Seconds of a full run and what the plan consists of."""
        began = perf_counter()
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        words = ("Exchange", "BroadcastHashJoin", "SortMergeJoin", "Generate", "HashAggregate", "Window", "MapInArrow", "FileScan")
        return {"seconds": perf_counter() - began} | {w: plan.count(w) for w in words}
