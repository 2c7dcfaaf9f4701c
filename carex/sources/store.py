"""Stores of resources: readers of bundles, lists, single documents and lines; typed frames; sinks and catalog."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from time import perf_counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

STORE = "id string, resource_type string, resource string"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, resource_type, resource) of files with one document a line; what cannot be read is left out."""
    return _named(spark.read.text(path).select(F.col("value").alias("resource")))


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same of files that hold a bundle, a list of documents or one document each."""
    raw = spark.read.text(path, wholetext=True).select(F.expr("try_parse_json(value)").alias("v"))
    kinds = F.expr("schema_of_variant(v)")
    entries = F.expr("try_variant_get(v, '$.entry', 'array<variant>')")
    parts = (
        F.when(kinds.startswith("ARRAY"), F.expr("try_variant_get(v, '$', 'array<variant>')"))
        .when(entries.isNotNull(), F.expr("transform(try_variant_get(v, '$.entry', 'array<variant>'), e -> try_variant_get(e, '$.resource', 'variant'))"))
        .otherwise(F.array("v"))
    )
    return _named(raw.select(F.explode(parts).alias("r")).select(F.to_json("r").alias("resource")))


def _named(df: DataFrame) -> DataFrame:
    kept = df.where("try_parse_json(resource) is not null")
    return kept.select(F.get_json_object("resource", "$.id").alias("id"), F.get_json_object("resource", "$.resourceType").alias("resource_type"), "resource").where("resource_type is not null")


def _one_or_list(dtype: T.DataType) -> T.DataType:
    """The type with each list read as a variant, as a lone value may stand in its place."""
    if isinstance(dtype, T.ArrayType):
        return T.VariantType()
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _one_or_list(f.dataType)) for f in dtype])
    return dtype


def _declared(c: Column, dtype: T.DataType) -> Column:
    """A value read with `_one_or_list` under its declared type; a lone value becomes the list's only element."""
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType

        def element(x: Column) -> Column:
            if isinstance(inner, T.StructType):
                return _declared(F.from_json(F.to_json(x), _one_or_list(inner)), inner)
            return _declared(x, inner) if isinstance(inner, T.ArrayType) else F.try_variant_get(x, "$", inner.simpleString())

        many = F.try_variant_get(c, "$", "array<variant>")
        lone = F.when(c.isNotNull() & ~F.is_variant_null(c), F.array(c))
        return F.transform(F.when(F.schema_of_variant(c).startswith("ARRAY"), many).otherwise(lone), element)
    if isinstance(dtype, T.StructType) and _one_or_list(dtype) != dtype:
        return F.when(c.isNotNull(), F.struct(*[_declared(c.getField(f.name), f.dataType).alias(f.name) for f in dtype]))
    return c


def typed(resources: DataFrame, resource_type: str, ddl: str) -> DataFrame:
    """Rows of one type under a declared schema: only the named fields are parsed, and the path compiler sees them.

    A document wrapped in a JSON string counts as the document, and a lone value in place of a list as its element [0].
    Documents that are unreadable or no objects have no rows.
    """
    value = F.try_parse_json("resource")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.col("resource"))
    rows = resources.where(F.col("resource_type") == resource_type).select(text.alias("resource")).where("schema_of_variant(try_parse_json(resource)) like 'OBJECT%'")
    schema = T._parse_datatype_string(ddl)
    return rows.select(F.from_json("resource", _one_or_list(schema)).alias("r")).select(*[_declared(F.col("r").getField(f.name), f.dataType).alias(f.name) for f in schema])


def inferred_schema(resources: DataFrame, resource_type: str) -> str:
    """A schema that fits all documents of a type, from one aggregate over them."""
    kinds = resources.where(F.col("resource_type") == resource_type).agg(F.expr("schema_of_variant_agg(try_parse_json(resource))").alias("s")).first().s
    text = kinds.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    return text[len("STRUCT<") : -1] if text.startswith("STRUCT<") else text


def save(resources: DataFrame, path: str, mode: str = "append") -> None:
    """Write a store, one folder a resource type, so that a retrieve reads its type only."""
    resources.write.mode(mode).partitionBy("resource_type").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def insert(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Documents in memory as a store."""
    import json

    return spark.createDataFrame([(d.get("id"), d.get("resourceType"), json.dumps(d)) for d in documents], STORE)


def resource_counts(resources: DataFrame) -> DataFrame:
    return resources.groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


def from_jdbc(spark: SparkSession, url: str, table: str, column: str = "id", parts: int = 16, low: int | None = None, high: int | None = None, **options: str) -> DataFrame:
    """A table of another database, read in parts by a numeric column. Bounds that are not given are asked of the database."""
    if low is None or high is None:
        ask = f"(select min({column}) as low, max({column}) as high from {table}) bounds"
        found = spark.read.jdbc(url, ask, properties=options).first()
        low, high = (int(x) if given is None else given for given, x in ((low, found[0] or 0), (high, found[1] or 0)))
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


# Sinks
def export(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """json, csv, parquet or orc. Nested columns become JSON texts in CSV."""
    if form == "csv":
        nested = (T.ArrayType, T.StructType, T.MapType)
        df = df.select(*[F.to_json(c.name).alias(c.name) if isinstance(c.dataType, nested) else F.col(f"`{c.name}`") for c in df.schema])
        df.write.mode(mode).option("header", True).csv(path)
    elif form in ("json", "parquet", "orc"):
        getattr(df.write.mode(mode), form)(path)
    else:
        raise ValueError(f"there is no sink for {form!r}")


def create_view(df: DataFrame, name: str, materialised: bool = False, mode: str = "overwrite") -> None:
    """A temporary view, or a table that holds its rows."""
    if materialised:
        df.write.mode(mode).saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)


def create_schema(spark: SparkSession, name: str) -> None:
    """A schema for tables, if there is none of that name."""
    spark.sql(f"create schema if not exists `{name}`")


def unreadable(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, corrupt): the lines of files that hold no JSON, which `read_lines` leaves out."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("corrupt"))
    return rows.where("trim(corrupt) <> '' and try_parse_json(corrupt) is null")


def catalog(spark: SparkSession) -> list[tuple[str, bool]]:
    """(name, whether it is temporary) of tables and views."""
    return [(t.name, t.isTemporary) for t in spark.catalog.listTables()]


@dataclass
class BatchResult:
    name: str
    rows: int | None
    seconds: float
    error: str | None = None


def run_batch(queries: dict[str, DataFrame], folder: str, form: str = "parquet", parallel: int = 4) -> list[BatchResult]:
    """Write several frames at once, in order of their names' insertion; one that fails does not stop the others."""

    def one(item: tuple[str, DataFrame]) -> BatchResult:
        name, df = item
        began = perf_counter()
        try:
            export(df, f"{folder}/{name}", form, "overwrite")
            rows = df.sparkSession.read.format(form).load(f"{folder}/{name}").count()
            return BatchResult(name, rows, perf_counter() - began)
        except Exception as e:  # noqa: BLE001
            return BatchResult(name, None, perf_counter() - began, str(e)[:500])

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(one, queries.items()))
