"""Codes, value sets and code systems as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Names under which the common code systems are written.
SYSTEMS = {
    "urn:oid:2.16.840.1.113883.6.1": "http://loinc.org", "urn:oid:2.16.840.1.113883.6.96": "http://snomed.info/sct",
    "urn:oid:2.16.840.1.113883.6.88": "http://www.nlm.nih.gov/research/umls/rxnorm", "urn:oid:2.16.840.1.113883.6.8": "http://unitsofmeasure.org",
    "urn:oid:2.16.840.1.113883.6.90": "http://hl7.org/fhir/sid/icd-10-cm", "LOINC": "http://loinc.org", "SNOMED": "http://snomed.info/sct", "RXNORM": "http://www.nlm.nih.gov/research/umls/rxnorm",
}


def canonical_system(system: Column) -> Column:
    """One address for a code system, however it is named."""
    table = F.create_map(*[F.lit(x) for pair in SYSTEMS.items() for x in pair])
    return F.coalesce(F.get(F.array(table[F.trim(system)]), F.lit(0)), F.trim(system))


def value_set(spark: SparkSession, name: str, codes: list[tuple[str | None, str]]) -> DataFrame:
    """(valueset, system, code) of a list of codes."""
    return spark.createDataFrame([(name, s, c) for s, c in codes], "valueset string, system string, code string")


def value_set_of_document(document: DataFrame) -> DataFrame:
    """(valueset, system, code) of value set documents (column resource): its composition and its expansion."""
    ddl = "struct<url:string,compose:struct<include:array<struct<system:string,concept:array<struct<code:string>>>>>,expansion:struct<contains:array<struct<system:string,code:string>>>>"
    d = document.select(F.from_json("resource", ddl).alias("v"))
    composed = d.select("v.url", F.explode("v.compose.include").alias("i")).select("url", "i.system", F.explode("i.concept.code").alias("code"))
    expanded = d.select("v.url", F.explode("v.expansion.contains").alias("c")).select("url", "c.system", "c.code")
    return composed.unionByName(expanded).distinct().withColumnRenamed("url", "valueset")


def validate_codes(rows: DataFrame, code: Column, system: Column, known: DataFrame) -> DataFrame:
    """The rows with is_valid: whether the known codes (system, code) hold theirs. The planner sizes the join."""
    keys = known.select(canonical_system(F.col("system")).alias("__s"), F.trim("code").alias("__c")).where("__c is not null").distinct().withColumn("__hit", F.lit(True))
    tested = rows.withColumn("__cs", canonical_system(system)).withColumn("__cc", F.trim(code))
    joined = tested.join(keys, (F.col("__cs") == F.col("__s")) & (F.col("__cc") == F.col("__c")), "left")
    return joined.withColumn("is_valid", F.col("__hit").isNotNull()).drop("__cs", "__cc", "__s", "__c", "__hit")


def subsumption_closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant) of a hierarchy (parent, child), itself included; paths double each round until none is new."""
    from carex.session import materialise

    nodes = edges.select(F.col("parent").alias("ancestor")).unionByName(edges.select(F.col("child").alias("ancestor"))).distinct()
    paths = materialise(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct())
    while True:
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.descendant") == F.col("b.ancestor")).select("a.ancestor", "b.descendant")
        more = materialise(paths.unionByName(longer).distinct())
        if more.count() == paths.count():
            break
        paths = more
    return paths.unionByName(nodes.select("ancestor", F.col("ancestor").alias("descendant"))).distinct()


def subsumes(rows: DataFrame, a: Column, b: Column, closure: DataFrame, name: str = "subsumes") -> DataFrame:
    """The rows with whether code `a` is `b` or an ancestor of it; null where either is null."""
    known = closure.select(F.col("ancestor").alias("__a"), F.col("descendant").alias("__d"), F.lit(True).alias("__hit")).distinct()
    joined = rows.withColumn("__x", a).withColumn("__y", b).join(known, (F.col("__x") == F.col("__a")) & (F.col("__y") == F.col("__d")), "left")
    told = F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull(), F.col("__hit").isNotNull() | (F.col("__x") == F.col("__y")))
    return joined.withColumn(name, told).drop("__x", "__y", "__a", "__d", "__hit")


def hierarchy_map(closure: DataFrame, most: int = 50_000):
    """The constant %hierarchy of paths: code -> itself and its ancestors, for closures of at most `most` pairs.

    Larger ones are joined with `subsumes`.
    """
    from carex.functions.path_compiler import Typed
    from pyspark.sql import types as T

    rows = closure.groupBy("descendant").agg(F.sort_array(F.collect_set("ancestor")).alias("up")).limit(most + 1).collect()
    if sum(len(r.up) for r in rows) > most:
        raise ValueError(f"the hierarchy has more than {most} pairs: join it with terminology.subsumes")
    items = [x for r in rows for x in (F.lit(r.descendant), F.array(*[F.lit(u) for u in r.up]))]
    kind = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    return Typed(F.create_map(*items) if items else F.create_map().cast(kind), kind)


def code_in_system(rows: DataFrame, code: Column, concepts: DataFrame, system: str) -> DataFrame:
    """The rows with in_system: whether a code is one of the concepts (system, code, display) of a code system."""
    return validate_codes(rows, code, F.lit(system), concepts).withColumnRenamed("is_valid", "in_system")


def lookup_codes(rows: DataFrame, code: Column, system: Column, concepts: DataFrame) -> DataFrame:
    """The rows with display and found: what the concepts (system, code, display) say of a code. Of several displays the
    smallest counts."""
    known = concepts.groupBy(canonical_system(F.col("system")).alias("__s"), F.trim("code").alias("__c")).agg(F.min("display").alias("display"), F.lit(True).alias("__hit"))
    keyed = rows.withColumn("__cs", canonical_system(system)).withColumn("__cc", F.trim(code))
    joined = keyed.join(known, (F.col("__cs") == F.col("__s")) & (F.col("__cc") == F.col("__c")), "left")
    return joined.withColumn("found", F.col("__hit").isNotNull()).drop("__cs", "__cc", "__s", "__c", "__hit")


def relationships(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, relation, other): parents and children of each code (column code) in a hierarchy (parent, child)."""
    up = codes.join(edges, F.col("code") == F.col("child")).select("code", F.lit("parent").alias("relation"), F.col("parent").alias("other"))
    down = codes.join(edges, F.col("code") == F.col("parent")).select("code", F.lit("child").alias("relation"), F.col("child").alias("other"))
    return up.unionByName(down).distinct()


def expand(value_sets: DataFrame, concepts: DataFrame, name: str, text: str | None = None, offset: int = 0, count: int | None = None) -> DataFrame:
    """(system, code, display) of a value set, with the concepts' displays, those whose code or display holds `text`;
    `offset` and `count` give one page in the order of systems and codes."""
    codes = value_sets.where(F.col("valueset") == name).select("system", "code").distinct()
    known = concepts.groupBy(canonical_system(F.col("system")).alias("__s"), F.trim("code").alias("__c")).agg(F.min("display").alias("display"))
    out = codes.join(known, (canonical_system(codes["system"]) == F.col("__s")) & (F.trim(codes["code"]) == F.col("__c")), "left").select("system", "code", "display")
    if text:
        out = out.where(F.contains(F.lower("code"), F.lit(text.lower())) | F.contains(F.lower("display"), F.lit(text.lower())))
    if offset or count is not None:
        out = out.orderBy("system", "code").offset(offset)
    return out if count is None else out.limit(count)


def validation_details(rows: DataFrame, code: Column, system: Column, display: Column, concepts: DataFrame) -> DataFrame:
    """The rows with is_valid, expected_display and a message: valid, unknown code, unknown system, or another display."""
    systems = concepts.select(canonical_system(F.col("system")).alias("__sys"), F.lit(True).alias("__known")).distinct()
    looked = lookup_codes(rows.withColumn("__given", display), code, system, concepts).withColumnRenamed("display", "expected_display")
    judged = looked.withColumn("__cs", canonical_system(system)).join(F.broadcast(systems), F.col("__cs") == F.col("__sys"), "left")
    other = F.col("__given").isNotNull() & (F.lower(F.trim("__given")) != F.lower("expected_display"))
    message = F.when(F.col("__known").isNull(), "unknown system").when(~F.col("found"), "unknown code").when(other, "another display").otherwise("valid")
    return judged.withColumn("message", message).withColumn("is_valid", F.col("found")).drop("__given", "__cs", "__sys", "__known", "found")


class ValueSetCache:
    """Expansions kept as tables under a folder, valid for `days`; a lookup beyond that, or of a new name, asks `load`.

    load: name -> frame (valueset, system, code). The time of an expansion is in its rows, so any session sees it.
    """

    def __init__(self, spark: SparkSession, folder: str, load, days: float = 7.0):
        self.spark, self.folder, self.load, self.days, self.loads = spark, folder.rstrip("/"), load, days, 0

    def get(self, name: str, now: str | None = None) -> DataFrame:
        """now: the time that counts as the present, for tests."""
        import hashlib

        path = f"{self.folder}/valueset-{hashlib.sha256(name.encode()).hexdigest()[:32]}"
        at = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            kept = self.spark.read.parquet(path)
            fresh = kept.where(F.timestamp_diff("SECOND", F.col("cached_at"), at) < int(self.days * 86_400))
            if not fresh.isEmpty():
                return kept.select("valueset", "system", "code")
        self.loads += 1
        self.load(name).select("valueset", "system", "code").withColumn("cached_at", at).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).select("valueset", "system", "code")
