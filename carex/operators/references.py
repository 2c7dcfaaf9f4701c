"""References to records that do not exist (problem 2).

Skew-aware split: references are pre-aggregated per key and period, the heaviest keys are checked against a
broadcast of at most `heavy_keys` rows, all other keys go through a shuffled anti-join, and both parts are united.

Null and edge cases: a null reference is no reference. Blanks around it, the type, the version and the address of
the own store do not matter; an empty id or the id of a foreign server names no record and is an orphan. A target
row without received_at counts as there from the beginning; a target delivered again counts from its first row and
is gone from its earliest deleted_at. A referring row without received_at is an orphan only if no target row exists
at all, and its period is null. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carex.plans.physical import heaviest

OWN_STORE = "https://fhir.example.org/r4/"
FAR_PAST = "0001-01-01 00:00:00"


def reference_key(ref: Column, own_store: str = OWN_STORE) -> Column:
    """The id that a reference text names; a foreign address stays whole, so that it matches no id."""
    text = F.trim(F.regexp_replace(ref, r"^\s+|\s+$", ""))
    text = F.when(text.startswith(own_store), F.substring(text, len(own_store) + 1, 1_000_000)).otherwise(text)
    text = F.regexp_replace(text, r"/_history(/[^/]*)?$", "")
    return F.when(text.rlike(r"^[A-Za-z]+/[^/]*$"), F.element_at(F.split(text, "/"), 2)).otherwise(text)


def reference_rows(df: DataFrame, table_name: str, fields: dict[str, str], own_store: str = OWN_STORE) -> DataFrame:
    """One narrow row for each non-null reference of a table. fields: reference column -> kind of its target."""
    refs = F.array(
        *[
            F.struct(F.lit(name).alias("field_name"), F.lit(kind).alias("kind"), F.col(name).alias("ref"))
            for name, kind in fields.items()
        ]
    )
    rows = df.select("row_no", "received_at", F.explode(refs).alias("r")).where("r.ref is not null")
    return rows.select(
        F.lit(table_name).alias("table_name"),
        "row_no",
        "r.field_name",
        "r.kind",
        reference_key(F.col("r.ref"), own_store).alias("key"),
        "received_at",
        F.date_format("received_at", "yyyy-MM").alias("period"),
    )


def target_windows(targets: dict[str, DataFrame]) -> DataFrame:
    """For each kind and id the time from which, and until which, the record is there."""
    parts = [
        t.where("id is not null").select(
            F.lit(kind).alias("kind"), F.col("id").alias("key"), "received_at", "deleted_at"
        )
        for kind, t in targets.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("kind", "key").agg(
        F.min(F.coalesce("received_at", F.lit(FAR_PAST).cast("timestamp_ntz"))).alias("there_from"),
        F.min("deleted_at").alias("gone_at"),
    )


def pre_aggregate(refs: DataFrame) -> DataFrame:
    """References per key, place and period, with the first and the last time at which they were made."""
    return refs.groupBy("kind", "key", "table_name", "field_name", "period").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("received_at").alias("first_at"),
        F.max("received_at").alias("last_at"),
    )


def _there(at: str) -> Column:
    """Whether the record was there at a time; a row without a time counts as made while it was there."""
    return F.col(at).isNull() | (
        (F.col("there_from") <= F.col(at)) & (F.col("gone_at").isNull() | (F.col("gone_at") > F.col(at)))
    )


def _heavy(refs: DataFrame, windows: DataFrame, heavy_keys: int) -> DataFrame:
    totals = pre_aggregate(refs).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    heavy = heaviest(totals, ["kind", "key"], "n", heavy_keys).select("kind", "key")
    known = windows.join(F.broadcast(heavy), ["kind", "key"], "left_semi")
    return heavy.join(F.broadcast(known), ["kind", "key"], "left")


def orphan_rows(refs: DataFrame, targets: dict[str, DataFrame], heavy_keys: int = 256) -> DataFrame:
    """Every reference whose target was not there when its row arrived: table_name, row_no, field_name, period."""
    windows = target_windows(targets)
    heavy = F.broadcast(_heavy(refs, windows, heavy_keys).withColumn("is_heavy", F.lit(True)))
    split = refs.join(heavy, ["kind", "key"], "left")
    of_heavy = split.where(F.col("is_heavy") & (F.col("there_from").isNull() | ~_there("received_at")))
    light = split.where("is_heavy is null").drop("there_from", "gone_at", "is_heavy")
    of_light = light.alias("r").join(
        windows.alias("w"),
        (F.col("r.kind") == F.col("w.kind")) & (F.col("r.key") == F.col("w.key")) & _there("received_at"),
        "left_anti",
    )
    out = ["table_name", "row_no", "field_name", "period"]
    return of_heavy.select(out).unionByName(of_light.select(out))


def orphan_report(refs: DataFrame, targets: dict[str, DataFrame], heavy_keys: int = 256) -> DataFrame:
    """References and orphans per table, field and period.

    Groups of a key and a period that lie wholly on one side of its window are decided as groups; only the rows of
    groups that the window cuts are looked at one by one.
    """
    windows = target_windows(targets)
    groups = pre_aggregate(refs)
    heavy = F.broadcast(_heavy(refs, windows, heavy_keys).withColumn("is_heavy", F.lit(True)))
    split = groups.join(heavy, ["kind", "key"], "left")
    of_heavy = split.where("is_heavy").drop("is_heavy")
    of_light = (
        split.where("is_heavy is null").drop("there_from", "gone_at", "is_heavy").join(windows, ["kind", "key"], "left")
    )
    judged = of_heavy.unionByName(of_light).select(
        "*",
        F.when(F.col("there_from").isNull(), "all")
        .when(F.col("first_at").isNull(), "none")
        .when((F.col("last_at") < F.col("there_from")) | (F.col("first_at") >= F.col("gone_at")), "all")
        .when(_there("first_at") & _there("last_at"), "none")
        .otherwise("cut")
        .alias("verdict"),
    )
    place = ["table_name", "field_name", "period"]
    whole = judged.select(*place, "n", F.when(F.col("verdict") == "all", F.col("n")).otherwise(0).alias("orphans"))
    cut = judged.where("verdict = 'cut'").select("kind", "key", "there_from", "gone_at", *place)
    rows = refs.join(cut, ["kind", "key", "table_name", "field_name", "period"])
    rest = rows.where(~_there("received_at")).select(
        *place, F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("orphans")
    )
    return (
        whole.unionByName(rest)
        .groupBy(*place)
        .agg(F.sum("n").alias("n_refs"), F.sum("orphans").alias("n_orphans"))
    )


def resolve(rows: DataFrame, ref: Column, targets: DataFrame, key: str = "id") -> DataFrame:
    """The rows with `resolved`, the record that a reference names; null where there is none. One record of an id
    is taken, the greatest by content; AQE splits keys that many rows refer to."""
    whole = F.struct(*[F.col(f"`{c}`") for c in targets.columns])
    once = targets.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(whole).alias("resolved"))
    return rows.withColumn("__ref", reference_key(ref)).join(once, F.col("__ref") == F.col("__key"), "left").drop("__ref", "__key")

