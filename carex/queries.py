"""Queries of the general problems over a data folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carex.operators import incremental, nested, references, timestamps, units
from carex.queries_sql import ORACLES  # noqa: F401
from carex.session import table


def _references(spark: SparkSession, sf: str):
    refs = references.reference_rows(
        table(spark, sf, "observation"), "observation", {"subject.reference": "patient"}
    )
    refs = refs.unionByName(
        references.reference_rows(
            table(spark, sf, "claim_response"),
            "claim_response",
            {"patient.reference": "patient", "insurer.reference": "organization"},
        )
    )
    targets = {k: table(spark, sf, k).select("id", "received_at", "deleted_at") for k in ("patient", "organization")}
    return refs, targets


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_rows(*_references(spark, sf))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_report(*_references(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = timestamps.timestamp_rows(
        table(spark, sf, "observation"), "observation", "row_no", {"effectiveDateTime": False, "effectiveInstant": False}
    )
    rows = rows.unionByName(
        timestamps.timestamp_rows(table(spark, sf, "claim_response"), "claim_response", "row_no", {"created": False})
    )
    rows = rows.unionByName(
        timestamps.timestamp_rows(table(spark, sf, "patient"), "patient", "id", {"birthDate": True}, unique=False)
    )
    return timestamps.normal_forms(rows, table(spark, sf, "source_site"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.replay_runs(table(spark, sf, "fhir_resources"), table(spark, sf, "pipeline_run"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.list_elements(table(spark, sf, "fhir_resources"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.common_quantities(
        table(spark, sf, "observation"), table(spark, sf, "unit_target"), table(spark, sf, "unit_conversion")
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p4_found, p5_found, p7_found)}
