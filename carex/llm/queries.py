"""Queries of the problems on texts and learned matching, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carex.llm import addresses, mixing, names, residue, tokens
from carex.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.person_pairs(table(spark, sf, "patient"), table(spark, sf, "source_site"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return addresses.place_pairs(table(spark, sf, "patient"))


def p6_writings(spark: SparkSession, sf: str) -> DataFrame:
    return addresses.place_writings(table(spark, sf, "patient"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf, "documents"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mixture_target"))


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf, "documents"), table(spark, sf, "mixture_target"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_documents(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p6_found, p6_writings, p8_ids, p9_mixture, p9_report, p10_found)}

ORACLES: dict[str, str] = {}
