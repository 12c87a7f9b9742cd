"""Queries over linked names and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import addresses, names


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(table(spark, sf_dir, "parties"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.classes(table(spark, sf_dir, "parties"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.found(table(spark, sf_dir, "addresses"), table(spark, sf_dir, "postal_codes"))


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.places(table(spark, sf_dir, "addresses"), table(spark, sf_dir, "postal_codes"))


QUERIES = {f.__name__: f for f in (p6_found, p6_classes, p7_found, p7_places)}
ORACLES: dict[str, str] = {}
