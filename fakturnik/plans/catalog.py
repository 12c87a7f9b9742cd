"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extraction, pages, quality, singles, sql, sql_invoice, sql_loads

_MODULES = [quality, extraction, pages, singles]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.invoice_records(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in [*_MODULES, sql, sql_invoice, sql_loads] for k, v in m.ORACLES.items()}
