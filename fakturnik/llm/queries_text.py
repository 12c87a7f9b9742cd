"""Queries over garbled, personal, scanned and abusive text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import spread, table
from . import abuse, mojibake, pii, scan_noise


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "pdf_contents"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "pdf_contents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "extract_results"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.records(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "extract_results"))
    return pii.redact(rows, ["doc_id", "number"]).select("doc_id", "number", "text").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.found(*(table(spark, sf_dir, t) for t in ("ocr_results", "text_boxes", "extract_results")))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repaired(*(table(spark, sf_dir, t) for t in ("ocr_results", "text_boxes", "extract_results")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = abuse.scores(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "doc_labels"))
    return out.filter(f"score > {abuse.THRESHOLD}").select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "doc_labels"))


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.source_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_redacted, p3_found, p3_repaired, p10_found, p10_scores, p10_source_rates)}
ORACLES: dict[str, str] = {}
