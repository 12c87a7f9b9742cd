"""Queries over token ids and packed containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from . import encode, packing


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.ids(_docs(spark, sf_dir))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text decoded from its ids: characters and digest, which SQL takes from the text itself."""
    back = encode.texts(encode.ids(_docs(spark, sf_dir)))
    return back.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token spans of every text: they tile its bytes, and cover all its characters."""
    out = encode.spans(_docs(spark, sf_dir))
    last = F.try_element_at("tokens", F.lit(-1))
    tiled = F.aggregate("tokens", F.lit(0), lambda at, t: F.when(t.byte_start == at, t.byte_end).otherwise(F.lit(-1)))
    return out.select("doc_id", F.coalesce(last.char_end, F.lit(0)).cast("bigint").alias("chars"), tiled.cast("bigint").alias("bytes"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and characters per source and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    n = encode.token_counts(_docs(spark, sf_dir))
    return docs.join(n, "doc_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "containers")
    return packing.fill_report(packing.pack_texts(table(spark, sf_dir, "documents"), kinds), kinds)


QUERIES = {f.__name__: f for f in (p8_ids, p8_roundtrip, p8_spans, p8_rates, p9_packing, p9_fill)}

ORACLES = {
    "p8_roundtrip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS chars, md5(coalesce(text, '')) AS digest FROM documents",
    "p8_spans": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS chars, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents",
}
