"""The invoice parser over streams of texts: the same plan as for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.invoice import parse


def text_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, received_at timestamp") -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)


def daily_totals(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Invoices and gross total per day of arrival; days close when the watermark passes them."""
    parsed = parse(stream).filter("invoice.header.invoice_number <> 'UNKNOWN'")
    return (
        parsed.withWatermark("received_at", late)
        .groupBy(F.window("received_at", "1 day"))
        .agg(F.count(F.lit(1)).alias("invoices"), F.sum("invoice.summary.total_gross").alias("total_gross"))
        .select(F.col("window.start").alias("day"), "invoices", "total_gross")
    )


def drain(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All that is there, parsed and appended to a Parquet folder exactly once; returns when it is done."""
    out = parse(stream).select("doc_id", "invoice", "warnings")
    query = out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
