"""Files in, invoices out: scan, route, recognise where there is no text of its own, parse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.invoice import ParseOptions, parse_with_layout
from .operators import layout, ocr
from .sources import files

PAGE = "origin string, path string, number int, height int, width int, nChannels int, data binary"


def pdf_page_images(contents: DataFrame) -> DataFrame:
    """The pictures of PDF pages in the form of Spark's image source (blue, green, red); those without a decoder are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, number, x in zip(pdf["path"], pdf["number"], pdf["image"], strict=True):
                if x is None or x["format"] not in ("rgb", "gray"):
                    continue
                raw, n = bytes(x["data"]), 3 if x["format"] == "rgb" else 1
                data = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)[:, ::-1].tobytes()
                rows.append((f"{path}#{number}", path, number, x["height"], x["width"], n, data))
            yield pd.DataFrame(rows, columns=["origin", "path", "number", "height", "width", "nChannels", "data"])

    return files.page_images(contents).mapInPandas(run, PAGE)


def table_texts(pages: DataFrame) -> DataFrame:
    """(origin, table_text): the lines of the boxes that lie in the table regions of recognised pages."""
    b = F.col("b")
    boxes = pages.select("origin", F.posexplode("boxes").alias("box_id", "b")).select("origin", "box_id", b.text.alias("text"), *[layout.quad(b.bbox)[c].alias(c) for c in ("x1", "y1")])
    regions = pages.select("origin", F.posexplode(ocr.region_groups(F.col("regions"))["tables"]).alias("region_id", "r")).select("origin", "region_id", "r.x1", "r.y1", "r.x2", "r.y2")
    inside = layout.boxes_in_regions(boxes, regions, ["origin"]).dropDuplicates(["origin", "box_id"])
    return layout.line_texts(inside, ["origin"]).withColumnRenamed("text", "table_text")


def recognized(pages: DataFrame, engine: ocr.Engine) -> DataFrame:
    """(origin, ocr_text, table_text, has_layout, ocr_error) of pictures, one row each."""
    read = ocr.recognize(pages, engine)
    return read.join(table_texts(read), "origin", "left").select(
        "origin", F.col("text").alias("ocr_text"), "table_text", (F.size("regions") > 0).alias("has_layout"), F.col("error").alias("ocr_error")
    )


def texts(spark: SparkSession, pattern: str, config: Config = Config(), engine: ocr.Engine | None = None) -> DataFrame:
    """(path, source_type, text, table_text, has_layout, error): one row per PDF or image file of a glob.

    Embedded text stands where the kind of PDF has it; else the pages are recognised, if there is an engine.
    """
    found = files.scan(spark, pattern)
    pdfs = files.pdf_contents(found.filter("route = 'pdf'"))
    pictures = files.images(spark, pattern).withColumn("path", F.col("origin")) if engine else None
    empty = spark.createDataFrame([], "path string, ocr_text string, table_text string, has_layout boolean, ocr_error string")
    by_pdf = empty
    if engine:
        pages = pdf_page_images(pdfs)
        read = pages.select("origin", "path", "number").join(recognized(pages, engine), "origin")
        whole = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.col(c).alias("t")))), lambda x: x.t), by)
        by_pdf = read.groupBy("path").agg(whole("ocr_text", "\n\n").alias("ocr_text"), F.nullif(whole("table_text", "\n"), F.lit("")).alias("table_text"), F.max("has_layout").alias("has_layout"), F.first("ocr_error", ignorenulls=True).alias("ocr_error"))
    both = pdfs.join(by_pdf, "path", "left")
    own = files.text_source(F.col("pdf_type"), F.col("text"), F.col("ocr_text"), config.pdf.prefer_embedded_text, config.pdf.min_text_length)
    kind = F.when(F.col("pdf_type") == "Text", "text_pdf").when(F.col("pdf_type") == "Hybrid", "hybrid_pdf").otherwise("image_pdf")
    error = F.coalesce("error", "ocr_error", F.when(own.isNull(), F.lit("no text")))
    out = both.select("path", kind.alias("source_type"), own.alias("text"), "table_text", F.coalesce("has_layout", F.lit(False)).alias("has_layout"), error.alias("error"))
    files_of = found.filter("route = 'image'").select("path")
    if engine:
        seen = files_of.join(recognized(pictures, engine).withColumnRenamed("origin", "path"), "path", "left")
    else:
        seen = files_of.join(empty, "path", "left")
    why = F.coalesce("ocr_error", F.when(F.col("ocr_text").isNull(), F.lit("no recognition" if not engine else "not an image")), F.when(F.col("ocr_text") == "", F.lit("no text")))
    return out.unionByName(seen.select("path", F.lit("image").alias("source_type"), F.col("ocr_text").alias("text"), "table_text", F.coalesce("has_layout", F.lit(False)).alias("has_layout"), why.alias("error")))


def process(spark: SparkSession, pattern: str, config: Config = Config(), engine: ocr.Engine | None = None) -> DataFrame:
    """(path, source_type, text, invoice, warnings, error, processing_time_ms) of all files; a failed file has no invoice but its error."""
    rows = texts(spark, pattern, config, engine)
    parsed = parse_with_layout(rows, options=ParseOptions(validate_nip=config.extraction.validate_nip))
    meta = F.col("invoice.metadata")
    kind = F.when(F.col("has_layout"), F.lit("scanned_with_layout")).otherwise(F.col("source_type"))
    engine_of = F.when(F.col("source_type").isin("image", "image_pdf"), meta.ocr_engine)
    header = F.col("invoice.header").withField("currency", F.lit(config.extraction.default_currency))
    invoice = F.col("invoice").withField("metadata", meta.withField("source_type", kind).withField("ocr_engine", engine_of)).withField("header", header)
    return parsed.select("path", "source_type", "text", F.when(F.col("error").isNull(), invoice).alias("invoice"), F.when(F.col("error").isNull(), F.col("warnings")).alias("warnings"), "error", F.lit(None).cast("bigint").alias("processing_time_ms"))
