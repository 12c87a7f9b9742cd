"""Invoices as JSON, CSV and text; batch summaries and counters."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parties import address_text


def json_text(invoice: Column) -> Column:
    """Compact JSON without null fields."""
    return F.to_json(invoice)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def csv_columns(invoice: Column, dates: bool = False) -> list[Column]:
    """The ten flat columns of one invoice, or twelve with sale and due date."""
    h, s = invoice.header, invoice.summary
    more = [_text(h.sale_date).alias("sale_date"), _text(h.due_date).alias("due_date")] if dates else []
    return [
        h.invoice_number.alias("invoice_number"), _text(h.issue_date).alias("issue_date"), *more, invoice.issuer["name"].alias("issuer_name"), _text(invoice.issuer.nip).alias("issuer_nip"),
        invoice.receiver["name"].alias("receiver_name"), _text(invoice.receiver.nip).alias("receiver_nip"), _text(s.total_net).alias("total_net"), _text(s.total_vat).alias("total_vat"),
        _text(s.total_gross).alias("total_gross"), h.currency.alias("currency"),
    ]


def plain_text(invoice: Column) -> Column:
    """A summary for people; the lines for NIP and due date stand only where known."""
    h, i, r, s = invoice.header, invoice.issuer, invoice.receiver, invoice.summary
    money = lambda label, v: F.concat(F.lit(f"  {label}"), v.cast("string"), F.lit(" "), h.currency, F.lit("\n"))
    nip = lambda p: F.coalesce(F.concat(F.lit("  NIP: "), p.nip, F.lit("\n")), F.lit(""))
    return F.concat(
        F.lit("Invoice: "), h.invoice_number, F.lit("\nDate: "), h.issue_date.cast("string"), F.lit("\n\nIssuer:\n  "), i["name"], F.lit("\n"), nip(i), F.lit("  "), address_text(i.address), F.lit("\n\nReceiver:\n  "),
        r["name"], F.lit("\n"), nip(r), F.lit("\nSummary:\n"), money("Net:   ", s.total_net), money("VAT:   ", s.total_vat), money("Gross: ", s.total_gross),
        F.coalesce(F.concat(F.lit("\nPayment due: "), h.due_date.cast("string"), F.lit("\n")), F.lit("")),
    )


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def summary(results: DataFrame) -> DataFrame:
    """Eleven columns per file from (path, invoice, error, processing_time_ms); failed files keep blanks."""
    ok = F.col("error").isNull() & F.col("invoice").isNotNull()
    inv = F.col("invoice")
    blank = lambda c: F.when(ok, _text(c)).otherwise(F.lit(""))
    return results.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.when(ok, "success").otherwise("error").alias("status"), blank(inv.header.invoice_number).alias("invoice_number"), blank(inv.header.issue_date).alias("issue_date"),
        blank(inv.issuer["name"]).alias("issuer_name"), blank(inv.issuer.nip).alias("issuer_nip"), blank(inv.summary.total_gross).alias("total_gross"), blank(inv.header.currency).alias("currency"),
        F.when(ok, F.format_string("%.2f", inv.metadata.confidence)).otherwise("").alias("confidence"), _text(F.col("processing_time_ms")).alias("processing_time_ms"), _text(F.col("error")).alias("error"),
    )


def counters(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def human_size(size: Column) -> Column:
    """Decimal units with one decimal, bytes without."""
    unit = lambda n, u: F.format_string(f"%.1f{u}", size / n)
    return F.when(size >= 10**9, unit(10**9, "GB")).when(size >= 10**6, unit(10**6, "MB")).when(size >= 1000, unit(1000, "KB")).otherwise(F.format_string("%dB", size))


def failures(results: DataFrame) -> DataFrame:
    """(filename, error) of the files that failed."""
    return results.filter("error IS NOT NULL").select(F.element_at(F.split("path", "/"), -1).alias("filename"), "error")


#: Names of the twelve columns.
CSV_HEAD = "invoice_number,issue_date,sale_date,due_date,issuer_name,issuer_nip,receiver_name,receiver_nip,total_net,total_vat,total_gross,currency"


def csv_line(invoice: Column) -> Column:
    """The twelve columns as one line, cells with commas, quotes or line ends in quotes."""
    cell = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(F.array(*csv_columns(invoice, dates=True)), cell), ",", "")


def write_each(results: DataFrame, folder: str, kind: str = "json") -> int:
    """One file per input file in ``folder``: its stem with .json, .csv or .txt; gives their number.

    The tasks write their own files through the file system of ``folder``, so no directory is made for a file
    and no row passes the driver. Files of one stem in different folders would meet; the last one stands.
    """
    value = {"json": json_text, "csv": lambda i: F.concat(F.lit(CSV_HEAD + "\n"), csv_line(i), F.lit("\n")), "text": plain_text}[kind](F.col("invoice"))
    ending = {"json": "json", "csv": "csv", "text": "txt"}[kind]
    out = results.filter("error IS NULL").select(file_stem(F.col("path")).alias("stem"), value.alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            for stem, text in zip(pdf["stem"], pdf["value"], strict=True):
                with fs.open_output_stream(f"{base}/{stem}.{ending}") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"files": [len(pdf)]})

    return out.mapInPandas(run, "files bigint").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
