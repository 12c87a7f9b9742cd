"""The whole invoice: text in, nested record out, by stacked projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import amounts as A
from . import items as I
from . import parties as Q
from .dates import labelled
from .identifiers import nips

PARTY = (
    "struct<name:string,nip:string,regon:string,address:struct<street:string,postal_code:string,city:string,country:string,raw:string>,"
    "bank_account:string,bank_name:string,email:string,phone:string,website:string>"
)


@dataclass(frozen=True)
class ParseOptions:
    """Options of the parser.

    ``validate_nip`` and ``source_type`` change the result. The other three are kept for callers that set
    them and have no effect: REGON and IBAN are always checked, and no invoice is dropped for its confidence.
    """

    validate_nip: bool = True
    validate_regon: bool = True
    validate_iban: bool = True
    min_confidence: float = 0.0
    source_type: str = "unknown"


def parse(df: DataFrame, text: str = "text", options: ParseOptions = ParseOptions()) -> DataFrame:
    """The frame with columns ``invoice`` and ``warnings``; null text counts as empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    seller, buyer = Q.sections(F.col("_t"))
    days = labelled(F.col("_t"))
    base = df.withColumn("_t", t).withColumns(
        {"_seller": seller, "_buyer": buyer, "_amounts": A.amounts(F.col("_t")), "_table": I.table_items(F.col("_t")), "_number": Q.invoice_number(F.col("_t")), "_labelled": A.labelled_totals(F.col("_t")), "_nips": nips(F.col("_t"), options.validate_nip), **{f"_{k}": v for k, v in days.items()}}
    )
    totals = A.totals(F.col("_labelled"), F.col("_amounts"))
    base = base.withColumns({f"_{k}": v for k, v in totals.items()})
    issuer, receiver = Q.parties(F.col("_t"), F.col("_seller"), F.col("_buyer"), F.col("_nips"), options.validate_nip)
    single = I.single_item(F.col("_t"), F.col("_total_net"), F.col("_total_gross"), F.size("_amounts"))
    base = base.withColumns({"_issuer": issuer.cast(PARTY), "_receiver": receiver.cast(PARTY), "_items": F.when(F.size("_table") > 0, F.col("_table")).otherwise(single)})
    zero = F.lit(0).cast(A.MONEY)
    over = lambda f: F.aggregate("_items", zero, lambda a, i: (a + i[f]).cast(A.MONEY))
    base = base.withColumns({"_net": F.coalesce("_total_net", over("total_net")), "_gross": F.coalesce("_total_gross", over("total_gross")), "_sum_net": over("total_net"), "_sum_gross": over("total_gross")})
    base = base.withColumn("_vat", F.coalesce("_total_vat", (F.col("_gross") - F.col("_net")).cast(A.MONEY)))
    missing = F.array_compact(
        F.array(
            F.when(F.col("_number").isNull(), F.lit("Could not extract invoice number")),
            F.when(F.col("_issue_date").isNull(), F.lit("Could not extract issue date")),
            F.when(F.col("_issuer.nip").isNull(), F.lit("Could not extract issuer NIP")),
            F.when(F.size("_items") == 0, F.lit("Could not extract line items")),
        )
    )
    one = lambda cond, by: F.when(cond, F.lit(by).cast("float")).otherwise(F.lit(0.0).cast("float"))
    confidence = F.greatest(
        F.lit(0.0).cast("float"),
        F.lit(1.0).cast("float") - one(F.col("_number").isNull(), 0.2) - one(F.col("_issuer.nip").isNull(), 0.2) - one(F.size("_items") == 0, 0.3) - one(F.col("_gross") == 0, 0.2),
    )
    null = F.lit(None).cast("string")
    invoice = F.struct(
        F.struct(
            F.coalesce("_number", F.lit("UNKNOWN")).alias("invoice_number"), F.coalesce("_issue_date", F.lit("1970-01-01").cast("date")).alias("issue_date"), F.col("_sale_date").alias("sale_date"),
            F.col("_due_date").alias("due_date"), F.lit("standard").alias("invoice_type"), F.lit("PLN").alias("currency"), null.alias("correction_of"),
        ).alias("header"),
        F.col("_issuer").alias("issuer"),
        F.col("_receiver").alias("receiver"),
        F.col("_items").alias("line_items"),
        F.struct(
            F.col("_net").alias("total_net"), F.col("_vat").alias("total_vat"), F.col("_gross").alias("total_gross"), A.breakdown(F.col("_t")).alias("vat_breakdown"), Q.payment_method(F.col("_t")).alias("payment_method"),
            F.lit(None).cast(A.MONEY).alias("amount_paid"), F.col("_total_gross").alias("amount_due"), null.alias("amount_in_words"),
        ).alias("summary"),
        F.struct(confidence.alias("confidence"), F.lit(options.source_type).alias("source_type"), null.alias("ocr_engine"), missing.alias("warnings")).alias("metadata"),
    )
    out = base.withColumn("invoice", invoice)
    out = out.withColumn("warnings", F.concat(F.col("invoice.metadata.warnings"), issues(F.col("invoice"), F.col("_sum_net"), F.col("_sum_gross"))))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])


def text_only(df: DataFrame, text: str = "text", options: ParseOptions = ParseOptions()) -> DataFrame:
    """The frame with the invoice alone, without the parser's notes."""
    return parse(df, text, options).drop("warnings")


def with_metadata(df: DataFrame, text: str = "text", options: ParseOptions = ParseOptions()) -> DataFrame:
    """The frame with one struct ``result``: invoice, raw_text and warnings."""
    out = parse(df, text, options)
    return out.withColumn("result", F.struct("invoice", F.coalesce(F.col(text), F.lit("")).alias("raw_text"), "warnings")).drop("invoice", "warnings")


def parse_with_layout(pages: DataFrame, table_text: str = "table_text", text: str = "text", has_layout: str = "has_layout", engine: str = "onnx", options: ParseOptions = ParseOptions()) -> DataFrame:
    """``parse`` for recognised pages: items of the text of table regions stand for those of the page where there are any.

    ``table_text`` holds the lines of the page's table regions (``layout.line_texts``), null without a table.
    """
    out = parse(pages, text, options)
    found = I.table_items(F.coalesce(F.col(table_text), F.lit("")))
    items = F.when(F.size(found) > 0, found).otherwise(F.col("invoice.line_items"))
    source = F.when(F.col(has_layout), F.lit("scanned_with_layout")).otherwise(F.col("invoice.metadata.source_type"))
    meta = F.col("invoice.metadata").withField("source_type", source).withField("ocr_engine", F.lit(engine))
    return out.withColumn("invoice", F.col("invoice").withField("line_items", items).withField("metadata", meta))


def issues(invoice: Column, sum_net: Column | None = None, sum_gross: Column | None = None) -> Column:
    """What is missing or does not add up in an invoice, in fixed order."""
    zero = F.lit(0).cast(A.MONEY)
    over = lambda f: F.aggregate(invoice.line_items, zero, lambda a, i: (a + i[f]).cast(A.MONEY))
    net, gross = sum_net if sum_net is not None else over("total_net"), sum_gross if sum_gross is not None else over("total_gross")
    cent = F.lit("0.01").cast(A.MONEY)
    off = lambda what, mine, theirs: F.when(F.abs(mine - theirs) > cent, F.concat(F.lit(f"Line item {what} total ("), mine.cast("string"), F.lit(") differs from summary ("), theirs.cast("string"), F.lit(")")))
    return F.array_compact(
        F.array(
            F.when(invoice.header.invoice_number == "", F.lit("Missing invoice number")),
            F.when(invoice.issuer["name"] == "", F.lit("Missing issuer name")),
            F.when(invoice.issuer.nip.isNull(), F.lit("Missing issuer NIP")),
            F.when((invoice.receiver["name"] == "") & invoice.receiver.nip.isNull(), F.lit("Missing receiver information")),
            F.when(F.size(invoice.line_items) == 0, F.lit("No line items")),
            F.when(invoice.summary.total_gross == 0, F.lit("Total gross is zero")),
            off("net", net, invoice.summary.total_net),
            off("gross", gross, invoice.summary.total_gross),
        )
    )
