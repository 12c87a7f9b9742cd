"""Line items of an invoice text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .amounts import MONEY, WIDE, amounts, rate_of
from .matching import capture, let, lines, stripped

ITEM = (
    "struct<ordinal:int,description:string,code:string,quantity:decimal(38,10),unit:string,unit_price_net:decimal(38,10),unit_price_gross:decimal(38,10),"
    "vat_rate:string,total_net:decimal(20,2),vat_amount:decimal(20,2),total_gross:decimal(20,2),discount_percent:decimal(38,10)>"
)


def table_lines(text: Column) -> Column:
    """The filled lines of the item table: behind each header line, up to the first summary line inside it."""
    return let(F.transform(lines(text), stripped), _inside)


def _inside(all_lines: Column) -> Column:
    header = lambda t: F.contains(t, F.lit("Lp")) & (F.contains(t, F.lit("Nazwa")) | F.contains(t, F.lit("Opis")))
    n = F.size(all_lines)

    def upto(body: Column) -> Column:
        ends = F.array_position(F.transform(body, lambda t: t.startswith("Razem") | t.startswith("SUMA")), True)
        return let(ends, lambda e: F.when(e > 0, F.slice(body, 1, (e - 1).cast("int"))).otherwise(body))

    def behind(start: Column) -> Column:
        body = F.slice(all_lines, (start + 1).cast("int"), F.greatest(n - start, F.lit(0)).cast("int"))
        return F.when(start > 0, F.filter(let(body, upto), lambda t: (t != "") & ~header(t))).otherwise(F.array().cast("array<string>"))

    return let(F.array_position(F.transform(all_lines, header), True), behind)


def parse_line(line: Column) -> Column:
    """One line as an item, null if it is none. Cells stand between bars or tabs.

    Of three and more amounts the last are net, VAT and gross; two are net and gross; one is both. The
    longest cell in bytes that is not a bare number describes the item (the last of equals); the first
    whole number below 10,000 in a cell of its own is the quantity; the first rate in the line counts.
    """
    cells = F.split(line, r"[|\t]")
    found = F.transform(amounts(line), lambda m: m.value)
    return let(F.struct(cells.alias("cells"), found.alias("found")), lambda x: _item(line, x.cells, x.found))


def _item(line: Column, cells: Column, found: Column) -> Column:
    words = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""))
    n = F.size(found)
    shaped = (F.size(cells) >= 3) | (words >= 4)
    text_cells = F.filter(cells, lambda c: (stripped(c) != "") & ~c.rlike(r"^[0-9.,]*$"))
    longest = F.aggregate(text_cells, F.lit(None).cast("string"), lambda a, c: F.when(a.isNull() | (F.octet_length(c) >= F.octet_length(a)), c).otherwise(a))
    last = lambda k: F.get(found, n - k)
    zero = F.lit(0).cast(MONEY)
    net = F.when(n == 1, last(1)).when(n == 2, last(2)).otherwise(last(3))
    gross = last(1)
    vat = F.when(n == 1, zero).when(n == 2, gross - net).otherwise(last(2)).cast(MONEY)
    whole = lambda c: F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
    counts = F.filter(F.transform(cells, lambda c: whole(stripped(c))), lambda q: q.between(1, 9999))
    quantity = F.coalesce(F.get(counts, F.lit(0)), F.lit(1)).cast(WIDE)
    # Divisors are small whole numbers; the scale of the quotient is fixed at ten places.
    price = lambda total: (total / quantity.cast("decimal(10,0)")).cast(WIDE)
    item = F.struct(
        F.get(F.transform(cells, lambda c: whole(stripped(c)).cast("int")), F.lit(0)).alias("ordinal"),
        F.coalesce(stripped(longest), F.lit("Item")).alias("description"),
        F.lit(None).cast("string").alias("code"),
        quantity.alias("quantity"),
        F.lit("szt.").alias("unit"),
        price(net).alias("unit_price_net"),
        price(gross).alias("unit_price_gross"),
        F.coalesce(rate_of(capture(line, P.VAT_RATE)), F.lit("23")).alias("vat_rate"),
        net.alias("total_net"),
        vat.alias("vat_amount"),
        gross.alias("total_gross"),
        F.lit(None).cast(WIDE).alias("discount_percent"),
    )
    return F.when(shaped & (n > 0), item).cast(ITEM)


def table_items(text: Column) -> Column:
    return F.filter(F.transform(table_lines(text), parse_line), lambda i: i.isNotNull())


def single_item(text: Column, total_net: Column, total_gross: Column, count: Column) -> Column:
    """The one item of a text without a table: its first plain line with the totals."""
    plain = F.filter(lines(text), lambda t: (stripped(t) != "") & ~t.rlike(P.AMOUNT) & ~F.contains(t, F.lit("Faktura")) & ~F.contains(t, F.lit("NIP")))
    gross = F.coalesce(total_gross, F.lit(0).cast(MONEY))
    net = F.coalesce(total_net, gross)
    item = F.struct(
        F.lit(1).alias("ordinal"), stripped(F.get(plain, F.lit(0))).alias("description"), F.lit(None).cast("string").alias("code"), F.lit(1).cast(WIDE).alias("quantity"), F.lit("szt.").alias("unit"),
        net.cast(WIDE).alias("unit_price_net"), gross.cast(WIDE).alias("unit_price_gross"), F.lit("23").alias("vat_rate"), net.alias("total_net"), (gross - net).cast(MONEY).alias("vat_amount"),
        gross.alias("total_gross"), F.lit(None).cast(WIDE).alias("discount_percent"),
    ).cast(ITEM)
    return F.when((count > 0) & (F.size(plain) > 0), F.array(item)).otherwise(F.array().cast(f"array<{ITEM}>"))
