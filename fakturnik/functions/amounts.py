"""Amounts in Polish notation and VAT rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .matching import capture, find_all, first, group, let, stripped, typed

MONEY = "decimal(20,2)"
WIDE = "decimal(38,10)"


def _money(h: Column, whole: int = 1, cents: int = 2) -> Column:
    return F.concat(F.translate(group(h, whole), "  ", ""), F.lit("."), group(h, cents)).try_cast(MONEY)


def amounts(text: Column) -> Column:
    """All amounts; one that is grouped by other white space than blanks is no amount."""
    return typed(find_all(text, P.AMOUNT, 2), _money, 0.8)


def first_amount(text: Column) -> Column:
    return first(amounts(text))


def priced(text: Column) -> Column:
    """All amounts with a currency behind them: value and the sign or code of the currency."""
    made = F.transform(find_all(text, P.AMOUNT_WITH_CURRENCY, 3), lambda h: F.struct(_money(h).alias("value"), group(h, 3).alias("currency"), h.start.alias("start"), h.end.alias("end")))
    return F.filter(made, lambda m: m.value.isNotNull())


def parse_amount(text: Column) -> Column:
    """An amount in Polish or English notation: the later of comma and dot is the decimal sign."""
    return let(F.regexp_replace(text, r"[^0-9,.]", ""), _plain_amount)


def _plain_amount(s: Column) -> Column:
    comma, dot = F.length(s) - F.locate(",", F.reverse(s)), F.length(s) - F.locate(".", F.reverse(s))
    has_comma, has_dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    plain = (
        F.when(has_comma & ~has_dot, F.replace(s, F.lit(","), F.lit(".")))
        .when(has_comma & has_dot & (comma > dot), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(has_comma & has_dot, F.replace(s, F.lit(","), F.lit("")))
        .otherwise(s)
    )
    return let(plain, lambda v: F.when(v.rlike(r"^\d+(\.\d+)?$|^\d+\.$|^\.\d+$"), v.try_cast(MONEY)))


def format_amount(value: Column) -> Column:
    """Two decimals, a comma, and blanks between thousands; the sign counts as a sign of the number when grouping."""
    text = F.format_number(F.abs(value), 2)
    grouped = F.translate(text, ",.", " ,")
    whole = F.length(F.split_part(F.regexp_replace(text, ",", ""), F.lit("."), F.lit(1)))
    return F.when(value < 0, F.concat(F.when(whole % 3 == 0, F.lit("- ")).otherwise(F.lit("-")), grouped)).otherwise(grouped)


def labelled_totals(text: Column) -> Column:
    """struct<gross, net, vat> of the amounts behind their labels."""
    return F.struct(*[parse_amount(capture(text, p)).alias(n) for n, p in (("gross", P.TOTAL_GROSS), ("net", P.TOTAL_NET), ("vat", P.TOTAL_VAT))])


def totals(found: Column, all_amounts: Column) -> dict[str, Column]:
    """Totals from ``labelled_totals``: the missing one from the others, at last gross as the largest amount."""
    gross, net, vat = found.gross, found.net, found.vat
    vat = F.coalesce(vat, (gross - net).cast(MONEY))
    net = F.coalesce(net, (gross - vat).cast(MONEY))
    largest = F.array_max(F.transform(all_amounts, lambda m: m.value))
    return {"total_net": net, "total_vat": vat, "total_gross": F.coalesce(gross, largest)}


def rate_of(text: Column) -> Column:
    """Code of a VAT rate: 23, 8, 5, 0, zw, np, oo, else another number up to 255; null for anything else."""
    return let(F.regexp_replace(F.lower(stripped(text)), "%+$", ""), _rate_code)


def _rate_code(s: Column) -> Column:
    return (
        F.when(s.isin("23", "8", "5", "0"), s)
        .when(s.isin("zw", "zw.", "zwolniony", "zwolnione"), F.lit("zw"))
        .when(s.isin("np", "np.", "nie podlega"), F.lit("np"))
        .when(s.isin("oo", "odwrotne obciążenie"), F.lit("oo"))
        .when(s.rlike(r"^\+?\d+$") & (s.try_cast("int") <= 255), s.try_cast("int").cast("string"))
    )


def rate_share(code: Column) -> Column:
    """The rate as a multiplier; exempt and unknown rates are 0."""
    return F.coalesce(code.try_cast("decimal(5,2)") / 100, F.lit(0)).cast("decimal(5,2)")


def rate_text(code: Column) -> Column:
    return F.when(code.rlike(r"^\d+$"), F.concat(code, F.lit("%"))).when(code.isin("zw", "np"), F.concat(code, F.lit("."))).otherwise(code)


def rates(text: Column) -> Column:
    """Distinct VAT rates in the order in which they appear."""
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(P.VAT_RATE), F.lit(1)), rate_of)))


def breakdown(text: Column) -> Column:
    """Rows of the VAT table: rate, net, vat, gross = net + vat."""
    hits = find_all(text, P.VAT_BREAKDOWN, 3)
    zero = F.lit(0).cast(MONEY)

    def row(h: Column) -> Column:
        net, vat = F.coalesce(parse_amount(group(h, 2)), zero), F.coalesce(parse_amount(group(h, 3)), zero)
        return F.struct(rate_of(group(h, 1)).alias("rate"), net.alias("net"), vat.alias("vat"), (net + vat).cast(MONEY).alias("gross"))

    return F.filter(F.transform(hits, row), lambda r: r.rate.isNotNull())


def vat_of(net: Column, code: Column) -> Column:
    return net * rate_share(code)


def gross_of(net: Column, vat: Column) -> Column:
    return net + vat


def net_of_gross(gross: Column, code: Column) -> Column:
    return gross.cast(WIDE) / (1 + rate_share(code))
