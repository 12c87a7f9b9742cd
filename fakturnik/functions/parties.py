"""Seller and buyer of an invoice text: sections, names, addresses, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .identifiers import ibans, nips, regons
from .matching import capture, let, lines, stripped


def sections(text: Column) -> tuple[Column, Column]:
    """(seller, buyer): each runs from its label to the other's or to the end; without labels both are the whole text."""
    both = F.struct(F.regexp_instr(text, F.lit(P.SELLER)).alias("s"), F.regexp_instr(text, F.lit(P.BUYER)).alias("b"))
    return let(both, lambda x: _section(text, x.s, x.b)[0]), let(both, lambda x: _section(text, x.s, x.b)[1])


def _section(text: Column, s: Column, b: Column) -> tuple[Column, Column]:
    cut = lambda a, z: F.substr(text, a, z - a)
    rest = lambda a: F.substr(text, a)
    none = F.lit("")
    seller = F.when((s > 0) & (b > 0) & (s < b), cut(s, b)).when(s > 0, rest(s)).when(b > 0, none).otherwise(text)
    buyer = F.when((s > 0) & (b > 0) & (s < b), rest(b)).when((s > 0) & (b > 0), cut(b, s)).when(s > 0, none).when(b > 0, rest(b)).otherwise(text)
    return seller, buyer


def _name_like(text: Column) -> Column:
    kept = F.filter(F.transform(lines(text), stripped), lambda t: t != "")
    return F.filter(kept, lambda t: ~t.rlike(P.SELLER) & ~t.rlike(P.BUYER) & ~t.startswith("NIP") & ~t.startswith("REGON"))


def party_name(text: Column) -> Column:
    """The first filled line that is no label and no number; '' without one."""
    return F.coalesce(F.get(_name_like(text), F.lit(0)), F.lit(""))


def address(text: Column) -> Column:
    """Postal code, the town behind it, the street, or two plain lines where neither town nor street is found."""
    postal = F.nullif(F.regexp_extract(text, P.POSTAL_CODE, 0), F.lit(""))
    at = F.regexp_instr(text, F.lit(P.POSTAL_CODE))
    behind = stripped(F.substr(text, at + 6))
    line = stripped(F.coalesce(F.get(lines(behind), F.lit(0)), F.lit("")))
    town = F.when(at > 0, F.nullif(F.regexp_extract(line, r"(?U)^[\p{IsAlphabetic}\s-]*", 0), F.lit("")))
    street = F.nullif(F.regexp_extract(text, P.STREET, 0), F.lit(""))
    return let(F.struct(street.alias("street"), town.alias("town")), lambda x: _address(text, postal, x.street, x.town))


def _address(text: Column, postal: Column, street: Column, town: Column) -> Column:
    plain = F.slice(F.filter(_name_like(text), lambda t: ~t.rlike(P.EMAIL) & ~t.rlike(P.PHONE)), 2, 2)
    raw = F.when(street.isNull() & town.isNull() & (F.size(plain) > 0), F.array_join(plain, ", "))
    return F.struct(street.alias("street"), postal.alias("postal_code"), town.alias("city"), F.lit(None).cast("string").alias("country"), raw.alias("raw"))


def address_text(a: Column) -> Column:
    """One line: the raw text if there is one, else street, code and town, and a country other than Poland."""
    place = F.when(a.city.isNotNull(), F.concat_ws(" ", a.postal_code, a.city))
    return F.coalesce(a.raw, F.concat_ws(", ", a.street, place, F.when(~a.country.isin("Polska", "Poland", "PL"), a.country)))


def address_empty(a: Column) -> Column:
    return a.street.isNull() & a.postal_code.isNull() & a.city.isNull() & a.raw.isNull()


def parties(text: Column, seller: Column, buyer: Column, every: Column, validate_nip: bool = True) -> tuple[Column, Column]:
    """(issuer, receiver) structs; the sections come from ``sections``, ``every`` holds all NIPs of the text."""
    nip = lambda part, k: F.coalesce(F.get(nips(part, validate_nip), F.lit(0)).value, F.get(every, F.lit(k)).value)
    regon = lambda part: F.get(regons(part), F.lit(0)).value
    iban = lambda part: F.get(ibans(part), F.lit(0)).value
    null = F.lit(None).cast("string")

    def party(part: Column, k: int, own: bool) -> Column:
        return F.struct(
            party_name(part).alias("name"),
            nip(part, k).alias("nip"),
            regon(part).alias("regon"),
            address(part).alias("address"),
            (F.coalesce(iban(part), iban(text)) if own else null).alias("bank_account"),
            null.alias("bank_name"),
            (F.nullif(F.regexp_extract(part, P.EMAIL, 0), F.lit("")) if own else null).alias("email"),
            (F.nullif(F.regexp_extract(part, P.PHONE, 0), F.lit("")) if own else null).alias("phone"),
            null.alias("website"),
        )

    return party(seller, 0, True), party(buyer, 1, False)


def payment_kind(text: Column) -> Column:
    """transfer, cash, card, compensation, or other:<text>."""
    return let(F.lower(stripped(text)), _kind)


def _kind(s: Column) -> Column:
    has = lambda *words: F.lit(False) if not words else s.rlike("|".join(words))
    return (
        F.when(s.isNull(), None)
        .when(has("przelew", "transfer", "bank"), "transfer")
        .when(has("gotówk", "cash", "gotowk"), "cash")
        .when(has("kart", "card"), "card")
        .when(has("kompensat", "barter"), "compensation")
        .otherwise(F.concat(F.lit("other:"), s))
    )


def payment_method(text: Column) -> Column:
    return payment_kind(capture(text, P.PAYMENT_METHOD))


def invoice_number(text: Column) -> Column:
    """The number behind its label, else the first bare number as number/year."""
    bare = F.when(text.rlike(P.INVOICE_NUMBER_STANDALONE), F.concat_ws("/", F.regexp_extract(text, P.INVOICE_NUMBER_STANDALONE, 1), F.regexp_extract(text, P.INVOICE_NUMBER_STANDALONE, 2)))
    return F.coalesce(F.trim(capture(text, P.INVOICE_NUMBER)), bare)
