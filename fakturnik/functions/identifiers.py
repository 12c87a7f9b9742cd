"""NIP, REGON and IBAN: extraction, check digits and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .checks import digits_only, nip_ok, regon_ok
from .matching import and_then, find_all, first, group, typed

__all__ = ["format_iban", "format_nip", "iban_ok", "ibans", "nip_ok", "nips", "regon_ok", "regons"]


def _joined(h: Column) -> Column:
    return F.array_join(h.groups, "")


def _checked(matches: Column, check, validate: bool) -> Column:
    return F.filter(matches, lambda m: check(m.value)) if validate else matches


def nips(text: Column, validate: bool = True) -> Column:
    """Labelled NIPs, then bare ones with a new value."""
    labelled = _checked(typed(find_all(text, P.NIP, 4), _joined, 0.95), nip_ok, validate)
    bare = _checked(typed(find_all(text, P.NIP_STANDALONE, 4), _joined, 0.7), nip_ok, validate)
    return and_then(labelled, bare)


def regons(text: Column, validate: bool = True) -> Column:
    labelled = _checked(typed(find_all(text, P.REGON, 1), lambda h: group(h, 1), 0.95), regon_ok, validate)
    bare = _checked(typed(find_all(text, P.REGON_STANDALONE, 2), lambda h: F.coalesce(F.nullif(group(h, 1), F.lit("")), group(h, 2)), 0.6), regon_ok, validate)
    return and_then(labelled, bare)


def iban_ok(value: Column) -> Column:
    """Two letters, two digits, and the digits of the rotated account (letters as 10 to 35) modulo 97 are 1."""
    s = F.upper(F.regexp_replace(value, r"(?U)\s", ""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        digit = code.between(48, 57)
        return F.when(rest < 0, rest).when(digit, (rest * 10 + (code - 48)) % 97).when(code.between(65, 90), (rest * 100 + (code - 55)) % 97).otherwise(F.lit(-1))

    rest = F.aggregate(signs, F.lit(0), step)
    return F.coalesce((F.length(s) >= 5) & s.rlike("^[A-Z]{2}[0-9]{2}") & (rest == 1), F.lit(False))


def ibans(text: Column, validate: bool = True) -> Column:
    """Accounts in the usual grouping (country PL where none is written), then labelled ones of exactly 26 digits."""
    shaped = typed(find_all(text, P.IBAN, 8), lambda h: F.concat(F.coalesce(F.nullif(group(h, 1), F.lit("")), F.lit("PL")), F.array_join(F.slice(h.groups, 2, 7), "")), 0.95)
    labelled = typed(
        find_all(text, P.BANK_ACCOUNT, 1), lambda h: F.when(F.length(digits_only(group(h, 1))) == 26, F.concat(F.lit("PL"), digits_only(group(h, 1)))), 0.9
    )
    return and_then(_checked(shaped, iban_ok, validate), _checked(labelled, iban_ok, validate))


def format_nip(value: Column) -> Column:
    d = digits_only(value)
    return F.when(F.length(d) == 10, F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{2})(\d{2})$", "$1-$2-$3-$4")).otherwise(value)


def format_iban(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"(?U)\s", ""), "(.{4})", "$1 "))


def first_nip(text: Column, validate: bool = True) -> Column:
    return first(nips(text, validate))


def first_regon(text: Column) -> Column:
    return first(regons(text))


def first_iban(text: Column) -> Column:
    return first(ibans(text))
