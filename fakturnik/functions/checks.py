"""Check-digit predicates over digit strings, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The official NIP and REGON weights.
NIP_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON9_WEIGHTS = (8, 9, 2, 3, 4, 5, 6, 7)
REGON14_WEIGHTS = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def weighted_sum(digits: Column, weights: tuple[int, ...]) -> Column:
    """Sum of weight times digit over the leading characters; null where a character is no digit."""
    total = F.lit(0)
    for at, weight in enumerate(weights, start=1):
        total = total + F.substring(digits, at, 1).try_cast("int") * F.lit(weight)
    return total


def nip_ok(value: Column) -> Column:
    """Ten digits once all else is removed, and the last equals the weighted sum modulo 11 (10 is no digit)."""
    d = digits_only(value)
    check = weighted_sum(d, NIP_WEIGHTS) % 11
    return F.coalesce((F.length(d) == 10) & (check == F.substring(d, 10, 1).try_cast("int")), F.lit(False))


def regon9_ok(digits: Column) -> Column:
    check = (weighted_sum(digits, REGON9_WEIGHTS) % 11) % 10
    return F.coalesce((F.length(digits) == 9) & (check == F.substring(digits, 9, 1).try_cast("int")), F.lit(False))


def regon14_ok(digits: Column) -> Column:
    """A valid nine-digit prefix and a valid fourteenth digit."""
    check = (weighted_sum(digits, REGON14_WEIGHTS) % 11) % 10
    return F.coalesce(
        (F.length(digits) == 14) & regon9_ok(F.substring(digits, 1, 9)) & (check == F.substring(digits, 14, 1).try_cast("int")),
        F.lit(False),
    )


def regon_ok(value: Column) -> Column:
    d = digits_only(value)
    return F.when(F.length(d) == 9, regon9_ok(d)).when(F.length(d) == 14, regon14_ok(d)).otherwise(F.lit(False))
