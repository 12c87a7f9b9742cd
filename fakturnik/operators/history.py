"""History of entity attributes: versions with their period of validity, by gaps and islands.

Snapshots are first reduced to one row per (entity, day), so that an entity of any size brings at
most as many rows into its window as there are days; the reduction is an aggregate that combines
before the shuffle. Windows then carry known values forward (and the first known one back, so that a
value that becomes known is no change), compare the hash of all attributes with that of the row before
(lag), number the islands by a running sum and take each island's first day and the
first day of the next.

Defined cases: rows without entity or day are left out; a missing attribute is no change (the last
known value stands, also per part of an address); several values of one attribute on one day count
as the smallest of them in text order; repeated rows change nothing; a state that returns is a new
version; an empty table gives no versions; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import digits_only, nip_ok


def squeezed(value: Column) -> Column:
    """Without white space and letter case; empty counts as missing."""
    return F.nullif(F.regexp_replace(F.lower(value), r"[\s ]+", ""), F.lit(""))


def account(value: Column) -> Column:
    return F.nullif(F.regexp_replace(squeezed(value), "^pl", ""), F.lit(""))


def versions(df: DataFrame, entity: Column, day: Column, attributes: dict[str, Column]) -> DataFrame:
    """One row per version: entity, version number, the attributes, valid_from and valid_to (exclusive, null while open)."""
    names = list(attributes)
    daily = (
        df.select(entity.alias("entity"), day.alias("day"), *[c.cast("string").alias(n) for n, c in attributes.items()])
        .filter(F.col("entity").isNotNull() & F.col("day").isNotNull())
        .groupBy("entity", "day")
        .agg(*[F.min(n).alias(n) for n in names])
    )
    by_day = Window.partitionBy("entity").orderBy("day")
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = daily.select("entity", "day", *[F.last(n, ignorenulls=True).over(by_day).alias(n) for n in names], *[F.first(n, ignorenulls=True).over(whole).alias(f"_first_{n}") for n in names])
    known = known.withColumn("_hash", F.xxhash64(*[F.coalesce(n, f"_first_{n}", F.lit("")) for n in names]))
    before = F.lag("_hash").over(by_day)
    islands = known.withColumn("starts", (before.isNull() | (F.col("_hash") != before)).cast("int")).withColumn("version", F.sum("starts").over(by_day))
    # A value first seen inside a version belongs to all of it, so the version shows the last known of each.
    whole = islands.groupBy("entity", "version").agg(F.min("day").alias("valid_from"), F.max("day").alias("last_seen"), *[F.max_by(n, "day").alias(n) for n in names])
    return whole.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("entity").orderBy("version")))


def issuer_history(invoices: DataFrame) -> DataFrame:
    """The versions of every issuer's bank account and address by the issue dates of its invoices."""
    rows = invoices.filter(nip_ok(F.col("issuer.nip")) & F.col("header.issue_date").isNotNull())
    return versions(
        rows,
        digits_only(F.col("issuer.nip")),
        F.col("header.issue_date"),
        {
            "bank_account": account(F.col("issuer.bank_account")),
            "street": squeezed(F.col("issuer.address.street")),
            "postal_code": squeezed(F.col("issuer.address.postal_code")),
            "city": squeezed(F.col("issuer.address.city")),
        },
    ).withColumnRenamed("entity", "nip")
