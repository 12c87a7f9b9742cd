"""Queries over column profiles and attribute histories, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, profile
from ..runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quality_cases(table(spark, sf_dir, "invoices"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every invoice column, from counts maintained over two deltas."""
    rows = table(spark, sf_dir, "invoices")
    judged = {s.name: s for s in profile.invoice_fields()}
    fields = [judged.get(s.name, s) for s in profile.leaf_fields(rows.schema)]
    odd = F.col("load_id") % 2 == 1
    store = profile.CountStore(spark)
    store.commit(profile.counts(rows.filter(odd), fields))
    state = store.commit(profile.counts(rows.filter(~odd), fields))
    return profile.profile(state, fields)


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the profile that its SQL states; there the range is in text order."""
    out = _profile(spark, sf_dir).drop("min_value", "max_value", "broken", "min_length", "max_length")
    return out.withColumnsRenamed({"min_text": "min_value", "max_text": "max_value"})


def p4_profile_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile: the range in the column's own order, broken values (null where no rule judges the column) and lengths too."""
    return _profile(spark, sf_dir).drop("min_text", "max_text")


def p4_load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = profile.invoice_fields()
    out = profile.load_metrics(profile.counts(table(spark, sf_dir, "invoices"), fields), fields)
    return out.select("field", "load", "rows", F.round("null_share", 6).alias("null_share"), F.round("top_share", 6).alias("top_share"))


def p4_load_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that loads are compared by: the metrics, the middle of the field's scale and the distance of its notations."""
    fields = profile.invoice_fields()
    state = profile.CountStore(spark).commit(profile.counts(table(spark, sf_dir, "invoices"), fields))
    out = profile.load_metrics(state, fields).join(profile.notation_distance(state), ["field", "load"], "left")
    return out.select("field", "load", "rows", *[F.round(c, 6).alias(c) for c in ("null_share", "top_share", "middle", "apart")])


def p4_load_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = profile.invoice_fields()
    out = profile.load_departures(profile.counts(table(spark, sf_dir, "invoices"), fields), fields)
    return out.select("field", "load", F.array_join("departs", ",").alias("departs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.issuer_history(table(spark, sf_dir, "invoices"))
    return out.select("nip", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


def p5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.issuer_history(table(spark, sf_dir, "invoices"))
    return out.select("nip", F.col("version").cast("bigint").alias("version"), "valid_from", "valid_to", "bank_account", "street", "postal_code", "city")


QUERIES = {f.__name__: f for f in (p4_found, p4_profile, p4_profile_whole, p4_load_metrics, p4_load_measures, p4_load_changes, p5_found, p5_history)}

_LEAVES = (
    ["row_id", "doc_id", "load_id", "loaded_at"]
    + [f"header.{c}" for c in ("invoice_number", "issue_date", "sale_date", "due_date", "invoice_type", "currency")]
    + ["issuer.name", "issuer.nip", "issuer.regon"]
    + [f"issuer.address.{c}" for c in ("street", "postal_code", "city", "country", "raw")]
    + ["issuer.bank_account", "issuer.email", "receiver.name", "receiver.nip"]
    + [f"summary.{c}" for c in ("total_net", "total_vat", "total_gross", "payment_method")]
)


def _sql_text(leaf: str) -> str:
    if leaf == "loaded_at":
        return "regexp_replace(CAST(loaded_at AT TIME ZONE 'UTC' AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1')"
    return f"CAST({leaf} AS VARCHAR)"


_CELLS = " UNION ALL ".join(f"SELECT '{leaf}' AS field, load_id AS load, {_sql_text(leaf)} AS value FROM invoices" for leaf in _LEAVES)
_JUDGED = ("issuer.nip", "receiver.nip", "summary.total_gross", "header.invoice_number", "header.due_date")

_NIP_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_NIP_SUM = "(" + " + ".join(f"{w} * CAST(substr({{0}}, {i}, 1) AS INT)" for i, w in enumerate((6, 5, 7, 2, 3, 4, 5, 6, 7), start=1)) + ")"


def nip_sql(value: str) -> str:
    """The NIP check as SQL text."""
    d = _NIP_DIGITS.format(value)
    return f"(CASE WHEN length({d}) = 10 THEN {_NIP_SUM.format(d)} % 11 = CAST(substr({d}, 10, 1) AS INT) ELSE false END)"


_P5 = f"""
WITH r AS (
  SELECT {_NIP_DIGITS.format('issuer.nip')} AS nip, header.issue_date AS day,
    nullif(regexp_replace(regexp_replace(lower(issuer.bank_account), '[\\s\\x{{00a0}}]+', '', 'g'), '^pl', ''), '') AS bank_account,
    nullif(regexp_replace(lower(issuer.address.street), '[\\s\\x{{00a0}}]+', '', 'g'), '') AS street,
    nullif(regexp_replace(lower(issuer.address.postal_code), '[\\s\\x{{00a0}}]+', '', 'g'), '') AS postal_code,
    nullif(regexp_replace(lower(issuer.address.city), '[\\s\\x{{00a0}}]+', '', 'g'), '') AS city
  FROM invoices WHERE header.issue_date IS NOT NULL AND issuer.nip IS NOT NULL AND {nip_sql('issuer.nip')}),
d AS (SELECT nip, day, min(bank_account) AS bank_account, min(street) AS street, min(postal_code) AS postal_code, min(city) AS city FROM r GROUP BY nip, day),
k AS (SELECT nip, day,
    last_value(bank_account IGNORE NULLS) OVER w AS bank_account, last_value(street IGNORE NULLS) OVER w AS street,
    last_value(postal_code IGNORE NULLS) OVER w AS postal_code, last_value(city IGNORE NULLS) OVER w AS city
  FROM d WINDOW w AS (PARTITION BY nip ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN row_number() OVER w = 1
    OR coalesce(bank_account <> lag(bank_account) OVER w, false) OR coalesce(street <> lag(street) OVER w, false)
    OR coalesce(postal_code <> lag(postal_code) OVER w, false) OR coalesce(city <> lag(city) OVER w, false) THEN 1 ELSE 0 END AS starts
  FROM k WINDOW w AS (PARTITION BY nip ORDER BY day)),
v AS (SELECT *, sum(starts) OVER (PARTITION BY nip ORDER BY day) AS version FROM s),
g AS (SELECT nip, CAST(version AS BIGINT) AS version, min(day) AS valid_from, max_by(bank_account, day) AS bank_account, max_by(street, day) AS street,
    max_by(postal_code, day) AS postal_code, max_by(city, day) AS city FROM v GROUP BY nip, version)
"""

ORACLES = {
    "p4_profile": f"""
WITH c AS ({_CELLS}), v AS (SELECT field, value, count(*) AS n FROM c GROUP BY field, value)
SELECT field, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS nulls,
  round(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) / sum(n), 6) AS null_rate, count(value) AS distinct_values,
  min(value) AS min_value, max(value) AS max_value,
  abs(round(log2(sum(n) FILTER (WHERE value IS NOT NULL)) - sum(n * log2(n)) FILTER (WHERE value IS NOT NULL) / sum(n) FILTER (WHERE value IS NOT NULL), 4)) AS entropy
FROM v GROUP BY field""",
    "p4_load_metrics": f"""
WITH c AS ({_CELLS}), v AS (SELECT field, load, value, count(*) AS n FROM c WHERE field IN {_JUDGED} GROUP BY field, load, value)
SELECT field, load, CAST(sum(n) AS BIGINT) AS rows, round(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) / sum(n), 6) AS null_share,
  round(max(n) FILTER (WHERE value IS NOT NULL) / sum(n) FILTER (WHERE value IS NOT NULL), 6) AS top_share
FROM v GROUP BY field, load""",
    "p5_found": _P5 + "SELECT nip, strftime(valid_from, '%Y-%m-%d') AS valid_from FROM g",
    "p5_history": _P5 + "SELECT nip, version, valid_from, lead(valid_from) OVER (PARTITION BY nip ORDER BY version) AS valid_to, bank_account, street, postal_code, city FROM g",
}
