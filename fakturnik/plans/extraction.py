"""Queries over text extraction, with SQL counterparts for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import dates as D
from ..functions import identifiers as N
from ..functions import items as I
from ..functions import parties as Q
from ..functions import patterns as P
from ..functions.invoice import parse
from ..functions.matching import find_all
from ..runtime import spread, table
from ..sources import files, sinks
from .quality import nip_sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _matches(spark: SparkSession, sf_dir: str, column: Column) -> DataFrame:
    """One row per match of a document: its place in the list, value, byte span and confidence."""
    out = _docs(spark, sf_dir).select("doc_id", F.posexplode(column).alias("at", "m"))
    return out.select("doc_id", F.col("at").cast("bigint").alias("at"), F.col("m.value").alias("value"), F.round(F.col("m.confidence").cast("double"), 2).alias("confidence"))


def nip_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, N.nips(F.col("text")))


def regon_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, N.regons(F.col("text")))


def iban_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, N.ibans(F.col("text"), validate=False))


def iban_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "invoices").select("row_id", F.col("issuer.bank_account").alias("account"))
    full = F.when(F.upper(F.regexp_replace("account", r"\s", "")).startswith("PL"), F.col("account")).otherwise(F.concat(F.lit("PL"), F.col("account")))
    return rows.filter("account IS NOT NULL").select("row_id", N.iban_ok(full).alias("valid"), N.format_iban(F.upper(full)).alias("formatted"))


def nip_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "invoices").select("row_id", F.col("issuer.nip").alias("nip")).filter("nip IS NOT NULL")
    return rows.select("row_id", N.nip_ok(F.col("nip")).alias("valid"), N.format_nip(F.col("nip")).alias("formatted"))


def regon_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "invoices").select("row_id", F.col("issuer.regon").alias("regon")).filter("regon IS NOT NULL")
    return rows.select("row_id", N.regon_ok(F.col("regon")).alias("valid"))


def date_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, D.dates(F.col("text")))


def dates_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in D.labelled(F.col("text")).items()])


def amount_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _matches(spark, sf_dir, A.amounts(F.col("text")))
    return out.select("doc_id", "at", (F.col("value") * 100).cast("bigint").alias("grosze"))


def amount_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte spans of all amounts: in each document they are ordered and hold the matched text."""
    out = _docs(spark, sf_dir).select("doc_id", F.explode(find_all(F.col("text"), P.AMOUNT, 2)).alias("m"))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"), F.sum(F.col("m.end") - F.col("m.start")).alias("bytes"))


def totals_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).withColumn("found", A.labelled_totals(F.col("text")))
    return rows.select("doc_id", *[(F.col(f"found.{n}") * 100).cast("bigint").alias(n) for n in ("gross", "net", "vat")])


def amount_parse_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "invoices").select("row_id", F.col("summary.total_gross").alias("v")).filter("v IS NOT NULL")
    text = A.format_amount(F.col("v"))
    return rows.select("row_id", text.alias("formatted"), (A.parse_amount(text) * 100).cast("bigint").alias("grosze"))


def vat_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.array_join(A.rates(F.col("text")), ",").alias("rates"))


def vat_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _docs(spark, sf_dir).select("doc_id", F.posexplode(A.breakdown(F.col("text"))).alias("at", "b"))
    return out.select("doc_id", F.col("at").cast("bigint").alias("at"), "b.rate", (F.col("b.net") * 100).cast("bigint").alias("net"), (F.col("b.gross") * 100).cast("bigint").alias("gross"))


def vat_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAT, gross and net again from gross for every line item."""
    net = F.col("l_extendedprice").cast("decimal(20,2)")
    rate = F.when(F.col("l_returnflag") == "A", "23").when(F.col("l_returnflag") == "N", "8").otherwise("zw")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", net.alias("net"), rate.alias("rate"))
    rows = rows.withColumn("vat", A.vat_of(F.col("net"), F.col("rate"))).withColumn("gross", A.gross_of(F.col("net"), F.col("vat")))
    back = F.round(A.net_of_gross(F.col("gross"), F.col("rate")), 2)
    return rows.groupBy("rate").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("vat") * 10000).cast("bigint")).alias("vat"), F.sum((F.col("gross") * 10000).cast("bigint")).alias("gross"), F.sum((back * 100).cast("bigint")).alias("net"))


def invoice_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", Q.invoice_number(F.col("text")).alias("number"))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.EMAIL), F.lit(0))).alias("email"))
    return found.groupBy("doc_id", "email").agg(F.count(F.lit(1)).alias("times"))


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.nullif(F.regexp_extract("text", P.PHONE, 0), F.lit("")).alias("phone"))


def party_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    seller, buyer = Q.sections(F.col("text"))
    return _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.length(seller).cast("bigint").alias("seller"), F.length(buyer).cast("bigint").alias("buyer"))


def party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    seller, buyer = Q.sections(F.col("text"))
    return _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", Q.party_name(seller).alias("seller"), Q.party_name(buyer).alias("buyer"))


def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", Q.address(F.col("text")).alias("a"))
    return rows.select("doc_id", "a.street", "a.postal_code", "a.city", Q.address_text(F.col("a")).alias("line"), Q.address_empty(F.col("a")).alias("empty"))


def address_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for every issuer's address, from its parts."""
    a = F.col("issuer.address")
    return table(spark, sf_dir, "invoices").filter(a.isNotNull()).select("row_id", Q.address_text(a).alias("line"), Q.address_empty(a).alias("empty"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pdf_pages").select("doc_id", "number", "text").distinct()
    out = pages.select("doc_id", "number", F.posexplode(I.table_items(F.col("text"))).alias("at", "i"))
    return out.select("doc_id", "number", F.col("at").cast("bigint").alias("at"), "i.description", "i.ordinal", "i.vat_rate", (F.col("i.total_gross") * 100).cast("bigint").alias("gross"))


def line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every page of a PDF parsed as an item, counted by what came out."""
    lines = table(spark, sf_dir, "pdf_pages").select("doc_id", "number", F.explode(F.split("text", "\n")).alias("line"))
    item = lines.select(I.parse_line(F.col("line")).alias("i"))
    return item.groupBy(F.col("i").isNotNull().alias("is_item")).agg(F.count(F.lit(1)).alias("lines"), F.sum((F.col("i.total_gross") * 100).cast("bigint")).alias("gross"))


def payment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "invoices").select(Q.payment_kind(F.col("summary.payment_method")).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("invoices"))


def invoice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document parsed as an invoice: the flat columns, confidence and warnings."""
    rows = parse(_docs(spark, sf_dir))
    return rows.select("doc_id", *sinks.csv_columns(F.col("invoice"), dates=True), F.round(F.col("invoice.metadata.confidence").cast("double"), 2).alias("confidence"), F.size("invoice.line_items").alias("items"), F.array_join("warnings", "; ").alias("warnings"))


def invoice_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_docs(spark, sf_dir)).select("doc_id", sinks.json_text(F.col("invoice")).alias("json"))


def invoice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_docs(spark, sf_dir)).select("doc_id", sinks.plain_text(F.col("invoice")).alias("summary"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse(_docs(spark, sf_dir)).select(
        F.concat(F.lit("in/doc"), F.col("doc_id"), F.lit(".pdf")).alias("path"), "invoice", F.when(F.col("text").isNull(), F.lit("no text")).alias("error"), F.lit(0).cast("bigint").alias("processing_time_ms")
    )
    return sinks.summary(rows)


def batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.counters(_docs(spark, sf_dir).select(F.when(F.col("text").isNull(), F.lit("no text")).alias("error")))


def file_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and stems of file names made from the part table."""
    endings = F.array(*map(F.lit, ("pdf", "PNG", "Jpg", "jpeg", "tiff", "bmp", "webp", "txt")))
    path = F.concat(F.lit("/scan/"), F.col("p_partkey"), F.lit("."), F.get(endings, (F.col("p_partkey") % 8).cast("int")))
    rows = table(spark, sf_dir, "part").select(path.alias("path"))
    return rows.groupBy(files.route(F.col("path")).alias("route"), files.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.max(sinks.file_stem(F.col("path"))).alias("last_stem"))


def pdf_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each PDF from its text and its number of images."""
    images = table(spark, sf_dir, "pdf_pages").select("doc_id", "number", "image_count").distinct().groupBy("doc_id").agg(F.sum("image_count").alias("images"))
    texts = table(spark, sf_dir, "pdf_contents").select("doc_id", "text").distinct()
    return texts.join(images, "doc_id", "left").select("doc_id", files.pdf_kind(F.col("text"), F.col("images")).alias("kind"))


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cut into pages of even line counts."""
    rows = table(spark, sf_dir, "pdf_contents").filter("page_count > 0 AND text IS NOT NULL").select("doc_id", "text", "page_count").distinct()
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("page_count"))))
    return rows.select("doc_id", "number", F.length(files.page_slice(F.col("text"), F.col("page_count"), F.col("number"))).cast("bigint").alias("chars"))


def text_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is parsed for each PDF: its own or what recognition gave, by kind."""
    own = table(spark, sf_dir, "pdf_contents").select("doc_id", "pdf_type", "text").distinct()
    read = table(spark, sf_dir, "ocr_results").select("doc_id", "page_no", "text").distinct().groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x.text), "\n\n").alias("ocr"))
    rows = own.join(read, "doc_id", "full")
    return rows.select("doc_id", F.coalesce(F.length(files.text_source(F.coalesce("pdf_type", F.lit("Image")), F.col("text"), F.col("ocr"))), F.lit(0)).cast("bigint").alias("chars"))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * F.col("o_orderkey")).cast("bigint").alias("n"))
    return rows.select("o_orderkey", sinks.human_size(F.col("n")).alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        nip_matches, regon_matches, iban_matches, iban_valid, nip_valid, regon_valid, date_matches, dates_labelled, amount_matches, amount_spans, totals_labelled, amount_parse_format, vat_rates, vat_breakdown, vat_arithmetic,
        invoice_numbers, emails, phones, party_sections, party_names, address_parts, address_lines, line_items, line_parse, payment_kinds, invoice_records, invoice_json, invoice_text, batch_summary, batch_counters,
        file_routes, pdf_kinds, page_split, text_routing, human_sizes,
    )
}


def _first(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(text, '{P.re2(pattern)}', {group}), '')"


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(text, '{P.re2(pattern)}', {group})"


def _plain(value: str) -> str:
    """An amount with a comma or a dot before its cents, as grosze."""
    return f"CAST(regexp_replace({value}, '[^0-9]', '', 'g') AS BIGINT)"


_AMOUNT_CELLS = f"""SELECT doc_id, unnest({_all(P.AMOUNT, 1)}) AS whole, unnest({_all(P.AMOUNT, 2)}) AS cents, unnest(range(len({_all(P.AMOUNT, 1)}))) AS k FROM documents"""
_GOOD = "regexp_full_match(replace(replace(whole, ' ', ''), chr(160), ''), '[0-9]+')"

ORACLES = {
    "nip_matches": f"""
WITH l AS (SELECT doc_id, unnest({_all(P.NIP)}) AS m, unnest(range(len({_all(P.NIP)}))) AS k, 1 AS kind FROM documents),
s AS (SELECT doc_id, unnest({_all(P.NIP_STANDALONE)}) AS m, unnest(range(len({_all(P.NIP_STANDALONE)}))) AS k, 2 AS kind FROM documents),
v AS (SELECT doc_id, kind, k, right(regexp_replace(m, '[^0-9]', '', 'g'), 10) AS value FROM (SELECT * FROM l UNION ALL SELECT * FROM s)),
g AS (SELECT * FROM v WHERE {nip_sql('value')}),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY kind, k) AS r FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY kind, k) - 1 AS at, value, CASE WHEN kind = 1 THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence FROM u WHERE kind = 1 OR r = 1""",
    "nip_valid": f"""SELECT row_id, {nip_sql('issuer.nip')} AS valid,
  CASE WHEN length(regexp_replace(issuer.nip, '[^0-9]', '', 'g')) = 10 THEN regexp_replace(regexp_replace(issuer.nip, '[^0-9]', '', 'g'), '^(\\d{{3}})(\\d{{3}})(\\d{{2}})(\\d{{2}})$', '\\1-\\2-\\3-\\4') ELSE issuer.nip END AS formatted
FROM invoices WHERE issuer.nip IS NOT NULL""",
    "regon_valid": """WITH d AS (SELECT row_id, regexp_replace(issuer.regon, '[^0-9]', '', 'g') AS d FROM invoices WHERE issuer.regon IS NOT NULL)
SELECT row_id, CASE WHEN length(d) = 9 THEN (list_sum(list_transform(range(1, 9), lambda i: [8,9,2,3,4,5,6,7][i] * CAST(substr(d, i, 1) AS INT))) % 11) % 10 = CAST(substr(d, 9, 1) AS INT) ELSE false END AS valid FROM d""",
    "iban_valid": """WITH a AS (SELECT row_id, CASE WHEN starts_with(upper(regexp_replace(issuer.bank_account, '\\s', '', 'g')), 'PL') THEN issuer.bank_account ELSE 'PL' || issuer.bank_account END AS x FROM invoices WHERE issuer.bank_account IS NOT NULL),
b AS (SELECT row_id, upper(regexp_replace(x, '\\s', '', 'g')) AS s FROM a)
SELECT row_id, regexp_full_match(s, 'PL[0-9]{26}') AND (CAST(substr(s, 5) || '2521' || substr(s, 3, 2) AS HUGEINT) % 97 = 1) AS valid, trim(regexp_replace(s, '(.{4})', '\\1 ', 'g')) AS formatted FROM b""",
    "amount_matches": f"""WITH c AS ({_AMOUNT_CELLS})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS at, {_plain("whole || cents")} AS grosze FROM c WHERE {_GOOD}""",
    "amount_spans": f"""WITH c AS (SELECT doc_id, unnest({_all(P.AMOUNT)}) AS m FROM documents) SELECT doc_id, count(*) AS matches, CAST(sum(strlen(m)) AS BIGINT) AS bytes FROM c GROUP BY doc_id""",
    "totals_labelled": f"""SELECT doc_id, {_plain(_first(P.TOTAL_GROSS))} AS gross, {_plain(_first(P.TOTAL_NET))} AS net, {_plain(_first(P.TOTAL_VAT))} AS vat FROM documents""",
    "amount_parse_format": """SELECT row_id, CASE WHEN summary.total_gross < 0 THEN '-' || CASE WHEN length(CAST(CAST(trunc(abs(summary.total_gross)) AS BIGINT) AS VARCHAR)) % 3 = 0 THEN ' ' ELSE '' END ELSE '' END
  || replace(format('{:,}', CAST(trunc(abs(summary.total_gross)) AS BIGINT)), ',', ' ') || ',' || right(CAST(abs(summary.total_gross) AS VARCHAR), 2) AS formatted, CAST(abs(summary.total_gross) * 100 AS BIGINT) AS grosze
FROM invoices WHERE summary.total_gross IS NOT NULL""",
    "vat_arithmetic": """WITH l AS (SELECT CAST(round(l_extendedprice, 2) AS DECIMAL(20,2)) AS net, CASE l_returnflag WHEN 'A' THEN '23' WHEN 'N' THEN '8' ELSE 'zw' END AS rate, CASE l_returnflag WHEN 'A' THEN 23 WHEN 'N' THEN 8 ELSE 0 END AS p FROM lineitem),
v AS (SELECT rate, CAST(net * 100 AS BIGINT) AS n, p FROM l)
SELECT rate, count(*) AS rows, CAST(sum(n * p) AS BIGINT) AS vat, CAST(sum(n * 100 + n * p) AS BIGINT) AS gross, CAST(sum(n) AS BIGINT) AS net FROM v GROUP BY rate""",
    "invoice_numbers": f"""SELECT doc_id, coalesce(trim({_first(P.INVOICE_NUMBER)}), CASE WHEN regexp_matches(text, '{P.re2(P.INVOICE_NUMBER_STANDALONE)}') THEN regexp_extract(text, '{P.re2(P.INVOICE_NUMBER_STANDALONE)}', 1) || '/' || regexp_extract(text, '{P.re2(P.INVOICE_NUMBER_STANDALONE)}', 2) END) AS number FROM documents""",
    "emails": f"""WITH e AS (SELECT doc_id, unnest({_all(P.EMAIL)}) AS email FROM documents) SELECT doc_id, email, count(*) AS times FROM e GROUP BY doc_id, email""",
    "phones": f"SELECT doc_id, {_first(P.PHONE, 0)} AS phone FROM documents",
    "address_lines": """SELECT row_id, coalesce(issuer.address.raw, concat_ws(', ', issuer.address.street, CASE WHEN issuer.address.city IS NOT NULL THEN concat_ws(' ', issuer.address.postal_code, issuer.address.city) END,
  CASE WHEN issuer.address.country NOT IN ('Polska', 'Poland', 'PL') THEN issuer.address.country END)) AS line,
  issuer.address.street IS NULL AND issuer.address.postal_code IS NULL AND issuer.address.city IS NULL AND issuer.address.raw IS NULL AS empty FROM invoices WHERE issuer.address IS NOT NULL""",
    "payment_kinds": """SELECT CASE WHEN p IS NULL THEN NULL WHEN regexp_matches(p, 'przelew|transfer|bank') THEN 'transfer' WHEN regexp_matches(p, 'gotówk|cash|gotowk') THEN 'cash' WHEN regexp_matches(p, 'kart|card') THEN 'card'
  WHEN regexp_matches(p, 'kompensat|barter') THEN 'compensation' ELSE 'other:' || p END AS kind, count(*) AS invoices FROM (SELECT lower(trim(summary.payment_method)) AS p FROM invoices) GROUP BY 1""",
    "batch_counters": "SELECT count(*) AS processed, count(text) AS successful, count(*) - count(text) AS failed FROM documents",
    "file_routes": """WITH p AS (SELECT '/scan/' || p_partkey || '.' || ['pdf', 'PNG', 'Jpg', 'jpeg', 'tiff', 'bmp', 'webp', 'txt'][p_partkey % 8 + 1] AS path FROM part), e AS (SELECT path, lower(split_part(path, '.', 2)) AS extension FROM p)
SELECT CASE WHEN extension = 'pdf' THEN 'pdf' WHEN extension IN ('png', 'jpg', 'jpeg', 'tiff', 'bmp') THEN 'image' ELSE 'unsupported' END AS route, extension, count(*) AS files, max(regexp_extract(path, '([0-9]+)\\.', 1)) AS last_stem FROM e GROUP BY 1, 2""",
    "pdf_kinds": """WITH i AS (SELECT doc_id, sum(image_count) AS n FROM (SELECT DISTINCT doc_id, number, image_count FROM pdf_pages) GROUP BY doc_id), t AS (SELECT DISTINCT doc_id, text FROM pdf_contents)
SELECT t.doc_id, CASE WHEN strlen(coalesce(text, '')) > 50 AND coalesce(n, 0) > 0 THEN 'Hybrid' WHEN strlen(coalesce(text, '')) > 50 THEN 'Text' WHEN coalesce(n, 0) > 0 THEN 'Image' ELSE 'Empty' END AS kind FROM t LEFT JOIN i ON i.doc_id = t.doc_id""",
    "page_split": """WITH t AS (SELECT DISTINCT doc_id, text, page_count FROM pdf_contents WHERE page_count > 0 AND text IS NOT NULL), r AS (SELECT doc_id, string_split(text, chr(10)) AS l, page_count, unnest(range(1, page_count + 1)) AS number FROM t)
SELECT doc_id, CAST(number AS INT) AS number, CAST(length(array_to_string(list_slice(l, (number - 1) * (len(l) // page_count) + 1, number * (len(l) // page_count)), chr(10))) AS BIGINT) AS chars FROM r""",
}
