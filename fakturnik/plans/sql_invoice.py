"""SQL counterparts of line items and whole invoices."""

from __future__ import annotations

from ..functions import patterns as P
from .quality import nip_sql
from .sql import _DIGITS, _SECTIONS, _all, _first, _first_date, _grosze, _lines, _name_lines, _rate, _strip

_HEAD = "(contains(t, 'Lp') AND (contains(t, 'Nazwa') OR contains(t, 'Opis')))"
_AMOUNTS = f"list_filter(list_transform({_all(P.AMOUNT, 0, 't')}, lambda m: replace(replace(m, ' ', ''), chr(160), '')), lambda m: regexp_full_match(m, '[0-9]+[,.][0-9][0-9]'))"


def _items(source: str, keys: str) -> str:
    """CTEs up to ``item`` (keys, k, description, ordinal, rate, net, gross in grosze) for the texts of a table or query."""
    whole = f"list_filter(list_transform(cells, lambda c: {_strip('c')}), lambda c: regexp_full_match(c, '[+-]?[0-9]+'))"
    return f"""l0 AS (SELECT {keys}, list_transform({_lines('text')}, lambda t: {_strip('t')}) AS ls FROM {source} WHERE text IS NOT NULL),
l1 AS (SELECT {keys}, ls, list_position(list_transform(ls, lambda t: {_HEAD}), true) AS h FROM l0), l2 AS (SELECT {keys}, ls[h + 1:] AS body FROM l1 WHERE h > 0),
l3 AS (SELECT {keys}, body, list_position(list_transform(body, lambda t: starts_with(t, 'Razem') OR starts_with(t, 'SUMA')), true) AS e FROM l2),
l4 AS (SELECT {keys}, CASE WHEN e > 0 THEN body[1:e - 1] ELSE body END AS body FROM l3), l5 AS (SELECT {keys}, unnest(body) AS t, unnest(range(len(body))) AS k FROM l4),
l6 AS (SELECT {keys}, k, t, string_split_regex(t, '[|\\t]') AS cells, {_AMOUNTS} AS a FROM l5 WHERE t <> '' AND NOT {_HEAD}),
l7 AS (SELECT *, list_filter(cells, lambda c: {_strip('c')} <> '' AND NOT regexp_full_match(c, '[0-9.,]*')) AS named, {whole} AS whole, len(a) AS n FROM l6
  WHERE len(a) > 0 AND (len(cells) >= 3 OR len(list_filter(string_split_regex(t, '[\\s\\x0b\\p{{Z}}\\x{{0085}}]+'), lambda w: w <> '')) >= 4)),
item AS (SELECT {keys}, k, coalesce({_strip("list_reverse(list_sort(list_transform(range(1, len(named) + 1), lambda i: struct_pack(b := strlen(named[i]), i := i, c := named[i]))))[1].c")}, 'Item') AS description,
  TRY_CAST(whole[1] AS INT) AS ordinal, coalesce({_rate(f"regexp_extract(t, '{P.re2(P.VAT_RATE)}', 1)")}, '23') AS rate, {_grosze('CASE WHEN n = 1 THEN a[1] WHEN n = 2 THEN a[1] ELSE a[n - 2] END')} AS net, {_grosze('a[n]')} AS gross FROM l7)"""


def _nip_of(text: str) -> str:
    """The first valid NIP of a text: labelled ones come first."""
    one = lambda p: f"list_filter(list_transform({_all(p, 0, text)}, lambda m: {_DIGITS.format('m')}), lambda v: {nip_sql('v')})[1]"
    return f"coalesce({one(P.NIP)}, {one(P.NIP_STANDALONE)})"


def _money(g: str) -> str:
    return f"(CASE WHEN {g} < 0 THEN '-' ELSE '' END || CAST(abs({g}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({g}) % 100 AS VARCHAR), 2, '0'))"


def _differs(what: str) -> str:
    return f"CASE WHEN abs(sum_{what} - t_{what}) > 1 THEN 'Line item {what} total (' || {_money(f'sum_{what}')} || ') differs from summary (' || {_money(f't_{what}')} || ')' END"


_BARE = P.re2(P.INVOICE_NUMBER_STANDALONE)


def records(nips: str) -> str:
    """Every document as an invoice; ``nips`` is the SQL of all NIPs by document and place."""
    plain = f"list_filter({_lines('text')}, lambda t: {_strip('t')} <> '' AND NOT regexp_matches(t, '{P.re2(P.AMOUNT)}') AND NOT contains(t, 'Faktura') AND NOT contains(t, 'NIP'))"
    return f"""WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), nip AS ({nips}), {_SECTIONS.replace('FROM documents WHERE text IS NOT NULL', 'FROM doc')}, {_items('doc', 'doc_id')},
s AS (SELECT doc_id, count(*) AS n, CAST(sum(net) AS BIGINT) AS net, CAST(sum(gross) AS BIGINT) AS gross FROM item GROUP BY doc_id),
a AS (SELECT doc_id, text, coalesce(trim({_first(P.INVOICE_NUMBER, 1)}), CASE WHEN regexp_matches(text, '{_BARE}') THEN regexp_extract(text, '{_BARE}', 1) || '/' || regexp_extract(text, '{_BARE}', 2) END) AS number,
  coalesce({_first_date(_first(P.ISSUE_DATE, 1))}, {_first_date('text')}) AS issued, {_first_date(_first(P.SALE_DATE, 1))} AS sold, {_first_date(_first(P.DUE_DATE, 1))} AS due,
  {_grosze(_first(P.TOTAL_GROSS, 1))} AS g0, {_grosze(_first(P.TOTAL_NET, 1))} AS n0, {_grosze(_first(P.TOTAL_VAT, 1))} AS v0,
  list_transform({_AMOUNTS.replace("'t'", "'text'").replace('(t,', '(text,')}, lambda m: {_grosze('m')}) AS amounts, {plain} AS plain FROM doc),
b AS (SELECT *, coalesce(v0, g0 - n0) AS v1, coalesce(n0, g0 - coalesce(v0, g0 - n0)) AS n1, coalesce(g0, list_max(amounts)) AS g1 FROM a),
d AS (SELECT b.*, CASE WHEN s.n > 0 THEN s.n WHEN len(amounts) > 0 AND len(plain) > 0 THEN 1 ELSE 0 END AS items, CASE WHEN s.n > 0 THEN s.net WHEN len(amounts) > 0 AND len(plain) > 0 THEN coalesce(n1, g1, 0) ELSE 0 END AS sum_net,
  CASE WHEN s.n > 0 THEN s.gross WHEN len(amounts) > 0 AND len(plain) > 0 THEN coalesce(g1, 0) ELSE 0 END AS sum_gross FROM b LEFT JOIN s ON s.doc_id = b.doc_id),
e AS (SELECT d.*, coalesce(n1, sum_net) AS t_net, coalesce(g1, sum_gross) AS t_gross, coalesce({_name_lines('seller')}[1], '') AS issuer, coalesce({_name_lines('buyer')}[1], '') AS receiver,
  coalesce({_nip_of('seller')}, p.value) AS issuer_nip, coalesce({_nip_of('buyer')}, q.value) AS receiver_nip FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN nip p ON p.doc_id = d.doc_id AND p.at = 0 LEFT JOIN nip q ON q.doc_id = d.doc_id AND q.at = 1),
f AS (SELECT *, coalesce(v1, t_gross - t_net) AS t_vat FROM e)
SELECT doc_id, coalesce(number, 'UNKNOWN') AS invoice_number, strftime(coalesce(issued, DATE '1970-01-01'), '%Y-%m-%d') AS issue_date, coalesce(strftime(sold, '%Y-%m-%d'), '') AS sale_date, coalesce(strftime(due, '%Y-%m-%d'), '') AS due_date, issuer AS issuer_name,
  coalesce(issuer_nip, '') AS issuer_nip, receiver AS receiver_name, coalesce(receiver_nip, '') AS receiver_nip, {_money('t_net')} AS total_net, {_money('t_vat')} AS total_vat, {_money('t_gross')} AS total_gross, 'PLN' AS currency,
  round(greatest(0, 1 - CASE WHEN number IS NULL THEN 0.2 ELSE 0 END - CASE WHEN issuer_nip IS NULL THEN 0.2 ELSE 0 END - CASE WHEN items = 0 THEN 0.3 ELSE 0 END - CASE WHEN t_gross = 0 THEN 0.2 ELSE 0 END), 2)::DOUBLE AS confidence, CAST(items AS INT) AS items,
  concat_ws('; ', CASE WHEN number IS NULL THEN 'Could not extract invoice number' END, CASE WHEN issued IS NULL THEN 'Could not extract issue date' END, CASE WHEN issuer_nip IS NULL THEN 'Could not extract issuer NIP' END,
    CASE WHEN items = 0 THEN 'Could not extract line items' END, CASE WHEN issuer = '' THEN 'Missing issuer name' END, CASE WHEN issuer_nip IS NULL THEN 'Missing issuer NIP' END, CASE WHEN receiver = '' AND receiver_nip IS NULL THEN 'Missing receiver information' END,
    CASE WHEN items = 0 THEN 'No line items' END, CASE WHEN t_gross = 0 THEN 'Total gross is zero' END, {_differs('net')}, {_differs('gross')}) AS warnings FROM f"""


def _oracles() -> dict[str, str]:
    from .extraction import ORACLES as extraction
    from .sql import ORACLES as text

    whole = records(extraction["nip_matches"])
    address = text["address_parts"].replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT doc_id, seller AS text FROM c)")
    return {
        "line_items": f"""WITH src AS (SELECT DISTINCT doc_id, number, text FROM pdf_pages), {_items('src', 'doc_id, number')}
SELECT doc_id, number, row_number() OVER (PARTITION BY doc_id, number ORDER BY k) - 1 AS at, description, ordinal, rate AS vat_rate, gross FROM item""",
        "line_parse": f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS t FROM pdf_pages WHERE text IS NOT NULL), x AS (SELECT t, {_AMOUNTS} AS a FROM l),
y AS (SELECT a, len(a) > 0 AND (len(string_split_regex(t, '[|\\t]')) >= 3 OR len(list_filter(string_split_regex(t, '[\\s\\x0b\\p{{Z}}\\x{{0085}}]+'), lambda w: w <> '')) >= 4) AS is_item FROM x)
SELECT is_item, count(*) AS lines, CAST(sum(CASE WHEN is_item THEN {_grosze('a[len(a)]')} END) AS BIGINT) AS gross FROM y GROUP BY is_item""",
        "invoice_records": whole,
        "invoice_text": f"""WITH r AS ({whole}), doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_SECTIONS.replace('FROM documents WHERE text IS NOT NULL', 'FROM doc')}, adr AS ({address})
SELECT r.doc_id, 'Invoice: ' || invoice_number || chr(10) || 'Date: ' || issue_date || chr(10) || chr(10) || 'Issuer:' || chr(10) || '  ' || issuer_name || chr(10) || CASE WHEN issuer_nip <> '' THEN '  NIP: ' || issuer_nip || chr(10) ELSE '' END || '  ' || adr.line
  || chr(10) || chr(10) || 'Receiver:' || chr(10) || '  ' || receiver_name || chr(10) || CASE WHEN receiver_nip <> '' THEN '  NIP: ' || receiver_nip || chr(10) ELSE '' END || chr(10) || 'Summary:' || chr(10) || '  Net:   ' || total_net || ' PLN' || chr(10)
  || '  VAT:   ' || total_vat || ' PLN' || chr(10) || '  Gross: ' || total_gross || ' PLN' || chr(10) || CASE WHEN due_date <> '' THEN chr(10) || 'Payment due: ' || due_date || chr(10) ELSE '' END AS summary FROM r JOIN adr ON adr.doc_id = r.doc_id""",
        "batch_summary": f"""WITH r AS ({whole}), d AS (SELECT doc_id, text IS NOT NULL AS ok FROM documents)
SELECT 'doc' || d.doc_id || '.pdf' AS filename, CASE WHEN ok THEN 'success' ELSE 'error' END AS status, CASE WHEN ok THEN invoice_number ELSE '' END AS invoice_number, CASE WHEN ok THEN issue_date ELSE '' END AS issue_date,
  CASE WHEN ok THEN issuer_name ELSE '' END AS issuer_name, CASE WHEN ok THEN issuer_nip ELSE '' END AS issuer_nip, CASE WHEN ok THEN total_gross ELSE '' END AS total_gross, CASE WHEN ok THEN currency ELSE '' END AS currency,
  CASE WHEN ok THEN printf('%.2f', confidence) ELSE '' END AS confidence, '0' AS processing_time_ms, CASE WHEN ok THEN '' ELSE 'no text' END AS error FROM d JOIN r ON r.doc_id = d.doc_id""",
    }


ORACLES = _oracles()
