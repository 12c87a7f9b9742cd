"""SQL counterparts of text and page queries, written from the results that the queries describe."""

from __future__ import annotations

from ..functions import patterns as P
from ..operators.recognition import DICTIONARY
from .pages import _BOX, _CELLS, _GRID, _PIXELS, _STEPS
from .quality import _CELLS as _LEAF_CELLS
from .quality import _LEAVES, _sql_text, nip_sql

_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"


def _weighted(d: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({d}, {i}, 1) AS INT)" for i, w in enumerate(weights, start=1)) + ")"


def regon_sql(d: str) -> str:
    """The REGON check over a text of digits only."""
    nine = f"({_weighted(d, (8, 9, 2, 3, 4, 5, 6, 7))} % 11) % 10 = CAST(substr({d}, 9, 1) AS INT)"
    fourteen = f"({_weighted(d, (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8))} % 11) % 10 = CAST(substr({d}, 14, 1) AS INT)"
    return f"(CASE WHEN length({d}) = 9 THEN {nine} WHEN length({d}) = 14 THEN {nine} AND {fourteen} ELSE false END)"


def _all(pattern: str, group: int = 0, text: str = "text") -> str:
    return f"regexp_extract_all({text}, '{P.re2(pattern)}', {group})"


def _first(pattern: str, group: int, text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, '{P.re2(pattern)}', {group}), '')"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[\\s\\x0b\\p{{Z}}\\x{{0085}}]+|[\\s\\x0b\\p{{Z}}\\x{{0085}}]+$', '', 'g')"


def _lines(text: str) -> str:
    return f"list_transform(string_split(regexp_replace({text}, '\\n$', ''), chr(10)), lambda t: regexp_replace(t, '\\r$', ''))"


def _merged(kinds: list[tuple[str, str]], value: str, ok: str = "value IS NOT NULL") -> str:
    """Matches of several kinds, each after the other: all of the first kind, of the later ones the first of each new value."""
    parts = " UNION ALL ".join(f"SELECT doc_id, unnest({matches}) AS m, unnest(range(len({matches}))) AS k, {n} AS kind, {confidence}::DOUBLE AS confidence FROM documents" for n, (matches, confidence) in enumerate(kinds, start=1))
    return f"""WITH a AS ({parts}), v AS (SELECT *, {value} AS value FROM a), g AS (SELECT * FROM v WHERE {ok}),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY kind, k) AS r FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY kind, k) - 1 AS at, value, confidence FROM u WHERE kind = 1 OR r = 1"""


_YEAR = "CASE WHEN {0} <= 50 THEN {0} + 2000 WHEN {0} <= 99 THEN {0} + 1900 ELSE {0} END"
_MONTH = "list_position([" + ", ".join(f"'{m}'" for m in P.MONTHS) + "], {0})"


def _day(y: str, m: str, d: str) -> str:
    return f"TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)"


def _number(match: str, pattern: str, group: int) -> str:
    return f"TRY_CAST(regexp_extract({match}, '{P.re2(pattern)}', {group}) AS INT)"


def _dmy(m: str) -> str:
    return _day(_YEAR.format(_number(m, P.DATE_DMY, 3)), _number(m, P.DATE_DMY, 2), _number(m, P.DATE_DMY, 1))


def _ymd(m: str) -> str:
    return _day(*(_number(m, P.DATE_YMD, g) for g in (1, 2, 3)))


def _long(m: str) -> str:
    month = _MONTH.format(f"regexp_extract({m}, '{P.re2(P.DATE_LONG)}', 2)")
    return _day(_number(m, P.DATE_LONG, 3), month, _number(m, P.DATE_LONG, 1))


def _first_date(text: str) -> str:
    one = lambda pattern, f: f"list_filter(list_transform({_all(pattern, 0, text)}, lambda m: {f('m')}), lambda d: d IS NOT NULL)[1]"
    return f"coalesce({one(P.DATE_DMY, _dmy)}, {one(P.DATE_YMD, _ymd)}, {one(P.DATE_LONG, _long)})"


def _place(pattern: str) -> str:
    """1-based place of the first match, 0 without one."""
    p = P.re2(pattern)
    body = p.removeprefix("(?i)")
    return f"CASE WHEN regexp_matches(text, '{p}') THEN length(regexp_extract(text, '(?is)^(.*?){body}', 1)) + 1 ELSE 0 END"


_SECTIONS = f"""p AS (SELECT doc_id, text, {_place(P.SELLER)} AS s, {_place(P.BUYER)} AS b FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CASE WHEN s > 0 AND b > 0 AND s < b THEN substr(text, s, b - s) WHEN s > 0 THEN substr(text, s) WHEN b > 0 THEN '' ELSE text END AS seller,
  CASE WHEN s > 0 AND b > 0 AND s < b THEN substr(text, b) WHEN s > 0 AND b > 0 THEN substr(text, b, s - b) WHEN s > 0 THEN '' WHEN b > 0 THEN substr(text, b) ELSE text END AS buyer FROM p)"""


def _name_lines(text: str) -> str:
    kept = f"list_filter(list_transform({_lines(text)}, lambda t: {_strip('t')}), lambda t: t <> '')"
    return f"list_filter({kept}, lambda t: NOT regexp_matches(t, '{P.re2(P.SELLER)}') AND NOT regexp_matches(t, '{P.re2(P.BUYER)}') AND NOT starts_with(t, 'NIP') AND NOT starts_with(t, 'REGON'))"


def _rate(text: str) -> str:
    s = f"regexp_replace(lower({_strip(text)}), '%+$', '')"
    return f"CASE WHEN {s} IN ('23', '8', '5', '0') THEN {s} WHEN {s} IN ('zw', 'zw.', 'zwolniony', 'zwolnione') THEN 'zw' WHEN {s} IN ('np', 'np.', 'nie podlega') THEN 'np' WHEN {s} IN ('oo', 'odwrotne obciążenie') THEN 'oo' END"


def _grosze(text: str) -> str:
    return f"CAST(regexp_replace({text}, '[^0-9]', '', 'g') AS BIGINT)"


_HOT = f"""{_PIXELS}, h AS (SELECT x, y, CAST(y AS BIGINT) * 1048576 + x AS id, v / 250.0 AS p FROM p WHERE v / 250.0 > 0.3),
r(x, y, id) AS (SELECT x, y, id FROM h UNION SELECT h.x, h.y, r.id FROM r JOIN h ON abs(h.x - r.x) + abs(h.y - r.y) = 1), l AS (SELECT x, y, min(id) AS component FROM r GROUP BY x, y)"""


def _kept(source: str, most: float) -> str:
    """Greedy suppression of the regions of a page (page, id, type, score, x1, y1, x2, y2), from the least sure on."""
    w, h = "(least(k.x2, n.x2) - greatest(k.x1, n.x1))", "(least(k.y2, n.y2) - greatest(k.y1, n.y1))"
    common = f"(CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0 END)"
    union = f"((k.x2 - k.x1) * (k.y2 - k.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) - {common})"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score, id DESC) AS n FROM {source}), e AS (SELECT page, n, struct_pack(id := id, kind := kind, x1 := x1, y1 := y1, x2 := x2, y2 := y2) AS s FROM o),
s(page, n, kept) AS (SELECT page, n, [s] FROM e WHERE n = 1
  UNION ALL SELECT s.page, e.n, CASE WHEN len(list_filter(s.kept, lambda k: k.kind = e.s.kind AND {common.replace('n.', 'e.s.')} > 0 AND {common.replace('n.', 'e.s.')} / {union.replace('n.', 'e.s.')} > {most})) > 0 THEN s.kept ELSE list_append(s.kept, e.s) END
  FROM s JOIN e ON e.page = s.page AND e.n = s.n + 1),
z AS (SELECT page, unnest(max_by(kept, n)) AS k FROM s GROUP BY page)"""


_SIGNS = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in DICTIONARY) + "]"
_BROKEN = {
    "issuer.nip": f"issuer.nip IS NOT NULL AND NOT {nip_sql('issuer.nip')}",
    "receiver.nip": f"receiver.nip IS NOT NULL AND NOT {nip_sql('receiver.nip')}",
    "summary.total_gross": "(summary.total_gross < 0 AND coalesce(header.invoice_type, '') <> 'correction') OR coalesce(abs(summary.total_gross - (summary.total_net + summary.total_vat)) > 0.01, false)",
    "header.invoice_number": "regexp_matches(header.invoice_number, '[^A-Za-z0-9/_-]') OR NOT regexp_matches(header.invoice_number, '[0-9]')",
    "header.due_date": "coalesce(header.due_date < header.issue_date OR header.due_date > header.issue_date + INTERVAL 120 MONTH, false)",
}
_RANGES = " UNION ALL ".join(
    f"SELECT '{leaf}' AS field, {_sql_text(leaf).replace(leaf, f'min({leaf})', 1)} AS min_value, {_sql_text(leaf).replace(leaf, f'max({leaf})', 1)} AS max_value, min(length({_sql_text(leaf)})) AS min_length, max(length({_sql_text(leaf)})) AS max_length, "
    + (f"count(*) FILTER (WHERE {leaf} IS NOT NULL AND ({_BROKEN[leaf]}))" if leaf in _BROKEN else "CAST(NULL AS BIGINT)")
    + " AS broken FROM invoices"
    for leaf in _LEAVES
)

ORACLES = {
    "regon_matches": _merged([(_all(P.REGON), 0.95), (_all(P.REGON_STANDALONE), 0.6)], _DIGITS.format("m"), regon_sql(_DIGITS.format("m"))),
    "iban_matches": _merged(
        [(_all(P.IBAN), 0.95), (_all(P.BANK_ACCOUNT, 1), 0.9)],
        f"CASE WHEN kind = 1 THEN coalesce({_first(P.IBAN, 1, 'm')}, 'PL') || {_DIGITS.format('m')} WHEN length({_DIGITS.format('m')}) = 26 THEN 'PL' || {_DIGITS.format('m')} END",
    ),
    "date_matches": _merged([(_all(P.DATE_DMY), 0.9), (_all(P.DATE_YMD), 0.9), (_all(P.DATE_LONG), 0.95)], f"CASE kind WHEN 1 THEN {_dmy('m')} WHEN 2 THEN {_ymd('m')} ELSE {_long('m')} END"),
    "dates_labelled": f"""WITH c AS (SELECT doc_id, text, {_first(P.ISSUE_DATE, 1)} AS i, {_first(P.SALE_DATE, 1)} AS s, {_first(P.DUE_DATE, 1)} AS d FROM documents)
SELECT doc_id, coalesce({_first_date('i')}, {_first_date('text')}) AS issue_date, {_first_date('s')} AS sale_date, {_first_date('d')} AS due_date FROM c""",
    "vat_rates": f"""WITH m AS (SELECT doc_id, unnest({_all(P.VAT_RATE, 1)}) AS m, unnest(range(len({_all(P.VAT_RATE, 1)}))) AS k FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, {_rate('m')} AS rate, min(k) AS k FROM m GROUP BY doc_id, rate), j AS (SELECT doc_id, string_agg(rate, ',' ORDER BY k) AS rates FROM r WHERE rate IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, coalesce(rates, '') AS rates FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id WHERE text IS NOT NULL""",
    "vat_breakdown": f"""WITH m AS (SELECT doc_id, unnest({_all(P.VAT_BREAKDOWN, 1)}) AS r, unnest({_all(P.VAT_BREAKDOWN, 2)}) AS n, unnest({_all(P.VAT_BREAKDOWN, 3)}) AS v, unnest(range(len({_all(P.VAT_BREAKDOWN, 1)}))) AS k FROM documents),
x AS (SELECT doc_id, k, {_rate('r')} AS rate, {_grosze('n')} AS net, {_grosze('v')} AS vat FROM m)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS at, rate, net, net + vat AS gross FROM x WHERE rate IS NOT NULL""",
    "party_sections": f"WITH {_SECTIONS} SELECT doc_id, CAST(length(seller) AS BIGINT) AS seller, CAST(length(buyer) AS BIGINT) AS buyer FROM c",
    "party_names": f"WITH {_SECTIONS} SELECT doc_id, coalesce({_name_lines('seller')}[1], '') AS seller, coalesce({_name_lines('buyer')}[1], '') AS buyer FROM c",
    "address_parts": f"""WITH a AS (SELECT doc_id, text, {_first(P.POSTAL_CODE, 0)} AS postal_code, {_place(P.POSTAL_CODE)} AS pos, {_first(P.STREET, 0)} AS street FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, CASE WHEN pos > 0 THEN nullif(regexp_extract({_strip(f"coalesce({_lines(_strip('substr(text, pos + 6)'))}[1], '')")}, '^[\\p{{L}}\\p{{Nl}}\\s\\x0b\\p{{Z}}\\x{{0085}}-]*', 0), '') END AS city FROM a),
c AS (SELECT *, list_filter({_name_lines('text')}, lambda t: NOT regexp_matches(t, '{P.re2(P.EMAIL)}') AND NOT regexp_matches(t, '{P.re2(P.PHONE)}'))[2:3] AS plain FROM b),
d AS (SELECT *, CASE WHEN street IS NULL AND city IS NULL AND len(plain) > 0 THEN array_to_string(plain, ', ') END AS raw FROM c)
SELECT doc_id, street, postal_code, city, coalesce(raw, concat_ws(', ', street, CASE WHEN city IS NOT NULL THEN concat_ws(' ', postal_code, city) END)) AS line, street IS NULL AND postal_code IS NULL AND city IS NULL AND raw IS NULL AS empty FROM d""",
    "human_sizes": """WITH n AS (SELECT o_orderkey, CAST(trunc(o_totalprice * o_orderkey) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN printf('%.1fGB', n / 1e9) WHEN n >= 1000000 THEN printf('%.1fMB', n / 1e6) WHEN n >= 1000 THEN printf('%.1fKB', n / 1e3) ELSE printf('%dB', n) END AS size FROM n""",
    "text_routing": """WITH p AS (SELECT DISTINCT doc_id, pdf_type, text FROM pdf_contents), o AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS ocr FROM (SELECT DISTINCT doc_id, page_no, text FROM ocr_results) GROUP BY doc_id),
j AS (SELECT coalesce(p.doc_id, o.doc_id) AS doc_id, coalesce(pdf_type, 'Image') AS kind, text, ocr FROM p FULL JOIN o ON o.doc_id = p.doc_id)
SELECT doc_id, CAST(coalesce(length(CASE WHEN kind IN ('Text', 'Hybrid') AND strlen(text) >= 50 THEN text ELSE coalesce(nullif(ocr, ''), nullif(text, '')) END), 0) AS BIGINT) AS chars FROM j""",
    "table_texts": f"""WITH RECURSIVE {_BOX}, r AS (SELECT doc_id, page_no, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM b WHERE contains(text, '|') GROUP BY doc_id, page_no),
i AS (SELECT b.doc_id, b.page_no, b.y1 AS y, coalesce(b.text, '') AS t, row_number() OVER (PARTITION BY b.doc_id, b.page_no ORDER BY b.y1, b.box_id) AS n FROM b JOIN r ON b.doc_id = r.doc_id AND b.page_no = r.page_no WHERE b.x1 BETWEEN r.x1 AND r.x2 AND b.y1 BETWEEN r.y1 AND r.y2),
s(doc_id, page_no, n, y0, line) AS (SELECT doc_id, page_no, n, y, 1 FROM i WHERE n = 1 UNION ALL
  SELECT i.doc_id, i.page_no, i.n, CASE WHEN abs(i.y - s.y0) < 15 THEN s.y0 ELSE i.y END, CASE WHEN abs(i.y - s.y0) < 15 THEN s.line ELSE s.line + 1 END FROM s JOIN i ON i.doc_id = s.doc_id AND i.page_no = s.page_no AND i.n = s.n + 1),
l AS (SELECT s.doc_id, s.page_no, s.line, string_agg(i.t, ' | ' ORDER BY i.n) AS t FROM s JOIN i ON i.doc_id = s.doc_id AND i.page_no = s.page_no AND i.n = s.n GROUP BY s.doc_id, s.page_no, s.line)
SELECT doc_id, page_no, string_agg(t, chr(10) ORDER BY line) AS text FROM l WHERE t <> '' GROUP BY doc_id, page_no""",
    "regions_kept": f"WITH RECURSIVE {_GRID}, f AS (SELECT page, region_id AS id, region_type AS kind, confidence AS score, x1, y1, x2, y2 FROM g), {_kept('f', 0.1)} SELECT page, k.id AS region_id FROM z",
    "detector_rows": f"""WITH RECURSIVE {_GRID}, f AS (SELECT page, region_id AS id, coalesce(['text', 'title', 'list', 'table', 'figure'][region_id % 6 + 1], 'unknown') AS kind, confidence AS score, least(greatest(x1 / 1.25, 0), 640) AS x1, least(greatest(y1 / 1.25, 0), 480) AS y1,
  least(greatest(x2 / 1.25, 0), 640) AS x2, least(greatest(y2 / 1.25, 0), 480) AS y2 FROM g WHERE confidence >= 0.5), {_kept('f', 0.5)}
SELECT page, k.id AS region_id, k.kind AS region_type, round(k.x1, 3) AS x1, round(k.y1, 3) AS y1, round(k.x2, 3) AS x2, round(k.y2, 3) AS y2 FROM z""",
    "table_html": f"""WITH {_CELLS}, f AS (SELECT table_id, row, col, min_by(row_span, ord) AS rs, min_by(col_span, ord) AS cs, min_by(content, ord) AS content FROM c GROUP BY table_id, row, col),
t AS (SELECT *, CASE WHEN row = 0 THEN 'th' ELSE 'td' END AS tag FROM f),
r AS (SELECT table_id, row, string_agg('    <' || tag || CASE WHEN rs > 1 THEN ' rowspan="' || rs || '"' ELSE '' END || CASE WHEN cs > 1 THEN ' colspan="' || cs || '"' ELSE '' END || '>' || coalesce(content, '') || '</' || tag || '>' || chr(10), '' ORDER BY col) AS x FROM t GROUP BY table_id, row)
SELECT table_id, '<table>' || chr(10) || string_agg('  <tr>' || chr(10) || x || '  </tr>' || chr(10), '' ORDER BY row) || '</table>' AS html FROM r GROUP BY table_id""",
    "token_cells": """WITH RECURSIVE p AS (SELECT l_orderkey, flatten(list([5, 3, CAST(l_linenumber % 4 + 6 AS INT), CAST(trunc(l_quantity % 3 + 20) AS INT), 4, 3, 4, 6] ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS t FROM lineitem GROUP BY l_orderkey),
s(l_orderkey, i, t, cells, r, c, most, opened, cs) AS (SELECT l_orderkey, 0, t, 0, 0, 0, 0, false, 1 FROM p UNION ALL
  SELECT l_orderkey, i + 1, t, CASE WHEN t[i + 1] = 4 AND opened THEN cells + 1 ELSE cells END, CASE WHEN t[i + 1] = 6 THEN r + 1 ELSE r END, CASE WHEN t[i + 1] = 5 THEN 0 WHEN t[i + 1] = 4 AND opened THEN c + cs ELSE c END,
  CASE WHEN t[i + 1] = 6 THEN greatest(most, c) ELSE most END, CASE WHEN t[i + 1] = 3 THEN true WHEN t[i + 1] = 4 THEN false ELSE opened END, CASE WHEN t[i + 1] = 3 THEN 1 WHEN t[i + 1] BETWEEN 7 AND 19 THEN least(greatest(t[i + 1] - 7, 1), 10) ELSE cs END FROM s WHERE i < len(t))
SELECT l_orderkey, CAST(cells AS BIGINT) AS cells, CAST(greatest(r, 1) AS BIGINT) AS rows, CAST(greatest(most, 1) AS BIGINT) AS cols FROM s WHERE i = len(t)""",
    "ctc_texts": f"""WITH {_STEPS}, b AS (SELECT vec_id, list_transform(steps, lambda s: list_position(s, list_max(s)) - 1) AS k, list_transform(steps, lambda s: 1 / list_sum(list_transform(s, lambda v: exp(CAST(v - list_max(s) AS DOUBLE))))) AS p FROM e),
u AS (SELECT vec_id, unnest(range(1, len(k) + 1)) AS i, k, p FROM b), f AS (SELECT vec_id, i, k[i] AS c, p[i] AS p, coalesce(k[i - 1], 0) AS prev FROM u), g AS (SELECT * FROM f WHERE c <> 0 AND c <> prev),
t AS (SELECT vec_id, string_agg({_SIGNS}[c + 1], '' ORDER BY i) AS text, round(avg(p), 4) AS confidence FROM g GROUP BY vec_id)
SELECT b.vec_id, coalesce(t.text, '') AS text, coalesce(t.confidence, 0.0) AS confidence FROM b LEFT JOIN t ON t.vec_id = b.vec_id""",
    "detection_boxes": f"""WITH RECURSIVE {_HOT}, c AS (SELECT component, min(l.x) AS ax, max(l.x) AS bx, min(l.y) AS ay, max(l.y) AS y9, avg(p) AS score, count(*) AS pixels FROM l JOIN h ON h.x = l.x AND h.y = l.y GROUP BY component)
SELECT component, round(greatest(ax - (bx - ax) * 0.25, 0), 3) AS x1, round(greatest(ay - (y9 - ay) * 0.25, 0), 3) AS y1, round(bx + (bx - ax) * 0.25, 3) AS x2, round(y9 + (y9 - ay) * 0.25, 3) AS y2, round(score, 3) AS score, pixels FROM c WHERE pixels >= 10 AND score >= 0.6""",
    "resize_dims": """WITH d AS (SELECT p_partkey, CAST(p_size * 60 + 1 AS INT) AS w, CAST(p_partkey % 2000 + 1 AS INT) AS h FROM part), s AS (SELECT *, greatest(w, h) AS m, CAST(960 AS FLOAT) / CAST(greatest(w, h) AS FLOAT) AS k FROM d)
SELECT p_partkey, CASE WHEN m <= 960 THEN w ELSE greatest(CAST(trunc(CAST(w AS FLOAT) * k) AS BIGINT), 1) END AS w, CASE WHEN m <= 960 THEN h ELSE greatest(CAST(trunc(CAST(h AS FLOAT) * k) AS BIGINT), 1) END AS h FROM s""",
    "p4_profile_whole": f"""
WITH c AS ({_LEAF_CELLS}), v AS (SELECT field, value, count(*) AS n FROM c GROUP BY field, value), r AS ({_RANGES}),
p AS (SELECT field, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS nulls,
  round(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) / sum(n), 6) AS null_rate, count(value) AS distinct_values,
  abs(round(log2(sum(n) FILTER (WHERE value IS NOT NULL)) - sum(n * log2(n)) FILTER (WHERE value IS NOT NULL) / sum(n) FILTER (WHERE value IS NOT NULL), 4)) AS entropy FROM v GROUP BY field)
SELECT p.*, r.min_value, r.max_value, CAST(r.min_length AS INT) AS min_length, CAST(r.max_length AS INT) AS max_length, r.broken FROM p JOIN r ON r.field = p.field""",
}
