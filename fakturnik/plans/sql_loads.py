"""SQL counterparts of the comparison of loads and of the cases of broken values and departing loads."""

from __future__ import annotations

from .quality import _JUDGED, _sql_text
from .sql import _BROKEN

_MEASURE = {
    "summary.total_gross": "CASE WHEN summary.total_gross <> 0 THEN round(log10(abs(CAST(summary.total_gross AS DOUBLE))), 1) END",
    "header.due_date": "CAST(date_diff('day', header.issue_date, header.due_date) AS DOUBLE)",
}
_ROWS = " UNION ALL ".join(f"SELECT '{f}' AS field, CAST(load_id AS BIGINT) AS load, {_sql_text(f)} AS value, {_MEASURE.get(f, 'CAST(NULL AS DOUBLE)')} AS m FROM invoices" for f in _JUDGED)
_SHAPE = "regexp_replace(regexp_replace(regexp_replace(value, '[0-9]+', '9', 'g'), '\\p{Lu}+', 'A', 'g'), '\\p{Ll}+', 'a', 'g')"

#: CTEs up to ``ms``: field, load, rows, null_share, top_share, middle, apart.
_MEASURES = f"""c AS ({_ROWS}), v AS (SELECT field, load, value, count(*) AS n FROM c GROUP BY field, load, value),
b AS (SELECT field, load, CAST(sum(n) AS BIGINT) AS rows, coalesce(sum(n) FILTER (WHERE value IS NULL), 0) / sum(n) AS null_share, max(n) FILTER (WHERE value IS NOT NULL) / sum(n) FILTER (WHERE value IS NOT NULL) AS top_share FROM v GROUP BY field, load),
mid AS (SELECT field, load, quantile_cont(m, 0.5) AS middle FROM c WHERE m IS NOT NULL GROUP BY field, load),
sh AS (SELECT field, load, {_SHAPE} AS s, n FROM v WHERE value IS NOT NULL), sg AS (SELECT field, load, CASE WHEN length(s) <= 40 THEN s ELSE left(s, 40) || sha256(s) END AS shape, sum(n) AS n FROM sh GROUP BY field, load, shape),
kn AS (SELECT field, load, sum(n) AS known FROM sg GROUP BY field, load), sr AS (SELECT field, load, shape, n / known AS share FROM sg JOIN kn USING (field, load)), us AS (SELECT DISTINCT field, shape, shape AS kept FROM sr WHERE share >= 0.02),
po AS (SELECT field, load, coalesce(kept, '0') AS shape, sum(share) AS share FROM sr LEFT JOIN us USING (field, shape) GROUP BY 1, 2, 3), gr AS (SELECT k.field, k.load, s.shape, coalesce(p.share, 0) AS share FROM kn k JOIN (SELECT DISTINCT field, shape FROM po) s ON s.field = k.field LEFT JOIN po p ON p.field = k.field AND p.load = k.load AND p.shape = s.shape),
md AS (SELECT field, shape, quantile_cont(share, 0.5) AS usual FROM gr GROUP BY field, shape), ap AS (SELECT field, load, sum(abs(share - usual)) / 2 AS apart FROM gr JOIN md USING (field, shape) GROUP BY field, load),
ms AS (SELECT b.*, middle, apart FROM b LEFT JOIN mid USING (field, load) LEFT JOIN ap USING (field, load))"""


def _share(c: str) -> str:
    return f"(abs({c} - u_{c}) > 0.1 AND abs({c} - u_{c}) > 6 * d_{c} AND abs({c} - u_{c}) > 5 * sqrt(greatest(u_{c} * (1 - u_{c}), 0.01) / rows))"


_NAMES = ("null_share", "top_share", "middle")
#: CTEs up to ``dep``: field, load, departs.
_DEPARTURES = f"""{_MEASURES}, u AS (SELECT field, {', '.join(f'quantile_cont({c}, 0.5) AS u_{c}' for c in _NAMES)} FROM ms GROUP BY field), mu AS (SELECT * FROM ms JOIN u USING (field)),
d AS (SELECT field, {', '.join(f'quantile_cont(abs({c} - u_{c}), 0.5) * 1.4826 AS d_{c}' for c in _NAMES)} FROM mu GROUP BY field), al AS (SELECT * FROM mu JOIN d USING (field)),
dep AS (SELECT field, load, concat_ws(',', CASE WHEN {_share('null_share')} THEN 'nulls' END, CASE WHEN {_share('top_share')} THEN 'repetition' END, CASE WHEN apart > 0.25 THEN 'notation' END,
  CASE WHEN abs(middle - u_middle) >= CASE WHEN field LIKE '%\\_date' ESCAPE '\\' THEN 21 ELSE 0.7 END AND abs(middle - u_middle) > 8 * d_middle THEN 'range' END) AS departs FROM al)"""
_VALUES = " UNION ALL ".join(f"SELECT '{f}' AS field, 'value' AS kind, row_id AS ref_id FROM invoices WHERE {f} IS NOT NULL AND ({_BROKEN[f]})" for f in _JUDGED)

ORACLES = {
    "p4_load_measures": f"WITH {_MEASURES} SELECT field, load, rows, round(null_share, 6) AS null_share, round(top_share, 6) AS top_share, round(middle, 6) AS middle, round(apart, 6) AS apart FROM ms",
    "p4_load_changes": f"WITH {_DEPARTURES} SELECT field, load, departs FROM dep WHERE departs <> ''",
    "p4_found": f"WITH {_DEPARTURES} SELECT DISTINCT * FROM ({_VALUES} UNION ALL SELECT field, 'load', load FROM dep WHERE departs <> '' AND field <> 'receiver.nip')",
}
