"""Queries over single values and accessors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import dates as D
from ..functions import identifiers as N
from ..functions import parties as Q
from ..functions import patterns as P
from ..operators import layout, profile, recognition, tables
from ..runtime import spread, table
from ..sources import sinks
from .extraction import ORACLES as _EXTRACTION
from .pages import _CELLS, _GRID, _cells, _grid
from .quality import ORACLES as _QUALITY
from .sql import ORACLES as _TEXT
from .sql import _all, _first, _first_date


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first date, NIP and REGON of every document."""
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", D.iso_date(t).alias("day"), N.first_nip(t).alias("nip"), N.first_regon(t).alias("regon"))


def first_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", (A.first_amount(F.col("text")) * 100).cast("bigint").alias("grosze"))


def priced_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _docs(spark, sf_dir).select("doc_id", F.posexplode(A.priced(F.col("text"))).alias("at", "m"))
    return out.select("doc_id", F.col("at").cast("bigint").alias("at"), (F.col("m.value") * 100).cast("bigint").alias("grosze"), "m.currency")


def rate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAT rates of the line items' tax in tenths as shown to people, with their share."""
    code = F.get(F.array(*map(F.lit, ("23", "8", "5", "0", "zw", "np", "oo", "17", "7"))), F.round(F.col("l_tax") * 100).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(code.alias("code"))
    return rows.groupBy(A.rate_text(F.col("code")).alias("shown"), (A.rate_share(F.col("code")) * 100).cast("bigint").alias("percent")).agg(F.count(F.lit(1)).alias("rows"))


def payment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", Q.payment_method(F.col("text")).alias("method"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the data rows from left to right."""
    rows = tables.data_rows(_cells(spark, sf_dir))
    return rows.select("table_id", "row", F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c.col, c.content)), ",").alias("cells"))


def cell_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanning cells of the first row and of the first column."""
    cells = _cells(spark, sf_dir)
    named = tables.header(cells).withColumn("of", F.lit("header")).unionByName(tables.column_of(cells, 0).withColumn("of", F.lit("first column")))
    return named.groupBy("of", tables.spans_rows(F.col("row_span")).alias("rows"), tables.spans_columns(F.col("col_span")).alias("cols")).agg(F.count(F.lit(1)).alias("cells"))


def region_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text regions with their size, and whether they hold the middle of the page."""
    g, r = layout.text_regions(_grid(spark, sf_dir)), {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    return g.select("region_id", *[v.alias(k) for k, v in layout.region_size(r).items()], layout.holds(r, F.lit(400.0), F.lit(300.0)).alias("middle"))


def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tables_of(_grid(spark, sf_dir)).select("page", "region_id")


def clipped_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the text boxes within 600 by 400, as whole numbers."""
    rows = table(spark, sf_dir, "text_boxes").select("doc_id", "box_id", "bbox").distinct()
    q = layout.clip_quad(F.col("bbox"), F.lit(600), F.lit(400))
    return rows.select("doc_id", "box_id", F.array_join(F.transform(q, lambda v: F.floor(v).cast("string")), ",").alias("corners"))


def quad_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle and edge lengths of the text boxes."""
    q = layout.quad(F.transform("bbox", lambda v: v.cast("double")))
    rows = table(spark, sf_dir, "text_boxes").dropDuplicates(["doc_id", "box_id"])
    return rows.select("doc_id", "box_id", *[F.round(q[c], 2).alias(c) for c in ("cx", "cy", "width", "height")])


def polygon_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first corners of the text boxes as polygons of three points, filled to eight values."""
    rows = table(spark, sf_dir, "text_boxes").select("doc_id", "box_id", "bbox").distinct()
    points = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice(F.transform("bbox", lambda v: v.cast("double")), i * 2 + 1, 2))
    return rows.select("doc_id", "box_id", F.array_join(F.transform(recognition.polygon_box(points), lambda v: F.floor(v).cast("string")), ",").alias("corners"))


def model_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of files of the sizes of the parts against an expected size of 50."""
    from ..models import status

    actual = F.when(F.col("p_partkey") % 10 > 0, F.col("p_size"))
    return table(spark, sf_dir, "part").groupBy(status(F.lit(50), actual).alias("state")).agg(F.count(F.lit(1)).alias("files"))


def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("in/doc"), F.col("doc_id"), F.lit(".pdf"))
    return sinks.failures(_docs(spark, sf_dir).select(path.alias("path"), F.when(F.col("text").isNull(), F.lit("no text")).alias("error")))


def p4_profile_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile after every load came and the last load was withdrawn again."""
    rows = table(spark, sf_dir, "invoices")
    fields = profile.leaf_fields(rows.schema)
    last = F.col("load_id") == rows.agg(F.max("load_id")).first()[0]
    store = profile.CountStore(spark)
    store.commit(profile.counts(rows.filter(~last), fields))
    gone = profile.counts(rows.filter(last), fields)
    store.commit(gone)
    out = profile.profile(store.commit(gone, sign=-1), fields)
    return out.select("field", "rows", "nulls", "null_rate", "distinct_values", F.col("min_text").alias("min_value"), F.col("max_text").alias("max_value"), "entropy")


QUERIES = {
    f.__name__: f
    for f in (
        first_values, first_amounts, priced_amounts, rate_texts, payment_labels, table_rows, cell_spans, region_sizes, table_regions, clipped_quads, quad_sizes, polygon_boxes, model_states, failed_files, p4_profile_revised,
    )
}

_METHOD = _first(P.PAYMENT_METHOD, 1)
ORACLES = {
    "first_values": f"""WITH n AS ({_EXTRACTION['nip_matches']}), r AS ({_TEXT['regon_matches']}) SELECT d.doc_id, strftime({_first_date('d.text')}, '%Y-%m-%d') AS day, n.value AS nip, r.value AS regon FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id AND n.at = 0 LEFT JOIN r ON r.doc_id = d.doc_id AND r.at = 0""",
    "first_amounts": f"""WITH m AS (SELECT doc_id, unnest({_all(P.AMOUNT, 1)}) AS w, unnest({_all(P.AMOUNT, 2)}) AS c, unnest(range(len({_all(P.AMOUNT, 1)}))) AS k FROM documents),
g AS (SELECT * FROM m WHERE regexp_full_match(replace(replace(w, ' ', ''), chr(160), ''), '[0-9]+')), f AS (SELECT doc_id, min_by(w || c, k) AS v FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(regexp_replace(v, '[^0-9]', '', 'g') AS BIGINT) AS grosze FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
    "priced_amounts": f"""WITH m AS (SELECT doc_id, unnest({_all(P.AMOUNT_WITH_CURRENCY, 1)}) AS w, unnest({_all(P.AMOUNT_WITH_CURRENCY, 2)}) AS c, unnest({_all(P.AMOUNT_WITH_CURRENCY, 3)}) AS currency, unnest(range(len({_all(P.AMOUNT_WITH_CURRENCY, 1)}))) AS k FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS at, CAST(regexp_replace(w || c, '[^0-9]', '', 'g') AS BIGINT) AS grosze, currency FROM m WHERE regexp_full_match(replace(replace(w, ' ', ''), chr(160), ''), '[0-9]+')""",
    "rate_texts": """WITH c AS (SELECT ['23', '8', '5', '0', 'zw', 'np', 'oo', '17', '7'][CAST(round(l_tax * 100) AS INT) + 1] AS code FROM lineitem)
SELECT CASE WHEN regexp_full_match(code, '[0-9]+') THEN code || '%' WHEN code IN ('zw', 'np') THEN code || '.' ELSE code END AS shown, coalesce(TRY_CAST(code AS BIGINT), 0) AS percent, count(*) AS rows FROM c GROUP BY 1, 2""",
    "payment_labels": f"""WITH m AS (SELECT doc_id, lower({_METHOD}) AS m FROM documents)
SELECT doc_id, CASE WHEN m IS NULL THEN NULL WHEN regexp_matches(m, 'przelew|transfer|bank') THEN 'transfer' WHEN regexp_matches(m, 'gotówk|cash|gotowk') THEN 'cash' WHEN regexp_matches(m, 'kart|card') THEN 'card' WHEN regexp_matches(m, 'kompensat|barter') THEN 'compensation' ELSE 'other:' || m END AS method FROM m""",
    "table_rows": f"WITH {_CELLS} SELECT table_id, row, string_agg(col || ':' || content, ',' ORDER BY col, ord) AS cells FROM c WHERE row > 0 GROUP BY table_id, row",
    "cell_spans": f"""WITH {_CELLS}, n AS (SELECT 'header' AS of, * FROM c WHERE row = 0 UNION ALL SELECT 'first column', * FROM c WHERE col = 0) SELECT of, row_span > 1 AS rows, col_span > 1 AS cols, count(*) AS cells FROM n GROUP BY 1, 2, 3""",
    "region_sizes": f"WITH {_GRID} SELECT region_id, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, 400 BETWEEN x1 AND x2 AND 300 BETWEEN y1 AND y2 AS middle FROM g WHERE region_type IN ('text', 'title', 'list')",
    "table_regions": f"WITH {_GRID} SELECT page, region_id FROM g WHERE region_type = 'table'",
    "clipped_quads": """WITH b AS (SELECT DISTINCT doc_id, box_id, bbox FROM text_boxes), u AS (SELECT doc_id, box_id, unnest(range(1, 9)) AS i, bbox FROM b)
SELECT doc_id, box_id, string_agg(CAST(CAST(floor(least(greatest(bbox[i], 0), CASE WHEN i % 2 = 1 THEN 600 ELSE 400 END)) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS corners FROM u GROUP BY doc_id, box_id""",
    "quad_sizes": """WITH b AS (SELECT DISTINCT doc_id, box_id, list_transform(bbox, lambda v: CAST(v AS DOUBLE)) AS q FROM text_boxes)
SELECT doc_id, box_id, round((q[1] + q[3] + q[5] + q[7]) / 4, 2) AS cx, round((q[2] + q[4] + q[6] + q[8]) / 4, 2) AS cy, round(sqrt((q[3] - q[1]) * (q[3] - q[1]) + (q[4] - q[2]) * (q[4] - q[2])), 2) AS width, round(sqrt((q[7] - q[1]) * (q[7] - q[1]) + (q[8] - q[2]) * (q[8] - q[2])), 2) AS height FROM b""",
    "polygon_boxes": """WITH b AS (SELECT DISTINCT doc_id, box_id, bbox FROM text_boxes) SELECT doc_id, box_id, array_to_string(list_transform(bbox[1:6], lambda v: CAST(CAST(floor(v) AS BIGINT) AS VARCHAR)), ',') || ',0,0' AS corners FROM b""",
    "model_states": "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'missing' WHEN p_size * 2 < 50 THEN 'incomplete' ELSE 'ok' END AS state, count(*) AS files FROM part GROUP BY 1",
    "failed_files": "SELECT 'doc' || doc_id || '.pdf' AS filename, 'no text' AS error FROM documents WHERE text IS NULL",
    "p4_profile_revised": _QUALITY["p4_profile"].replace("FROM invoices", "FROM (SELECT * FROM invoices WHERE load_id < (SELECT max(load_id) FROM invoices))"),
}
