"""Queries over boxes, regions, tables, recognition output and pixels, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images, layout, recognition, tables
from ..runtime import table

PAGE = ["doc_id", "page_no"]


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = layout.quad(F.col("bbox"))
    rows = table(spark, sf_dir, "text_boxes").dropDuplicates(["doc_id", "box_id"])
    return rows.select(*PAGE, "box_id", "text", "recognition_score", *[q[c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])


def _regions(boxes: DataFrame) -> DataFrame:
    """The table region of a page: what encloses its lines with cell bars."""
    cells = boxes.filter(F.contains(F.col("text"), F.lit("|")))
    return cells.groupBy(*PAGE).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).withColumn("region_id", F.lit(1))


def quad_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = layout.quad(F.col("bbox"))
    rows = table(spark, sf_dir, "text_boxes").dropDuplicates(["doc_id", "box_id"])
    return rows.select("doc_id", "box_id", *[F.round(q[c].cast("double"), 2).alias(c) for c in ("x1", "y1", "x2", "y2")])


def boxes_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return layout.boxes_in_regions(boxes, _regions(boxes), PAGE).select("doc_id", "page_no", "box_id")


def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each table region, line by line, from the boxes that lie in it."""
    boxes = _boxes(spark, sf_dir)
    return layout.line_texts(layout.boxes_in_regions(boxes, _regions(boxes), PAGE), PAGE)


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_boxes(spark, sf_dir), PAGE).select("doc_id", "box_id", F.col("rank").cast("bigint").alias("rank"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.page_text(_boxes(spark, sf_dir), PAGE, least=0.5).select(*PAGE, F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions on pages, derived from the parts."""
    k = F.col("p_partkey")
    x, y = (k * 37 % 800).cast("double"), (k * 53 % 600).cast("double")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 12).cast("bigint").alias("page"), k.alias("region_id"), layout.region_type(k % 5).alias("region_type"), (k * 7919 % 1009 / 1009.0).alias("confidence"),
        x.alias("x1"), y.alias("y1"), (x + 40 + F.col("p_size") * 4).alias("x2"), (y + 30 + F.col("p_size") * 3).alias("y2"),
    )


def region_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.overlap_pairs(_grid(spark, sf_dir), ["page"]).select("page", "region_a", "region_b", F.round("iou", 6).alias("iou"))


def region_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    return g.groupBy("region_type", layout.is_table(F.col("region_type")).alias("is_table"), layout.is_text(F.col("region_type")).alias("is_text")).agg(
        F.count(F.lit(1)).alias("regions"), F.sum(layout.area(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).cast("bigint").alias("area")
    )


def region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.region_order(_grid(spark, sf_dir), ["page"]).select("page", "region_id", F.col("rank").cast("bigint").alias("rank"))


def regions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.suppress(_grid(spark, sf_dir), ["page"], 0.1).select("page", "region_id")


def detector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grid(spark, sf_dir).select("page", "region_id", (F.col("region_id") % 6).alias("class_id"), F.col("confidence").alias("score"), "x1", "y1", "x2", "y2")
    return layout.detections(rows, ["page"], 1.25, 1.25, 640.0, 480.0).select("page", "region_id", "region_type", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 10).cast("bigint").alias("table_id"), k.alias("ord"), (k * 7 % 5).cast("int").alias("row"), (k * 11 % 4).cast("int").alias("col"), (1 + k % 2).cast("int").alias("row_span"),
        (1 + F.floor(k / 3) % 2).cast("int").alias("col_span"), F.col("p_brand").alias("content"),
    )


def grid_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    size = cells.select("table_id").distinct().withColumns({"rows": F.lit(5), "cols": F.lit(4)})
    return tables.dense_grid(cells, size).select("table_id", "row", "col", "content")


def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cell_at(_cells(spark, sf_dir), F.lit(2), F.lit(1))


def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).groupBy("table_id", "row", "col").agg(F.min_by("row_span", "ord").alias("row_span"), F.min_by("col_span", "ord").alias("col_span"), F.min_by("content", "ord").alias("content"))
    return tables.html(cells)


def token_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of token sequences made from the line items of an order: a row each, with spans by quantity."""
    part = F.array(F.lit(5), F.lit(3), (F.col("l_linenumber") % 4 + 6).cast("int"), (F.col("l_quantity") % 3 + 20).cast("int"), F.lit(4), F.lit(3), F.lit(4), F.lit(6))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", part.alias("t")).alias("x"))
    tokens = rows.groupBy("l_orderkey").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda r: r.t)).alias("tokens"))
    out = tokens.select("l_orderkey", tables.decode_tokens(F.concat("tokens", F.array(F.lit(2), F.lit(5)))).alias("d"))
    return out.select("l_orderkey", F.size("d.cells").cast("bigint").alias("cells"), F.col("d.rows").cast("bigint").alias("rows"), F.col("d.cols").cast("bigint").alias("cols"))


def _steps(spark: SparkSession, sf_dir: str):
    """Embeddings read as scores: steps of eight classes."""
    rows = table(spark, sf_dir, "embeddings")
    n = F.floor(F.size("embedding") / 8).cast("int")
    return rows.select("vec_id", "embedding", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("steps"))


def argmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", tables.argmax(F.col("embedding")).cast("bigint").alias("best"))


def structure_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("vec_id", F.array_join(F.transform(tables.structure_tokens(F.col("steps")), lambda t: t.cast("string")), ",").alias("tokens"))


def ctc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _steps(spark, sf_dir).select("vec_id", recognition.ctc(F.col("steps")).alias("r"))
    return out.select("vec_id", "r.text", F.round("r.confidence", 4).alias("confidence"))


def two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.slice("embedding", 1, 2)
    share = F.round(F.get(tables.softmax(F.transform(pair, lambda v: v.cast("double"))), F.lit(0)), 6)
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", tables.table_kind(pair).alias("kind"), recognition.angle(pair).alias("angle"), share.alias("share"), recognition.needs_turn(recognition.angle(pair), 1 - share).alias("turn"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image of 40 pixels a row whose values are the sizes of the parts."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit(1).alias("img_id"), (k % 40).cast("int").alias("x"), F.floor(k / 40).cast("int").alias("y"), (F.col("p_size") * 5).cast("int").alias("v"))


def local_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.adaptive_threshold(_pixels(spark, sf_dir)).select("x", "y", "v")


def pixel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.components(_pixels(spark, sf_dir).filter("v > 90")).groupBy("component").agg(F.count(F.lit(1)).alias("pixels"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))


def detection_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prob = _pixels(spark, sf_dir).withColumn("p", F.col("v") / 250.0)
    return images.detection_boxes(prob).select("component", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2", "score")], "pixels")


def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = images.resized((F.col("p_size") * 60 + 1).cast("int"), (F.col("p_partkey") % 2000 + 1).cast("int"), 960)
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", F.col("r.w").cast("bigint").alias("w"), F.col("r.h").cast("bigint").alias("h"))


def clipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    return g.select("region_id", layout.clip(F.col("x2"), 0.0, 600.0).alias("x2"), layout.clip(F.col("y2"), 0.0, 400.0).alias("y2"))


QUERIES = {
    f.__name__: f
    for f in (
        quad_geometry, boxes_in_tables, table_texts, reading_order, page_texts, region_overlaps, region_kinds, region_order, regions_kept, detector_rows, grid_dense, cell_lookup, table_html, token_cells,
        argmax_scores, structure_steps, ctc_texts, two_way, local_threshold, pixel_components, detection_boxes, resize_dims, clipped_boxes,
    )
}

_BOX = """b AS (SELECT DISTINCT doc_id, page_no, box_id, text, recognition_score AS score, CAST(least(bbox[1], bbox[3], bbox[5], bbox[7]) AS DOUBLE) AS x1, CAST(least(bbox[2], bbox[4], bbox[6], bbox[8]) AS DOUBLE) AS y1,
  CAST(greatest(bbox[1], bbox[3], bbox[5], bbox[7]) AS DOUBLE) AS x2, CAST(greatest(bbox[2], bbox[4], bbox[6], bbox[8]) AS DOUBLE) AS y2 FROM text_boxes)"""
_GRID = """g AS (SELECT p_partkey // 12 AS page, p_partkey AS region_id, ['text', 'title', 'list', 'table', 'figure'][p_partkey % 5 + 1] AS region_type, (p_partkey * 7919 % 1009) / 1009.0 AS confidence,
  CAST(p_partkey * 37 % 800 AS DOUBLE) AS x1, CAST(p_partkey * 53 % 600 AS DOUBLE) AS y1, CAST(p_partkey * 37 % 800 + 40 + p_size * 4 AS DOUBLE) AS x2, CAST(p_partkey * 53 % 600 + 30 + p_size * 3 AS DOUBLE) AS y2 FROM part)"""
_CELLS = """c AS (SELECT p_partkey // 10 AS table_id, p_partkey AS ord, CAST(p_partkey * 7 % 5 AS INT) AS row, CAST(p_partkey * 11 % 4 AS INT) AS col, CAST(1 + p_partkey % 2 AS INT) AS row_span, CAST(1 + (p_partkey // 3) % 2 AS INT) AS col_span, p_brand AS content FROM part)"""
_PIXELS = "p AS (SELECT CAST(p_partkey % 40 AS INT) AS x, CAST(p_partkey // 40 AS INT) AS y, p_size * 5 AS v FROM part)"
_INSIDE = f"""WITH {_BOX}, r AS (SELECT doc_id, page_no, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM b WHERE contains(text, '|') GROUP BY doc_id, page_no),
i AS (SELECT b.* FROM b JOIN r ON b.doc_id = r.doc_id AND b.page_no = r.page_no WHERE b.x1 BETWEEN r.x1 AND r.x2 AND b.y1 BETWEEN r.y1 AND r.y2)"""
_STEPS = "e AS (SELECT vec_id, list_transform(range(len(embedding) // 8), lambda i: list_slice(embedding, i * 8 + 1, i * 8 + 8)) AS steps FROM embeddings)"

ORACLES = {
    "quad_geometry": f"WITH {_BOX} SELECT doc_id, box_id, round(x1, 2) AS x1, round(y1, 2) AS y1, round(x2, 2) AS x2, round(y2, 2) AS y2 FROM b",
    "boxes_in_tables": _INSIDE + " SELECT doc_id, page_no, box_id FROM i",
    "reading_order": f"WITH {_BOX} SELECT doc_id, box_id, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CAST(trunc(y1 / 20) AS INT), x1, box_id) AS rank FROM b",
    "page_texts": f"""WITH {_BOX}, s AS (SELECT doc_id, page_no, string_agg(replace(text, '[UNK]', ' '), chr(10) ORDER BY CAST(trunc(y1 / 20) AS INT), x1, box_id) AS t FROM b WHERE coalesce(score, 0) >= 0.5 GROUP BY doc_id, page_no)
SELECT doc_id, page_no, md5(t) AS digest, CAST(length(t) AS BIGINT) AS chars FROM s""",
    "region_overlaps": f"""WITH {_GRID}, o AS (SELECT a.page, a.region_id AS region_a, b.region_id AS region_b, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS common,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS total FROM g a JOIN g b ON a.page = b.page AND a.region_id < b.region_id AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1)
SELECT page, region_a, region_b, round(common / (total - common), 6) AS iou FROM o""",
    "region_kinds": f"WITH {_GRID} SELECT region_type, region_type = 'table' AS is_table, region_type IN ('text', 'title', 'list') AS is_text, count(*) AS regions, CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS area FROM g GROUP BY region_type",
    "region_order": f"WITH {_GRID} SELECT page, region_id, row_number() OVER (PARTITION BY page ORDER BY floor(y1 / 50), x1, region_id) AS rank FROM g",
    "grid_dense": f"""WITH {_CELLS}, s AS (SELECT table_id, ord, content, unnest(range(row, row + row_span)) AS r, col, col_span FROM c), t AS (SELECT table_id, ord, content, r, unnest(range(col, col + col_span)) AS c FROM s)
SELECT table_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, max_by(content, ord) AS content FROM t WHERE r < 5 AND c < 4 GROUP BY table_id, r, c""",
    "cell_lookup": f"WITH {_CELLS} SELECT table_id, min_by(content, ord) AS content FROM c WHERE 2 >= row AND 2 < row + row_span AND 1 >= col AND 1 < col + col_span GROUP BY table_id",
    "argmax_scores": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings",
    "structure_steps": f"WITH {_STEPS} SELECT vec_id, array_to_string(list_transform(steps, lambda s: list_position(s, list_max(s)) - 1), ',') AS tokens FROM e",
    "two_way": """WITH p AS (SELECT vec_id, embedding[1] AS a, embedding[2] AS b, round(1 / (1 + exp(CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE))), 6) AS share FROM embeddings)
SELECT vec_id, CASE WHEN a > b THEN 'wired' ELSE 'lineless' END AS kind, CASE WHEN a > b THEN 0 ELSE 180 END AS angle, share, NOT (a > b) AND 1 - share > 0.9 AS turn FROM p""",
    "local_threshold": f"""WITH {_PIXELS} SELECT a.x, a.y, CASE WHEN any_value(a.v) > CAST(floor(sum(b.v) / count(*)) AS INT) - 5 THEN 255 ELSE 0 END AS v FROM p a JOIN p b ON b.x BETWEEN a.x - 7 AND a.x + 7 AND b.y BETWEEN a.y - 7 AND a.y + 7 GROUP BY a.x, a.y""",
    "pixel_components": f"""WITH RECURSIVE {_PIXELS}, h AS (SELECT x, y, CAST(y AS BIGINT) * 1048576 + x AS id FROM p WHERE v > 90),
r(x, y, id) AS (SELECT x, y, id FROM h UNION SELECT h.x, h.y, r.id FROM r JOIN h ON abs(h.x - r.x) + abs(h.y - r.y) = 1),
l AS (SELECT x, y, min(id) AS component FROM r GROUP BY x, y)
SELECT component, count(*) AS pixels, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM l GROUP BY component""",
    "clipped_boxes": f"WITH {_GRID} SELECT region_id, least(greatest(x2, 0.0), 600.0) AS x2, least(greatest(y2, 0.0), 400.0) AS y2 FROM g",
}
