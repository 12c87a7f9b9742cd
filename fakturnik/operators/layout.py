"""Geometry of text boxes and page regions: predicates, joins, reading order, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Class names of the two region models, by class id.
REGIONS = {
    "publaynet": ("text", "title", "list", "table", "figure"),
    "cdla": ("text", "figure", "text", "table", "text", "title", "text", "text", "text"),
}
TEXT_REGIONS = ("text", "title", "list")


def region_type(class_id: Column, model: str = "publaynet") -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, REGIONS[model])), class_id.cast("int")), F.lit("unknown"))


def is_table(kind: Column) -> Column:
    return kind == "table"


def is_text(kind: Column) -> Column:
    return kind.isin(*TEXT_REGIONS)


def quad(bbox: Column) -> dict[str, Column]:
    """Centre, edge lengths and enclosing rectangle of a quadrilateral of eight values."""
    at = lambda i: F.get(bbox, F.lit(i))
    xs, ys = [at(i) for i in (0, 2, 4, 6)], [at(i) for i in (1, 3, 5, 7)]
    edge = lambda i: F.sqrt((at(i) - at(0)) * (at(i) - at(0)) + (at(i + 1) - at(1)) * (at(i + 1) - at(1)))
    return {
        "cx": (xs[0] + xs[1] + xs[2] + xs[3]) / 4, "cy": (ys[0] + ys[1] + ys[2] + ys[3]) / 4, "width": edge(2), "height": edge(6),
        "x1": F.least(*xs), "y1": F.least(*ys), "x2": F.greatest(*xs), "y2": F.greatest(*ys),
    }


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def region_size(r) -> dict[str, Column]:
    """width, height and area of a struct with x1, y1, x2, y2."""
    return {"width": r["x2"] - r["x1"], "height": r["y2"] - r["y1"], "area": area(r["x1"], r["y1"], r["x2"], r["y2"])}


def holds(r, x: Column, y: Column) -> Column:
    """Whether a region holds a point, edges included."""
    return x.between(r["x1"], r["x2"]) & y.between(r["y1"], r["y2"])


def tables_of(regions: DataFrame) -> DataFrame:
    return regions.filter(is_table(F.col("region_type")))


def text_regions(regions: DataFrame) -> DataFrame:
    return regions.filter(is_text(F.col("region_type")))


def overlaps(a: str, b: str) -> Column:
    """Whether two regions (aliases with x1, y1, x2, y2) share more than an edge."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x1") < c(b, "x2")) & (c(a, "x2") > c(b, "x1")) & (c(a, "y1") < c(b, "y2")) & (c(a, "y2") > c(b, "y1"))


def iou(p, q) -> Column:
    """Intersection over union of two structs with x1, y1, x2, y2; 0 if they are apart or the union is empty."""
    w = F.least(p["x2"], q["x2"]) - F.greatest(p["x1"], q["x1"])
    h = F.least(p["y2"], q["y2"]) - F.greatest(p["y1"], q["y1"])
    common = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = area(p["x1"], p["y1"], p["x2"], p["y2"]) + area(q["x1"], q["y1"], q["x2"], q["y2"]) - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(0.0)


def clip(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clip_quad(bbox: Column, width: Column, height: Column) -> Column:
    """The eight corner values, each within the image."""
    return F.transform(bbox, lambda v, i: F.least(F.greatest(v, F.lit(0.0).cast("float")), F.when(i % 2 == 0, width).otherwise(height).cast("float")))


def boxes_in_regions(boxes: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes whose upper left corner lies in a region of the same page, edges included; once for each region that holds it."""
    b, r = boxes.alias("b"), regions.alias("r")
    same = [F.col(f"b.{k}") == F.col(f"r.{k}") for k in keys]
    inside = F.col("b.x1").between(F.col("r.x1"), F.col("r.x2")) & F.col("b.y1").between(F.col("r.y1"), F.col("r.y2"))
    cond = inside
    for s in same:
        cond = s & cond
    return b.join(r, cond).select("b.*", F.col("r.region_id").alias("region_id"))


def overlap_pairs(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping pairs of regions of one page with their share of overlap, smaller id first."""
    a, b = regions.alias("a"), regions.alias("b")
    cond = (F.col("a.region_id") < F.col("b.region_id")) & overlaps("a", "b")
    for k in keys:
        cond = (F.col(f"a.{k}") == F.col(f"b.{k}")) & cond
    box = lambda t: {c: F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2")}
    return a.join(b, cond).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.region_id").alias("region_a"), F.col("b.region_id").alias("region_b"), iou(box("a"), box("b")).alias("iou"))


def reading_order(boxes: DataFrame, keys: list[str], line_height: float = 20.0, tie: str = "box_id") -> DataFrame:
    """Boxes with their rank in reading order: by line of ``line_height``, then from left to right."""
    w = Window.partitionBy(*keys).orderBy((F.col("y1") / line_height).cast("int"), "x1", tie)
    return boxes.withColumn("rank", F.row_number().over(w))


def region_order(regions: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.floor(F.col("y1") / 50), "x1", "region_id")
    return regions.withColumn("rank", F.row_number().over(w))


def line_texts(boxes: DataFrame, keys: list[str], gap: float = 15.0, cell: str = " | ") -> DataFrame:
    """Text of each page's boxes: sorted by height, a line takes what is less than ``gap`` from its first box."""
    sorted_boxes = F.sort_array(F.collect_list(F.struct(F.col("y1").cast("double").alias("y"), F.col("box_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(acc: Column, b: Column) -> Column:
        same = acc.y.isNotNull() & (F.abs(b.y - acc.y) < gap)
        joined = F.when(acc.line == "", b.t).otherwise(F.concat(acc.line, F.lit(cell), b.t))
        closed = F.when(acc.line == "", acc.lines).otherwise(F.array_append(acc.lines, acc.line))
        return F.struct(F.when(same, acc.y).otherwise(b.y).alias("y"), F.when(same, acc.lines).otherwise(closed).alias("lines"), F.when(same, joined).otherwise(b.t).alias("line"))

    done = lambda acc: F.array_join(F.when(acc.line == "", acc.lines).otherwise(F.array_append(acc.lines, acc.line)), "\n")
    return boxes.groupBy(*keys).agg(sorted_boxes.alias("_b")).select(*keys, F.aggregate("_b", start, step, done).alias("text"))


def suppress(regions: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Greedy suppression per page: regions are visited from the least sure on, and one that overlaps a kept region of its type by more than ``threshold`` goes.

    A page's regions are few (a detector's output), so one page is one array.
    """
    item = F.struct(F.col("confidence"), (-F.col("region_id")).alias("o"), "region_id", "region_type", "x1", "y1", "x2", "y2")
    kind = "array<struct<confidence:double,o:bigint,region_id:bigint,region_type:string,x1:double,y1:double,x2:double,y2:double>>"

    def step(kept: Column, r: Column) -> Column:
        beaten = F.exists(kept, lambda k: (k.region_type == r.region_type) & (iou(k, r) > threshold))
        return F.when(beaten, kept).otherwise(F.array_append(kept, r))

    pages = regions.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).cast(kind).alias("_r"))
    kept = F.aggregate("_r", F.array().cast(kind), step)
    return pages.select(*keys, F.explode(kept).alias("k")).select(*keys, "k.region_id", "k.region_type", "k.confidence", "k.x1", "k.y1", "k.x2", "k.y2")


def detections(rows: DataFrame, keys: list[str], scale_x: float, scale_y: float, width: float, height: float, model: str = "publaynet", least: float = 0.5) -> DataFrame:
    """Regions from a detector's rows (class_id, score, x1, y1, x2, y2): sure ones, scaled, clipped, named and suppressed."""
    found = rows.filter(F.col("score") >= least).select(
        *keys, "region_id", region_type(F.col("class_id"), model).alias("region_type"), F.col("score").cast("double").alias("confidence"),
        clip(F.col("x1") / scale_x, 0.0, width).alias("x1"), clip(F.col("y1") / scale_y, 0.0, height).alias("y1"), clip(F.col("x2") / scale_x, 0.0, width).alias("x2"), clip(F.col("y2") / scale_y, 0.0, height).alias("y2"),
    )
    return suppress(found, keys)
