"""Pixels: sizes, tensors, local thresholds, connected components, detection boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def resized(width: Column, height: Column, target: int) -> Column:
    """struct<w, h>: unchanged up to the target, else scaled to it, cut to whole pixels, one at least."""
    longest = F.greatest(width, height)
    scale = (F.lit(float(target)) / longest.cast("double")).cast("float")  # single precision, as the sizes are cut by it
    side = lambda v: F.when(longest <= target, v).otherwise(F.greatest((v.cast("float") * scale).cast("float").cast("int"), F.lit(1)))
    return F.struct(side(width).cast("int").alias("w"), side(height).cast("int").alias("h"))


def adaptive_threshold(pixels: DataFrame, block: int = 15, c: int = 5, key: str = "img_id") -> DataFrame:
    """255 where a pixel exceeds the whole mean of its block less c, else 0; the block is clipped at the borders.

    The block sum is separable: a sum along x, then a sum of sums along y.
    """
    half = block // 2
    along_x = Window.partitionBy(key, "y").orderBy("x").rangeBetween(-half, half)
    along_y = Window.partitionBy(key, "x").orderBy("y").rangeBetween(-half, half)
    sums = pixels.withColumn("sx", F.sum("v").over(along_x)).withColumn("nx", F.count("v").over(along_x))
    sums = sums.withColumn("s", F.sum("sx").over(along_y)).withColumn("n", F.sum("nx").over(along_y))
    mean = F.floor(F.col("s") / F.col("n")).cast("int")
    return sums.select(key, "x", "y", F.when(F.col("v") > mean - c, 255).otherwise(0).alias("v"))


def enhance(pixels: DataFrame, key: str = "img_id") -> DataFrame:
    """(key, x, y, v) of colour pixels (key, x, y, r, g, b): grey by the usual weights of luma, then the local threshold of 15 and 5."""
    grey = (F.col("r") * 2126 + F.col("g") * 7152 + F.col("b") * 722) / 10000
    return adaptive_threshold(pixels.select(key, "x", "y", F.floor(grey).cast("int").alias("v")), 15, 5, key)


#: Runs of pixels up to which an image is labelled inside one task; larger ones are labelled by rounds of joins.
IMAGE_RUNS = 500_000


def labelled(mask: np.ndarray) -> np.ndarray:
    """1-based numbers of the 4-connected components of a mask (0 outside), by a union of the runs of neighbouring rows."""
    out = np.zeros(mask.shape, dtype=np.int64)
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, a = np.nonzero(step == 1)
    b = np.nonzero(step == -1)[1] - 1
    root = runs_united(y, a, b)
    number = np.unique(root, return_inverse=True)[1] + 1
    for k in range(len(y)):
        out[y[k], a[k] : b[k] + 1] = number[k]
    return out


def runs_united(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For runs (row, first and last column) in order of row and column, the number of the first run of each one's component."""
    root = list(range(len(y)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    above = begin = 0  # runs of the row above still to be compared, first run of this row
    for k in range(len(y)):
        if k and y[k] != y[k - 1]:
            above, begin = (begin if y[k] == y[k - 1] + 1 else k), k
        at = above
        while at < begin and a[at] <= b[k]:
            if b[at] >= a[k]:
                p, q = find(at), find(k)
                root[max(p, q)] = min(p, q)
            if b[at] <= b[k]:
                above = at + 1 if at == above and b[at] < a[k] else above
            at += 1
    return np.array([find(k) for k in range(len(y))], dtype=np.int64)


def components(points: DataFrame, key: str = "img_id") -> DataFrame:
    """(key, x, y, component) of 4-connected points: the smallest y * 2^20 + x of the component.

    Points are first folded to runs along x. An image of up to IMAGE_RUNS runs is labelled in one task, many
    images at a time; a larger one by labels that travel between touching runs of neighbouring rows and jump
    to the label of the label, so the rounds grow with the logarithm of the longest path.
    """
    line = Window.partitionBy(key, "y").orderBy("x")
    runs = points.select(key, "x", "y").distinct().withColumn("g", F.col("x") - F.row_number().over(line))
    runs = runs.groupBy(key, "y", "g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    runs = cut(runs.withColumn("id", F.col("y").cast("bigint") * (1 << 20) + F.col("a")), "runs")
    large = runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs")).filter(F.col("runs") > IMAGE_RUNS).select(key)

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "a"], ignore_index=True)
        first = runs_united(pdf["y"].to_numpy(), pdf["a"].to_numpy(), pdf["b"].to_numpy())
        return pdf.assign(label=pdf["id"].to_numpy()[first])

    kind = points.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, y {runs.schema['y'].dataType.simpleString()}, a {runs.schema['a'].dataType.simpleString()}, b {runs.schema['b'].dataType.simpleString()}, id bigint, label bigint"
    done = runs.join(large, key, "left_anti").select(key, "y", "a", "b", "id").groupBy(key).applyInPandas(image, schema)
    if not large.isEmpty():
        rest = cut(runs.join(large, key, "left_semi"), "runs")
        done = done.unionByName(_by_rounds(rest, key).select(key, "y", "a", "b", "id", "label"))
    return done.select(key, F.explode(F.sequence("a", "b")).alias("x"), "y", F.col("label").alias("component"))


def _by_rounds(runs: DataFrame, key: str) -> DataFrame:
    """The runs of large images with the label of their component."""
    p, q = runs.alias("p"), runs.alias("q")
    touch = (F.col(f"p.{key}") == F.col(f"q.{key}")) & (F.col("p.y") + 1 == F.col("q.y")) & (F.col("p.a") <= F.col("q.b")) & (F.col("p.b") >= F.col("q.a"))
    edges = p.join(q, touch).select(F.col(f"p.{key}").alias(key), F.col("p.id").alias("u"), F.col("q.id").alias("w"))
    edges = cut(edges.unionByName(edges.select(key, F.col("w").alias("u"), F.col("u").alias("w"))), "touching")
    labels = runs.select(key, "id", F.col("id").alias("label"))
    while True:
        near = edges.join(labels.select(key, F.col("id").alias("w"), F.col("label").alias("other")), [key, "w"]).groupBy(key, F.col("u").alias("id")).agg(F.min("other").alias("other"))
        far = labels.select(key, F.col("id").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, [key, "id"], "left").join(far, [key, "label"], "left").select(key, "id", F.least("label", "other", "far").alias("next"), F.col("label"))
        new = cut(new, "labels")
        labels = new.select(key, "id", F.col("next").alias("label"))
        if new.filter("next <> label").isEmpty():
            break
    return runs.join(labels, [key, "id"])


def detection_boxes(prob: DataFrame, least: float = 0.3, box_least: float = 0.6, min_pixels: int = 10, unclip: float = 1.5, key: str = "img_id", scale: tuple[float, float] = (1.0, 1.0), size: tuple[float, float] | None = None) -> DataFrame:
    """Boxes of a probability map: components of pixels over ``least``, big and sure enough, spread by ``unclip``.

    ``scale`` is what the image was scaled by; the boxes come out in the image itself, clipped to its ``size``.
    """
    hot = prob.filter(F.col("p") > least)
    whole = components(hot, key).join(hot, [key, "x", "y"])
    boxes = whole.groupBy(key, "component").agg(F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by"), F.avg("p").alias("score"), F.count(F.lit(1)).alias("pixels"))
    boxes = boxes.filter((F.col("pixels") >= min_pixels) & (F.col("score") >= box_least))
    dx, dy = (F.col("bx") - F.col("ax")) * ((unclip - 1) / 2), (F.col("by") - F.col("ay")) * ((unclip - 1) / 2)
    sx, sy = scale
    ends = [F.greatest(F.col("ax") - dx, F.lit(0.0)) / sx, F.greatest(F.col("ay") - dy, F.lit(0.0)) / sy, (F.col("bx") + dx) / sx, (F.col("by") + dy) / sy]
    if size:
        ends = [F.least(F.greatest(v, F.lit(0.0)), F.lit(float(size[i % 2]))) for i, v in enumerate(ends)]
    return boxes.select(key, "component", *[v.alias(n) for v, n in zip(ends, ("x1", "y1", "x2", "y2"), strict=True)], "score", "pixels")


# --- Tensors, used inside Arrow batches ---------------------------------------------------------------

IMAGENET = (np.array([0.485, 0.456, 0.406], dtype=np.float32), np.array([0.229, 0.224, 0.225], dtype=np.float32))


def stretch(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize of an array (h, w, channels)."""
    h, w = image.shape[:2]
    ys, xs = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, h - 1), np.clip(np.floor(xs).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None, None], np.clip(xs - x0, 0, 1)[None, :, None]
    f = image.astype(np.float32)
    return (f[y0][:, x0] * (1 - fy) + f[y1][:, x0] * fy) * (1 - fx) + (f[y0][:, x1] * (1 - fy) + f[y1][:, x1] * fy) * fx


def detection_tensor(image: np.ndarray, side: int = 960, step: int = 32) -> tuple[np.ndarray, float, float]:
    """(1, 3, h, w) with ImageNet normalisation, sides up to ``side`` and filled with zeros to multiples of ``step``; and the scales."""
    h, w = image.shape[:2]
    k = min(1.0, side / max(h, w))
    nw, nh = max(1, int(w * k)), max(1, int(h * k))
    out = np.zeros((3, -(-nh // step) * step, -(-nw // step) * step), dtype=np.float32)
    out[:, :nh, :nw] = ((stretch(image, nw, nh) / 255 - IMAGENET[0]) / IMAGENET[1]).transpose(2, 0, 1)
    return out[None], nw / w, nh / h


def recognition_tensor(image: np.ndarray, height: int = 48, most: int = 320) -> np.ndarray:
    """(1, 3, 48, 320) in -1..1, the aspect kept, filled with zeros to the right."""
    h, w = image.shape[:2]
    nw = max(1, min(most, int(w * height / h)))
    out = np.zeros((3, height, most), dtype=np.float32)
    out[:, :, :nw] = ((stretch(image, nw, height) / 255 - 0.5) / 0.5).transpose(2, 0, 1)
    return out[None]


def plain_tensor(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """(1, 3, height, width) stretched, in -1..1."""
    return ((stretch(image, width, height) / 255 - 0.5) / 0.5).transpose(2, 0, 1)[None].astype(np.float32)


def padded_tensor(image: np.ndarray, side: int = 488) -> np.ndarray:
    """(1, 3, side, side): the image scaled into a white square, in its middle, with ImageNet normalisation."""
    h, w = image.shape[:2]
    k = side / max(h, w)
    nw, nh = max(1, int(w * k)), max(1, int(h * k))
    canvas = np.full((side, side, 3), 255, dtype=np.float32)
    top, left = (side - nh) // 2, (side - nw) // 2
    canvas[top : top + nh, left : left + nw] = stretch(image, nw, nh)
    return ((canvas / 255 - IMAGENET[0]) / IMAGENET[1]).transpose(2, 0, 1)[None].astype(np.float32)


def crop(image: np.ndarray, quad: list[float]) -> np.ndarray:
    """The enclosing rectangle of a quadrilateral, clipped to the image, one pixel at least."""
    h, w = image.shape[:2]
    x1, x2 = max(0, int(min(quad[0::2]))), min(w, int(max(quad[0::2])))
    y1, y2 = max(0, int(min(quad[1::2]))), min(h, int(max(quad[1::2])))
    x1, y1 = min(x1, w - 1), min(y1, h - 1)
    return image[y1 : max(y2, y1 + 1), x1 : max(x2, x1 + 1)]
