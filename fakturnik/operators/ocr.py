"""Recognition of page images: detection, crops, angles, text, layout and reading order, one image a row.

The steps of one image depend on each other's pixels, so they run together inside an Arrow batch, with one
model session per worker; nothing is collected, and an image that fails has its error in its row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Ocr
from . import images as I
from .layout import REGIONS, TEXT_REGIONS
from .recognition import DICTIONARY, _session

#: A model: the path of an ONNX file, or a function from one input tensor to the list of outputs.
Model = str | Callable[[np.ndarray], list[np.ndarray]]

BOX = "struct<bbox:array<float>,text:string,detection_score:float,recognition_score:float,angle:int>"
REGION = "struct<region_type:string,x1:float,y1:float,x2:float,y2:float,confidence:float>"
CHANNELS = {1: "gray", 3: "bgr", 4: "bgra"}


@dataclass(frozen=True)
class Engine:
    """The models of a recognition run; only detection is needed for boxes, the others where their step is on."""

    detection: Model | None = None
    recognition: Model | None = None
    classification: Model | None = None
    layout: Model | None = None
    layout_classes: str = "publaynet"
    signs: tuple[str, ...] = tuple(DICTIONARY)
    options: Ocr = field(default_factory=Ocr)


def run_model(model: Model, tensor: np.ndarray) -> list[np.ndarray]:
    if callable(model):
        return [np.asarray(y) for y in model(tensor)]
    session = _session(model)
    return session.run(None, {session.get_inputs()[0].name: tensor})


def decoded(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(h, w, 3) in red, green, blue from the bytes of Spark's image source."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def map_boxes(prob: np.ndarray, least: float = 0.3, box_least: float = 0.6, min_pixels: int = 10, unclip: float = 1.5) -> tuple[list[list[float]], list[float]]:
    """Corner values and scores of the boxes of a probability map, as ``images.detection_boxes`` finds them in a table of pixels."""
    labels = I.labelled(prob > least)
    boxes, scores = [], []
    ys, xs = np.nonzero(labels)
    own = labels[ys, xs]
    for k in np.unique(own):
        y, x = ys[own == k], xs[own == k]
        score = float(prob[y, x].mean())
        if len(x) < min_pixels or score < box_least:
            continue
        dx, dy = (x.max() - x.min()) * (unclip - 1) / 2, (y.max() - y.min()) * (unclip - 1) / 2
        x1, y1, x2, y2 = max(x.min() - dx, 0.0), max(y.min() - dy, 0.0), x.max() + dx, y.max() + dy
        boxes.append([x1, y1, x2, y1, x2, y2, x1, y2])
        scores.append(score)
    return boxes, scores


def unscaled(quad: list[float], sx: float, sy: float, width: int, height: int) -> list[float]:
    """Corner values of a scaled image in the image itself, clipped to it."""
    return [float(min(max(v / (sx, sy)[i % 2], 0), (width, height)[i % 2])) for i, v in enumerate(quad)]


def decode_steps(steps: np.ndarray, signs: tuple[str, ...]) -> tuple[str, float]:
    """Text and confidence of class scores by step (see ``recognition.ctc``)."""
    best = steps.argmax(axis=1)
    share = 1 / np.exp(steps - steps.max(axis=1, keepdims=True)).sum(axis=1)
    before = np.concatenate([[0], best[:-1]])
    kept = (best != 0) & (best != before) & (best < len(signs))
    return "".join(signs[k] for k in best[kept]), float(share[kept].mean()) if kept.any() else 0.0


def read_image(image: np.ndarray, engine: Engine) -> list[tuple]:
    """The text boxes of an image: (bbox, text, detection score, recognition score, angle)."""
    o = engine.options
    if engine.detection is None:
        raise ValueError("no detection model")
    h, w = image.shape[:2]
    if o.enable_detection:
        tensor, sx, sy = I.detection_tensor(image, o.max_image_size)
        quads, scores = map_boxes(run_model(engine.detection, tensor)[0][0, 0], o.detection_threshold)
        quads = [unscaled(q, sx, sy, w, h) for q in quads]
    else:
        quads, scores = [[0.0, 0.0, w, 0.0, w, h, 0.0, h]], [1.0]
    out = []
    for q, s in zip(quads, scores, strict=True):
        part, turn, text, sure = I.crop(image, q), 0, "", 0.0
        if engine.classification is not None and o.enable_classification:
            a = np.ravel(run_model(engine.classification, I.plain_tensor(part, 192, 48))[0])
            turn = 0 if a[0] > a[1] else 180
            part = part[::-1, ::-1] if turn else part
        if engine.recognition is not None and o.enable_recognition:
            text, sure = decode_steps(run_model(engine.recognition, I.recognition_tensor(part))[0][0], engine.signs)
        if sure >= o.recognition_threshold or not o.enable_recognition:
            out.append(([float(v) for v in q], text if o.keep_unk else text.replace("[UNK]", " "), float(s), sure, turn))
    # Reading order: by line of 20 pixels, then from left to right.
    return sorted(out, key=lambda b: (int(min(b[0][1::2]) / 20), min(b[0][0::2])))


def suppressed(regions: list[tuple], most: float = 0.5) -> list[tuple]:
    """Regions that no less sure region of their type overlaps by more than ``most`` (see ``layout.suppress``)."""
    kept: list[tuple] = []

    def iou(p: tuple, q: tuple) -> float:
        w, h = min(p[3], q[3]) - max(p[1], q[1]), min(p[4], q[4]) - max(p[2], q[2])
        common = w * h if w > 0 and h > 0 else 0.0
        union = (p[3] - p[1]) * (p[4] - p[2]) + (q[3] - q[1]) * (q[4] - q[2]) - common
        return common / union if union > 0 else 0.0

    for r in sorted(regions, key=lambda r: r[5]):
        if not any(k[0] == r[0] and iou(k, r) > most for k in kept):
            kept.append(r)
    return kept


def find_regions(image: np.ndarray, engine: Engine, side: tuple[int, int] = (608, 800), least: float = 0.5) -> list[tuple]:
    """Layout regions of an image from a model that gives rows of class, score and corners; none without a model."""
    if engine.layout is None:
        return []
    h, w = image.shape[:2]
    names, sx, sy = REGIONS[engine.layout_classes], side[0] / w, side[1] / h
    found = []
    for c, s, *xy in np.asarray(run_model(engine.layout, I.plain_tensor(image, *side))[0]).reshape(-1, 6).tolist():
        if s >= least:
            x1, y1, x2, y2 = (min(max(v / (sx, sy)[i % 2], 0.0), float((w, h)[i % 2])) for i, v in enumerate(xy))
            found.append((names[int(c)] if 0 <= c < len(names) else "unknown", x1, y1, x2, y2, s))
    return suppressed(found)


def recognize(images: DataFrame, engine: Engine, key: str = "origin") -> DataFrame:
    """(key, width, height, boxes, regions, text, error) of images (key, height, width, nChannels, data)."""
    names = ("bbox", "text", "detection_score", "recognition_score", "angle")
    sides = ("region_type", "x1", "y1", "x2", "y2", "confidence")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, h, w, n, data in pdf[[key, "height", "width", "nChannels", "data"]].itertuples(index=False):
                boxes, regions, error = [], [], None
                try:
                    image = decoded(bytes(data), h, w, n)
                    boxes = read_image(image, engine)
                    # Without a layout the text still counts.
                    try:
                        regions = find_regions(image, engine)
                    except Exception:  # noqa: BLE001
                        regions = []
                except Exception as e:  # noqa: BLE001  a broken image must not stop the others
                    error = f"{type(e).__name__}: {e}"
                rows.append((k, w, h, [dict(zip(names, b, strict=True)) for b in boxes], [dict(zip(sides, r, strict=True)) for r in regions], "\n".join(b[1] for b in boxes), error))
            yield pd.DataFrame(rows, columns=[key, "width", "height", "boxes", "regions", "text", "error"])

    schema = f"{key} {images.schema[key].dataType.simpleString()}, width int, height int, boxes array<{BOX}>, regions array<{REGION}>, text string, error string"
    return images.select(key, "height", "width", "nChannels", "data").mapInPandas(run, schema)


def recognized_text(text: Column, boxes: Column) -> Column:
    """The text that was set, else the texts of the boxes, one a line."""
    return F.coalesce(F.nullif(text, F.lit("")), F.array_join(F.transform(boxes, lambda b: b.text), "\n"))


def region_groups(regions: Column) -> dict[str, Column]:
    """tables, text_regions and figures of a page's regions."""
    only = lambda *kinds: F.filter(regions, lambda r: r.region_type.isin(*kinds))
    return {"tables": only("table"), "text_regions": only(*TEXT_REGIONS), "figures": only("figure")}
