"""Recognition output: CTC decoding, dictionaries, angles, scoring with a model file."""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import argmax

#: Blank, digits, Latin letters, Polish letters, punctuation and symbols, in class order.
DICTIONARY = list(" " + string.digits + string.ascii_uppercase + string.ascii_lowercase + "ĄąĆćĘęŁłŃńÓóŚśŹźŻż" + ".,;:!?-_/\\()[]{}<>@#$%^&*+=|~`'\" " + "€£¥§©®°²³½¼¾")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, ch) of a dictionary file: the blank, then the first sign of each filled line; a file of some hundred lines."""
    whole = spark.read.text(path, wholetext=True)  # one file of some hundred lines is one row
    signs = F.transform(F.filter(F.split("value", r"\r?\n"), lambda t: t != ""), lambda t: F.substring(t, 1, 1))
    return whole.select(F.posexplode(F.concat(F.array(F.lit(" ")), signs)).alias("idx", "ch"))


def ctc(steps: Column, signs: list[str] | None = None) -> Column:
    """struct<text, confidence> of class scores by step: the best class of each, less blanks (0) and repeats of the step before.

    The confidence is the mean softmax share of the kept steps, 0 without any; classes beyond the dictionary are left out.
    """
    table = F.array(*[F.lit(c) for c in (signs or DICTIONARY)])
    best = F.transform(steps, lambda s: F.struct(argmax(s).cast("int").alias("k"), (F.lit(1.0) / F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp((v - F.array_max(s)).cast("double")))).alias("p")))
    before = F.concat(F.array(F.lit(0)), F.transform(best, lambda b: b.k))
    marked = F.transform(best, lambda b, i: F.struct(b.k.alias("k"), b.p.alias("p"), F.get(before, i).alias("prev")))
    kept = F.filter(marked, lambda b: (b.k != 0) & (b.k != b.prev) & F.get(table, b.k).isNotNull())
    n = F.size(kept)
    mean = F.when(n > 0, F.aggregate(kept, F.lit(0.0), lambda a, b: a + b.p) / n).otherwise(0.0)
    return F.struct(F.array_join(F.transform(kept, lambda b: F.get(table, b.k)), "").alias("text"), mean.alias("confidence"))


def angle(scores: Column) -> Column:
    """0 if the first score is the larger, else 180."""
    return F.when(F.get(scores, F.lit(0)) > F.get(scores, F.lit(1)), F.lit(0)).otherwise(F.lit(180))


def needs_turn(angle_: Column, confidence: Column) -> Column:
    return (angle_ == 180) & (confidence > 0.9)


def page_text(boxes: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """Text of a page: boxes recognised well enough in reading order, one a line; unknown signs as blanks."""
    from .layout import reading_order

    sure = boxes.filter(F.coalesce(F.col("recognition_score"), F.lit(0.0)) >= least)
    ranked = reading_order(sure, keys)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.replace(F.col("text"), F.lit("[UNK]"), F.lit(" ")).alias("t")))), lambda x: x.t), "\n")
    return ranked.groupBy(*keys).agg(text.alias("text"))


def polygon_box(points: Column) -> Column:
    """The first four points of a polygon as eight values, filled with zeros."""
    flat = F.flatten(F.slice(points, 1, 4))
    return F.slice(F.concat(flat, F.array_repeat(F.lit(0.0), 8)), 1, 8)


@lru_cache(maxsize=2)
def _session(path: str):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # a task has one core
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


#: Tensors in one call of a model at most.
CALL = 16


def score(df: DataFrame, key: str, tensor: str, model_path: str) -> DataFrame:
    """(key, shape, data): the first output of an ONNX model for a struct<shape, data> column, one session per worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = _session(model_path)
        name = session.get_inputs()[0].name
        free = not isinstance((session.get_inputs()[0].shape or [1])[0], int)  # the model takes any number at once
        for pdf in batches:
            shapes, datas = [None] * len(pdf), [None] * len(pdf)
            together: dict[tuple, list[int]] = {}  # tensors of one shape (but for their first side) go in one call
            tensors = [np.asarray(x["data"], dtype=np.float32).reshape(list(x["shape"])) for x in pdf[tensor]]
            for i, x in enumerate(tensors):
                together.setdefault((free, *x.shape[1:]) if free and x.shape[:1] == (1,) else (i,), []).append(i)
            for at in together.values():
                for some in (at[k : k + CALL] for k in range(0, len(at), CALL)):
                    y = np.asarray(session.run(None, {name: np.concatenate([tensors[i] for i in some])})[0], dtype=np.float32)
                    parts = np.split(y, len(some)) if len(some) > 1 else [y]
                    for i, part in zip(some, parts, strict=True):
                        shapes[i], datas[i] = list(part.shape), part.ravel()
            yield pd.DataFrame({key: pdf[key], "shape": shapes, "data": datas})

    return df.select(key, tensor).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, shape array<int>, data array<float>")
