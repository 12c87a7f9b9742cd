"""Registry of recognition models: which files a variant has, and which of them are in place."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of the two variants with their usual sizes in bytes.
FILES = {
    "mobile": (("det.onnx", 4_500_000), ("latin_rec.onnx", 7_500_000), ("latin_dict.txt", 2_000)),
    "server": (("det.onnx", 84_000_000), ("latin_rec.onnx", 7_500_000), ("latin_dict.txt", 2_000)),
}


def status(expected: Column, actual: Column) -> Column:
    """missing, ok, or incomplete for a file of under half its usual size."""
    return F.when(actual.isNull(), "missing").when(actual * 2 < expected, "incomplete").otherwise("ok")


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """(variant, filename, expected_bytes, actual_bytes, status) of all files under ``folder``/variant."""
    rows = []
    for variant, files in FILES.items():
        for name, size in files:
            path = os.path.join(folder, variant, name)
            rows.append((variant, name, size, os.path.getsize(path) if os.path.exists(path) else None))
    df = spark.createDataFrame(rows, "variant string, filename string, expected_bytes bigint, actual_bytes bigint")
    return df.withColumn("status", status(F.col("expected_bytes"), F.col("actual_bytes")))


def active(folder: str) -> str:
    """The variant in use; mobile unless another was chosen."""
    path = os.path.join(folder, "active_variant")
    name = open(path).read().strip() if os.path.exists(path) else ""
    return name if name in FILES else "mobile"


def use(folder: str, variant: str) -> None:
    if variant not in FILES:
        raise ValueError(f"unknown variant {variant}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "active_variant"), "w") as f:
        f.write(variant)


def clean(folder: str, variant: str) -> list[str]:
    """Deletes the files of a variant and gives their paths."""
    if variant not in FILES:
        raise ValueError(f"unknown variant {variant}")
    there = [p for name, _ in FILES[variant] if os.path.exists(p := os.path.join(folder, variant, name))]
    for p in there:
        os.remove(p)
    return there
