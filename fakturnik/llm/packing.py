"""Filling containers of fixed capacity with texts measured in tokens, by harmonic packing.

A text larger than the capacity is cut into pieces of exactly the capacity and a rest; nothing else is
cut. Lengths fall into the reciprocal classes (C/(k+1), C/k]; a container of class k takes k items of
its class. What a container then leaves free is filled with items of the smaller classes, the largest
that fits first, so that the classes that come later have less to place. Items are spread by a hash over
shards of bounded size, and each shard is packed by itself: one task holds at most a few shards, whatever
the size of the corpus, and each shard leaves at most a few containers partly filled.

Defined cases: null and empty texts have no tokens and no container (container_id null, tokens 0); a
repeated row is an item of its own only if its doc_id differs (of several texts of one doc_id the largest
size counts); more than KINDS kinds of container are refused; ties in
length go by doc_id and piece; no rows or no containers give an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread
from .encode import token_counts

#: Items that one shard holds on average.
SHARD_ITEMS = 20_000


#: Kinds of container at most; each multiplies the items.
KINDS = 100


def kinds_of(containers: DataFrame) -> list[tuple[str, int]]:
    rows = containers.select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity")).filter("capacity > 0").distinct().limit(KINDS + 1).collect()
    if len(rows) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of container")
    return sorted((r["container_kind"], r["capacity"]) for r in rows)


def pieces(sizes: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """One row per container kind and piece: container_kind, capacity, doc_id, piece, start, tokens."""
    options = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in kinds]) if kinds else F.array().cast("array<struct<container_kind:string,capacity:int>>")
    each = sizes.select("*", F.inline(options))  # every document is packed once for each kind
    count = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")).cast("int"))
    out = each.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("piece") * F.col("capacity")
    return out.withColumn("start", start).withColumn("tokens", F.least(F.col("capacity"), F.col("tokens") - start))


def fill(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item (sorted by falling length) under harmonic packing with filled gaps."""
    n = len(lengths)
    where = np.full(n, -1, dtype=np.int64)
    # Free items by rising length: position p in `order` is item n-1-p, since the items come by falling length.
    free_len = lengths[::-1].tolist()
    free_item = list(range(n - 1, -1, -1))
    bins = 0
    while free_len:
        longest = free_len[-1]
        k = max(1, capacity // longest)
        room = capacity
        for _ in range(k):  # k items of the class of the longest free item
            if not free_len or capacity // free_len[-1] > k and _ > 0:
                break
            room -= free_len.pop()
            where[free_item.pop()] = bins
        while free_len and room >= free_len[0]:  # fill what is left
            at = bisect.bisect_right(free_len, room) - 1
            room -= free_len.pop(at)
            where[free_item.pop(at)] = bins
        bins += 1
    return where


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, start, tokens): every piece with its container."""
    kinds = kinds_of(containers)
    items = cut(pieces(sizes, kinds), "pieces")
    shards = max(1, math.ceil(items.count() / (max(1, len(kinds)) * SHARD_ITEMS)))
    empty = items.filter("tokens = 0").select("container_kind", F.lit(None).cast("string").alias("container_id"), "doc_id", "piece", "start", "tokens")
    full = items.filter("tokens = capacity").select(
        "container_kind", F.concat_ws("-", F.lit("full"), F.col("doc_id"), F.col("piece")).alias("container_id"), "doc_id", "piece", "start", "tokens"
    )
    rest = items.filter("tokens > 0 AND tokens < capacity").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        at = fill(pdf["tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
        pdf["container_id"] = [f"{s}-{b}" for s, b in zip(pdf["shard"], at, strict=True)]
        return pdf[["container_kind", "container_id", "doc_id", "piece", "start", "tokens"]]

    packed = rest.groupBy("container_kind", "shard").applyInPandas(one, "container_kind string, container_id string, doc_id bigint, piece int, start int, tokens int")
    return packed.unionByName(full).unionByName(empty)


def pack_texts(documents: DataFrame, containers: DataFrame, path: str | None = None) -> DataFrame:
    # Texts are measured where they stand; repeated rows meet as sizes.
    sizes = token_counts(spread(documents.select("doc_id", "text")), path=path)
    return pack(sizes.groupBy("doc_id").agg(F.max("tokens").alias("tokens")), containers)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container kind: containers, items, tokens and the share of the room that is used."""
    each = packed.filter("container_id IS NOT NULL").groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("i"))
    out = each.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("i").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    capacity = F.coalesce(*[F.when(F.col("container_kind") == k, F.lit(c)) for k, c in kinds_of(containers)], F.lit(None).cast("int"))
    return out.withColumn("capacity", capacity).withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4))
