"""Routing of rows and queries to shards, scatter-gather top-k, rebalancing plans.

A shard is a partition value of a table written by shard; pruning to a query's shards is partition pruning, and the
gather step is the ordinary distributed top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as v

# The 64-bit FNV-1a offset and prime.
OFFSET, PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)


def fnv1a(text: str) -> int:
    h = int(OFFSET)
    for byte in text.encode():
        h = (h ^ byte) * int(PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(T.LongType())
def fnv1a_64(keys: pd.Series) -> pd.Series:
    """The hash as a signed 64-bit number; multiplication wraps round, which SQL arithmetic doesn't."""
    data = [None if k is None else k.encode() for k in keys]
    width = max((len(b) for b in data if b is not None), default=0)
    table = np.zeros((len(data), max(1, width)), dtype=np.uint64)
    sizes = np.array([-1 if b is None else len(b) for b in data])
    for i, b in enumerate(data):
        if b:
            table[i, : len(b)] = np.frombuffer(b, dtype=np.uint8)
    h = np.full(len(data), OFFSET, dtype=np.uint64)
    for j in range(width):
        on = sizes > j
        h[on] = (h[on] ^ table[on, j]) * PRIME
    return pd.Series(h.view(np.int64)).where(sizes >= 0, None).astype("Int64")


def shard_of(key: Column, shards: int) -> Column:
    """Hash modulo the number of shards, the hash taken without sign."""
    h = fnv1a_64(key)
    return F.pmod(h.cast("decimal(20,0)") + F.when(h < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)")), F.lit(shards)).cast("int")


def route(df: DataFrame, shards: int, by: str = "collection") -> DataFrame:
    """df with `shard`; keys are few when collections route, so they are hashed once each and joined."""
    keys = df.select(by).distinct().withColumn("shard", shard_of(F.col(by).cast("string"), shards))
    return df.join(keys, by)


def shards_for(collections: list[str] | None, shards: int) -> list[int]:
    """Shards that hold the collections; all if none are named."""
    return sorted({fnv1a(c) % shards for c in collections}) if collections else list(range(shards))


def scatter_gather(df: DataFrame, query: list[float], k: int, collections: list[str] | None, shards: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Best k rows by dot product of the shards that hold the collections: each shard's k, then the k of all."""
    rows = df.filter(F.col("shard").isin(shards_for(collections, shards)))
    rows = rows.filter(F.col("collection").isin(collections)) if collections else rows
    score = v.rounded(v.dot(vector, query))
    top = rows.select(id_col, "shard", score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return top


def merge(parts: list[DataFrame], k: int, id_col: str = "id") -> DataFrame:
    """The best k of ranked lists from several places; an id that comes twice keeps its best score."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(id_col).agg(F.max("score").alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def plan_moves(now: DataFrame, after: DataFrame, key: str = "collection") -> DataFrame:
    """key, source and target of what a new mapping (key, shard) moves; new keys have no source."""
    rows = after.withColumnRenamed("shard", "target").join(now.withColumnRenamed("shard", "source"), key, "left")
    return rows.filter(~F.col("source").eqNullSafe(F.col("target")))


