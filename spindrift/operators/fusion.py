"""Fusion of ranked lists (list, doc_id, rank from 1, score): reciprocal rank, min-max weighted, linear."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v

RRF_K = 60.0


def validate(weights: dict[str, float], k: float = RRF_K) -> None:
    if k <= 0 or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("k must be positive, weights not negative and not all zero")


def normalize_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {n: w / total for n, w in weights.items()} if total > 0 else dict(weights)


def union_lists(lists: dict[str, DataFrame], id_col: str = "doc_id") -> DataFrame:
    """Ranked lists as one table; they are short, so one aggregation replaces an outer join."""
    parts = [df.select(F.lit(name).alias("list"), F.col(id_col).alias("doc_id"), "rank", F.col("score").cast("double").alias("score")) for name, df in lists.items()]
    return reduce(DataFrame.unionByName, parts)


def _weight(weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]).cast("map<string,double>"), F.col("list")), F.lit(0.0))


def _top(scores: DataFrame, k: int) -> DataFrame:
    top = scores.select("doc_id", v.rounded(F.col("score"), 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))


def rrf(lists: DataFrame, k: int, rrf_k: float = RRF_K) -> DataFrame:
    """Sum of 1 / (rrf_k + rank), the first rank counting 0; weights play no part."""
    return _top(lists.groupBy("doc_id").agg(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank") - 1)).alias("score")), k)


def weighted(lists: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Each list min-max scaled from its last to its first score (1 throughout if they are equal), weighted and added."""
    whole = Window.partitionBy("list").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lists.withColumns({"top": F.first_value("score").over(whole), "low": F.last_value("score").over(whole)})
    scaled = F.when(F.col("top") == F.col("low"), F.lit(1.0)).otherwise((F.col("score") - F.col("low")) / (F.col("top") - F.col("low")))
    return _top(rows.groupBy("doc_id").agg(F.sum(_weight(weights) * scaled).alias("score")), k)


def linear(lists: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weight times score; lists carry similarities (higher is better)."""
    return _top(lists.groupBy("doc_id").agg(F.sum(_weight(weights) * F.col("score")).alias("score")), k)


def fuse(lists: DataFrame, k: int, method: str = "rrf", weights: dict[str, float] | None = None, rrf_k: float = RRF_K) -> DataFrame:
    if method not in ("rrf", "weighted", "linear"):
        raise ValueError(f"unknown fusion {method}")
    return rrf(lists, k, rrf_k) if method == "rrf" else (weighted if method == "weighted" else linear)(lists, k, weights)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, method: str = "rrf", weights: dict[str, float] | None = None, graph: DataFrame | None = None, rrf_k: float = RRF_K) -> DataFrame:
    """Dense and sparse lists (each fetched at twice k), and a graph list if there is one, fused."""
    lists = {"dense": dense, "sparse": sparse} | ({"graph": graph} if graph is not None else {})
    return fuse(union_lists(lists), k, method, weights or {"dense": 0.7, "sparse": 0.3}, rrf_k)


def graph_boost(base: DataFrame, graph: DataFrame, k: int, rrf_k: float = RRF_K) -> DataFrame:
    """The base list reordered by reciprocal-rank fusion with a graph list; documents of the graph list alone are left out."""
    fused = rrf(union_lists({"base": base, "graph": graph}), 1 << 30, rrf_k)
    kept = fused.join(base.select("doc_id"), "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(k)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))
