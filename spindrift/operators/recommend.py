"""Recommendation, discovery and reranking on top of exact search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from . import search


def mean_vector(df: DataFrame, vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """One row `mean`: the (weighted) mean of all vectors, by position."""
    w = weight if weight is not None else F.lit(1.0)
    rows = df.select(w.alias("w"), F.posexplode(vector).alias("pos", "x"))
    mean = rows.groupBy("pos").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    return mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def _vectors(df: DataFrame, ids: list, id_col: str, vector: str) -> list[list[float]]:
    found = {r[0]: [float(x) for x in r[1]] for r in df.filter(F.col(id_col).isin(list(ids))).select(id_col, vector).collect()}
    missing = [i for i in ids if i not in found]
    if missing:
        raise KeyError(f"unknown ids {missing}")
    return [found[i] for i in ids]


def _mean(rows: list[list[float]]) -> list[float]:
    return [sum(c) / len(rows) for c in zip(*rows, strict=True)]


def _unit(a: list[float]) -> list[float]:
    size = sum(x * x for x in a) ** 0.5
    return [x / size for x in a] if size else a


def recommend(df: DataFrame, positive: list, negative: list | None = None, k: int = 10, weight: float = 0.5, metric: str = "cosine", where: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Rows nearest to the unit vector of mean(positive) - weight * mean(negative), less the examples, which are taken out after top-k."""
    if not positive:
        raise ValueError("needs a positive example")
    target = _mean(_vectors(df, positive, id_col, vector))
    if negative:
        away = _mean(_vectors(df, negative, id_col, vector))
        target = [a - weight * b for a, b in zip(target, away, strict=True)]
    found = search.knn(df, _unit(target), k, metric, where, id_col, vector)
    return found.filter(~F.col(id_col).isin([*positive, *(negative or [])]))


def discover(df: DataFrame, pairs: list[tuple], target: list[float] | int | str | None = None, k: int = 10, where: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The 4 k rows nearest to the target, by the product of sigmoid(cos(row, positive) - cos(row, negative)) over all pairs times cos(row, target).

    The target is a vector, an id, or by default the unit mean of the positives.
    """
    k = k if k > 0 else 10
    plus = _vectors(df, [p for p, _ in pairs], id_col, vector)
    minus = _vectors(df, [n for _, n in pairs], id_col, vector)
    if target is None:
        target = _unit(_mean(plus))
    elif not isinstance(target, (list, tuple)):
        target = _vectors(df, [target], id_col, vector)[0]
    near = search.knn(df, list(target), 4 * k, "cosine", where, id_col, vector, keep=(vector,))
    score = v.cosine_similarity(vector, list(target))
    for p, n in zip(plus, minus, strict=True):
        score = score * sigmoid(v.cosine_similarity(vector, p) - v.cosine_similarity(vector, n))
    rows = near.select(id_col, v.rounded(score).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def rerank(page: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """A page reordered by dot product with the query's embedding."""
    rows = page.withColumn("rerank_score", v.rounded(v.dot(vector, query))).orderBy(F.desc("rerank_score"), id_col).limit(k)
    return rows.withColumn("rerank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), id_col)).cast("long"))


def rerank_with(page: DataFrame, score: Column, k: int, id_col: str = "id") -> DataFrame:
    """A page reordered by any scoring expression, such as a cross-encoder wrapped as a pandas UDF."""
    rows = page.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), id_col).limit(k)
    return rows.withColumn("rerank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), id_col)).cast("long"))
