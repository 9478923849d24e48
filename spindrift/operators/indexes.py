"""Search strategies by name: what an index type means is which rows are probed and how they are scored.

Graph-based types answer the exact question (recall 1); inverted-file and compressed types are fitted once and then
probe and score as their definitions say. A strategy is built from a table with an id and a vector column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from . import ivf, quantize, search, sparse

Strategy = Callable[..., DataFrame]
Build = Callable[..., Strategy]
REGISTRY: dict[str, Build] = {}


def register(name: str):
    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"index type {name} is registered")
        REGISTRY[name] = build
        return build

    return add


def supported() -> list[str]:
    return sorted(REGISTRY)


def create(name: str, df: DataFrame, id_col: str = "id", vector: str = "embedding", **params) -> Strategy:
    """A function (query, k, where=None) -> ranked rows."""
    if name not in REGISTRY:
        raise ValueError(f"unknown index type {name}; there are {supported()}")
    return REGISTRY[name](df, id_col, vector, **params)


def _filtered(df: DataFrame, where: Column | None) -> DataFrame:
    return df.filter(where) if where is not None else df


@register("flat")
def flat(df: DataFrame, id_col: str, vector: str, metric: str = "cosine", **_) -> Strategy:
    return lambda query, k, where=None: search.knn(df, query, k, metric, where, id_col, vector)


for _name in ("hnsw", "diskann"):
    REGISTRY[_name] = flat


@register("ivf")
def inverted_file(df: DataFrame, id_col: str, vector: str, metric: str = "cosine", nlist: int = 100, nprobe: int = 10, rounds: int = 10, centroids: list | None = None, **_) -> Strategy:
    """Exact until there are ten rows for each list, as an untrained index is."""
    if centroids is None and df.count() < 10 * nlist:
        return flat(df, id_col, vector, metric)
    centres = centroids or ivf.kmeans(df, nlist, rounds, id_col, vector)
    index = ivf.assign(df, centres, vector=vector)
    return lambda query, k, where=None: ivf.search(index, centres, query, k, nprobe, metric, where, id_col, vector)


@register("binary")
def binary(df: DataFrame, id_col: str, vector: str, rescore: int = 0, **_) -> Strategy:
    thresholds = quantize.binary_train(df, vector)
    return lambda query, k, where=None: quantize.binary_search(_filtered(df, where), query, thresholds, k, rescore * k, id_col, vector)


@register("ivf_binary")
def ivf_binary(df: DataFrame, id_col: str, vector: str, nlist: int = 100, nprobe: int = 10, rounds: int = 10, rescore: int = 10, **_) -> Strategy:
    centres = ivf.kmeans(df, nlist, rounds, id_col, vector)
    index = ivf.assign(df, centres, vector=vector)
    thresholds = ivf.binary_thresholds(index, vector)
    return lambda query, k, where=None: ivf.binary_search(_filtered(index, where), centres, thresholds, query, k, nprobe, rescore * k, id_col, vector)


REGISTRY["ivf-binary"] = ivf_binary


@register("pq")
def product(df: DataFrame, id_col: str, vector: str, m: int = 8, ksub: int = 256, rounds: int = 20, **_) -> Strategy:
    book = ivf.fit_pq(df, m, ksub, rounds, id_col, vector)
    coded = df.withColumn("codes", book.encode(vector))
    return lambda query, k, where=None: quantize.pq_search(_filtered(coded, where), book, query, k, id_col)


@register("pq4")
def product4(df: DataFrame, id_col: str, vector: str, m: int = 16, rounds: int = 20, **_) -> Strategy:
    return product(df, id_col, vector, m, 16, rounds)


@register("ivf_pq")
def ivf_product(df: DataFrame, id_col: str, vector: str, nlist: int = 100, nprobe: int = 10, m: int = 8, ksub: int = 256, rounds: int = 10, **_) -> Strategy:
    centres = ivf.kmeans(df, nlist, rounds, id_col, vector)
    rest = ivf.residuals(ivf.assign(df, centres, vector=vector), centres, vector)
    book = ivf.fit_pq(rest, m, ksub, rounds, id_col, "residual")
    coded = rest.withColumn("codes", book.encode("residual"))
    return lambda query, k, where=None: ivf.pq_search(_filtered(coded, where), centres, book, query, k, nprobe, id_col)


@register("sparse")
def sparse_index(df: DataFrame, id_col: str, vector: str, metric: str = "cosine", threshold: float = 1e-6, **_) -> Strategy:
    """Dense input made sparse; candidates share a dimension."""
    entries = df.select(id_col, F.posexplode(v.vec(vector)).alias("term", "tf")).filter(F.abs("tf") > threshold)
    rank = {"cosine": sparse.search_cosine, "dot": sparse.search_dot, "jaccard": sparse.search_jaccard}[metric]

    def run(query, k, where=None):
        asked = {i: x for i, x in enumerate(query) if abs(x) > threshold}
        rows = entries.join(_filtered(df, where).select(id_col), id_col, "left_semi") if where is not None else entries
        return rank(rows, asked, k, id_col=id_col)

    return run


@register("inverted")
def inverted(df: DataFrame, id_col: str, vector: str, metric: str = "bm25", **_) -> Strategy:
    """A sparse-vector column by BM25, dot or cosine; the query is a map of term to weight."""
    entries = sparse.postings_of(df, id_col, vector)
    rank = {"bm25": sparse.search_bm25, "dot": sparse.search_dot, "cosine": sparse.search_cosine}[metric]
    return lambda query, k, where=None: rank(entries, query, k, id_col=id_col)


def degrees(graph: DataFrame) -> DataFrame:
    """One row on a neighbour graph (query_id, id): nodes, edges, and least, mean and largest out-degree."""
    rows = graph.groupBy("query_id").agg(F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("nodes"), F.sum("n").alias("edges"), F.min("n").alias("least"), v.rounded(F.avg("n")).alias("mean"), F.max("n").alias("most"))


def sizes(df: DataFrame, vector: str = "embedding", deleted: str | None = None) -> DataFrame:
    """One row: rows, deleted, live and bytes of the vectors."""
    gone = F.count_if(F.col(deleted)) if deleted else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("rows"), gone.alias("deleted"), (F.count("*") - gone).alias("live"), F.sum(F.size(vector) * 4).alias("bytes"))
