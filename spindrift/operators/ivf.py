"""Inverted-file search: k-means, cluster assignment, probing, and its bit and product-quantised variants.

A fitted index is a table with a cluster_id column plus a centroid table whose size is a parameter. Probing joins the
rows with the probed clusters, so a table partitioned by cluster_id is pruned to those partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from . import quantize
from . import search as search_
from .collection import numbered

#: Rows of a table from which fitting is left to Spark ML's k-means.
LLOYD_ROUNDS = 10


def initial_centroids(df: DataFrame, k: int, id_col: str = "id", vector: str = "embedding") -> list[list[float]]:
    """k rows evenly spaced in id order: the first of each of k equal parts."""
    n = df.count()
    step = max(1, n // k)
    places = numbered(df.select(id_col), [id_col], "_r").filter((F.col("_r") % step == 0) & (F.col("_r") < k * step)).select(id_col)
    rows = df.select(id_col, vector).join(places, id_col, "left_semi").orderBy(id_col).limit(k).collect()  # k rows
    return [[float(x) for x in r[vector]] for r in rows]


def _book(centroids: list[list[float]]) -> Column:
    return v.constant([[float(x) for x in c] for c in centroids], "array<array<double>>")


def assign(df: DataFrame, centroids: list[list[float]], metric: str = "l2_squared", vector: str = "embedding", name: str = "cluster_id") -> DataFrame:
    """df with its nearest centroid's number, the first of equals."""
    book = _book(centroids)
    near = F.transform(book, lambda c, i: F.struct(v.rounded(v.DISTANCES[metric](vector, c), 9).alias("d"), i.alias("i")))
    return df.withColumn(name, F.array_min(near)["i"].cast("long"))


def lloyd_step(df: DataFrame, centroids: list[list[float]], vector: str = "embedding") -> DataFrame:
    """cluster_id, pos and mean of the clusters after one assignment: partial sums per task, then one row per cluster and dimension."""
    rows = assign(df.select(vector), centroids, vector=vector).select("cluster_id", F.posexplode(vector).alias("pos", "x"))
    return rows.groupBy("cluster_id", "pos").agg(v.rounded(F.avg(F.col("x").cast("double")), 9).alias("mean"))


def kmeans(df: DataFrame, k: int, rounds: int = LLOYD_ROUNDS, id_col: str = "id", vector: str = "embedding") -> list[list[float]]:
    """Deterministic Lloyd iterations from evenly spaced rows; an empty cluster becomes a zero vector. Only centroids reach the driver."""
    centroids = initial_centroids(df, k, id_col, vector)
    for _ in range(rounds):
        means: dict[tuple[int, int], float] = {(r.cluster_id, r.pos): r.mean for r in lloyd_step(df, centroids, vector).collect()}
        after = [[means.get((c, p), 0.0) for p in range(len(centroids[0]))] for c in range(len(centroids))]
        if after == centroids:
            break
        centroids = after
    return centroids


def kmeans_ml(df: DataFrame, k: int, rounds: int = 20, seed: int = 42, vector: str = "embedding") -> list[list[float]]:
    """Scalable k-means|| of Spark ML, for large fits."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fitted = KMeans(k=k, maxIter=rounds, seed=seed).fit(df.select(array_to_vector(v.vec(vector)).alias("features")))
    return [c.tolist() for c in fitted.clusterCenters()]


def probes(centroids: list[list[float]], query: list[float], nprobe: int, metric: str = "cosine") -> list[int]:
    """The nprobe nearest clusters, ties by number."""
    a, q = np.array(centroids, dtype=np.float64), np.array(query, dtype=np.float64)
    if metric == "cosine":
        size = np.linalg.norm(a, axis=1) * np.linalg.norm(q)
        d = 1.0 - np.divide(a @ q, size, out=np.zeros(len(a)), where=size > 0)
    else:
        d = ((a - q) ** 2).sum(axis=1)
    return [int(i) for i in np.lexsort((np.arange(len(a)), np.round(d, 9)))[:nprobe]]


def search(index: DataFrame, centroids: list[list[float]], query: list[float], k: int, nprobe: int = 10, metric: str = "cosine", where: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """k nearest rows of the probed clusters that satisfy `where`."""
    rows = index.filter(F.col("cluster_id").isin(probes(centroids, query, nprobe, metric)))
    rows = rows.filter(where) if where is not None else rows
    rows = rows.select(id_col, "cluster_id", v.rounded(v.DISTANCES[metric](vector, query)).alias("distance")).orderBy("distance", id_col).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)).cast("long"))


def search_batch(index: DataFrame, centroids: list[list[float]], queries: DataFrame, k: int, nprobe: int = 10, metric: str = "l2_squared", query_id: str = "query_id", query_vector: str = "query", id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """query_id, id (both long), distance and rank of the k nearest rows of every query in the clusters it probes.

    Queries go in blocks through the driver, as those of an exact batch do. A task takes its rows cluster by cluster and
    multiplies them with the queries that probe the cluster; it sends at most k rows per query on.
    """
    near = F.slice(F.array_sort(F.transform(_book(centroids), lambda c, i: F.struct(v.rounded(v.DISTANCES[metric](query_vector, c), 9).alias("d"), i.alias("i")))), 1, nprobe)
    asked = queries.select(query_id, query_vector, F.transform(near, lambda p: p["i"]).alias("cells"))
    schema = f"{query_id} long, {id_col} long, distance double"
    spark = index.sparkSession

    def against(block: list) -> DataFrame:
        cells: dict[int, list[int]] = {}
        for n, r in enumerate(block):
            for c in r["cells"]:
                cells.setdefault(c, []).append(n)
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in block], dtype=np.int64), np.array([r[1] for r in block], dtype=np.float64), {c: np.array(x) for c, x in cells.items()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix, askers = shared.value
            best_d, best_i = np.full((len(names), k), np.inf), np.full((len(names), k), -1, dtype=np.int64)
            for batch in batches:
                batch = batch.filter(pc.equal(pc.fill_null(pc.list_value_length(batch.column(vector)), -1), matrix.shape[1]))
                if not batch.num_rows:
                    continue
                rows = np.asarray(batch.column(vector).flatten(), dtype=np.float64).reshape(-1, matrix.shape[1])
                there, cell = (np.asarray(batch.column(c).cast(pa.int64())) for c in (id_col, "cluster_id"))
                for c in np.unique(cell).tolist():
                    if c not in askers:
                        continue
                    mine, who = np.flatnonzero(cell == c), askers[c]
                    step = max(1, search_.TILE_VALUES // len(who))
                    for at in range(0, len(mine), step):
                        part = mine[at : at + step]
                        d, i = search_._nearest(search_._distances(matrix[who], rows[part], metric), there[part], k)
                        best_d[who], best_i[who] = search_._nearest(np.concatenate([best_d[who], d], axis=1), np.concatenate([best_i[who], i], axis=1), k)
            query, place = np.nonzero(np.isfinite(best_d))
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(best_i[query, place]), pa.array(best_d[query, place])], names=[query_id, id_col, "distance"])

        return index.filter(F.col("cluster_id").isin(list(cells))).select(id_col, "cluster_id", vector).mapInArrow(run, schema)

    parts, held = [], []
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) * len(row[1]) >= search_.QUERY_VALUES:
            parts.append(against(held))
            held = []
    parts += [against(held)] if held else []
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy("distance", id_col)).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def cluster_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("cluster_id").agg(F.count("*").alias("rows"))


# -- bits per cluster ---------------------------------------------------------------------------------------------------


def binary_thresholds(index: DataFrame, vector: str = "embedding") -> dict[int, list[float]]:
    """Mean of each dimension in each cluster."""
    rows = index.select("cluster_id", F.posexplode(vector).alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m")).collect()
    out: dict[int, list[float]] = {}
    for r in sorted(rows, key=lambda r: (r.cluster_id, r.pos)):
        out.setdefault(r.cluster_id, []).append(r.m)
    return out


def binary_search(index: DataFrame, centroids: list[list[float]], thresholds: dict[int, list[float]], query: list[float], k: int, nprobe: int = 10, rescore: int = 0, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """k nearest rows of the probed clusters by the Hamming distance of their cluster's bits, or by exact cosine of the best `rescore`."""
    dim = len(query)
    parts = None
    for c in probes(centroids, query, nprobe, "l2"):
        if c not in thresholds:
            continue
        t = thresholds[c]
        h = v.hamming(quantize.binary_encode(vector, t), quantize.binary_encode(v.vec(query), t))
        part = index.filter(F.col("cluster_id") == c).select(id_col, vector, h.cast("long").alias("hamming"))
        parts = part if parts is None else parts.unionByName(part)
    rows = parts.orderBy("hamming", id_col)
    if rescore:
        rows = rows.limit(max(k, rescore)).select(id_col, "hamming", v.rounded(v.cosine_distance(vector, query)).alias("distance")).orderBy("distance", id_col).limit(k)
        return rows.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)).cast("long"))
    rows = rows.limit(k).select(id_col, "hamming", v.rounded(v.hamming_similarity(F.col("hamming"), dim)).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("hamming", id_col)).cast("long"))


# -- product quantisation -----------------------------------------------------------------------------------------------


def fit_pq(df: DataFrame, m: int, k: int, rounds: int = LLOYD_ROUNDS, id_col: str = "id", vector: str = "embedding") -> quantize.Codebook:
    """A codebook of m subspaces by k-means over all rows in each, all subspaces in one job a round; an empty cluster becomes a zero vector."""
    start = np.array(initial_centroids(df, k, id_col, vector))
    width = start.shape[1] // m
    centroids = start[:, : m * width].reshape(len(start), m, width).transpose(1, 0, 2)
    for _ in range(rounds):
        rows = df.select(quantize.Codebook(centroids).encode(vector).alias("codes"), v.vec(vector).alias("vector")).select("codes", F.posexplode("vector").alias("pos", "x"))
        means = rows.groupBy("pos", F.get("codes", F.floor(F.col("pos") / width).cast("int")).alias("c")).agg(v.rounded(F.avg("x"), 9).alias("mean"))
        after = np.zeros_like(centroids)
        for r in means.filter(F.col("pos") < m * width).collect():  # m * width * k numbers
            after[r.pos // width, r.c, r.pos % width] = r.mean
        if np.array_equal(after, centroids):
            break
        centroids = after
    return quantize.Codebook(centroids)


def residuals(index: DataFrame, centroids: list[list[float]], vector: str = "embedding") -> DataFrame:
    """index with each row's vector less its centroid."""
    book = _book(centroids)
    return index.withColumn("residual", F.zip_with(v.vec(vector), F.get(book, F.col("cluster_id").cast("int")), lambda x, c: x - c))


def pq_search(encoded: DataFrame, centroids: list[list[float]], book: quantize.Codebook, query: list[float], k: int, nprobe: int = 10, id_col: str = "id", codes: str = "codes") -> DataFrame:
    """k nearest rows of the probed clusters by asymmetric distance of the query's residual, a table per cluster."""
    parts = None
    for c in probes(centroids, query, nprobe, "l2"):
        rest = [q - x for q, x in zip(query, centroids[c], strict=True)]
        part = encoded.filter(F.col("cluster_id") == c).select(id_col, "cluster_id", v.rounded(book.adc(codes, rest)).alias("distance"))
        parts = part if parts is None else parts.unionByName(part)
    rows = parts.orderBy("distance", id_col).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)).cast("long"))
