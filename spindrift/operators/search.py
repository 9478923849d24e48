"""Exact nearest-neighbour and lexical search: scan, predicate, score, top-k, page.

Top-k of one query is TakeOrderedAndProject: every task keeps k rows and only those travel. A batch of queries is
scored in blocks of bounded size against all rows; each task keeps k rows per query before anything is shuffled.
Every order ends in the id, so results are the same on every run.
"""

from __future__ import annotations

import base64
import json
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v

#: Values (queries x dimensions) of a block of queries that is broadcast at once.
QUERY_VALUES = 1_000_000
#: Distances that a task holds at once.
TILE_VALUES = 4_000_000


def _k(k: int) -> int:
    if k <= 0:
        raise ValueError("top_k must be positive")
    return k


def knn(df: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None, id_col: str = "id", vector: str = "embedding", keep: tuple[str, ...] = (), strategy: str = "columns") -> DataFrame:
    """id, distance, score (1 / (1 + distance); the product itself for dot) and rank (from 1) of the k nearest rows that satisfy `where`, filtered before they are scored.

    Rows with a null vector or one of another length don't take part. `columns` scores in the JVM, row by row; `matmul`
    (long ids) takes a matrix product per Arrow batch, which pays from some million rows times dimensions on.
    """
    rows = df.filter(where) if where is not None else df
    if strategy == "matmul":
        asked = df.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, query array<double>")
        found = knn_batch(asked, rows, _k(k), metric, id_col=id_col, vector=vector).drop("query_id")
        score = v.rounded(v.score_of(F.col("distance")) if metric != "dot" else -F.col("distance")).alias("score")
        return (found.join(rows.select(id_col, *keep), id_col) if keep else found).select(id_col, *keep, "distance", score, "rank")
    rows = rows.filter(F.size(vector) == len(query))
    distance = v.rounded(v.DISTANCES[metric](vector, query))
    rows = rows.select(id_col, *keep, distance.alias("distance")).orderBy("distance", id_col).limit(_k(k))
    rank = F.row_number().over(Window.orderBy("distance", id_col))  # over k rows
    return rows.select(id_col, *keep, "distance", v.rounded(v.score_of(F.col("distance")) if metric != "dot" else -F.col("distance")).alias("score"), rank.cast("long").alias("rank"))


def _distances(block: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all queries of a block (first axis) to all rows, in double, rounded as the single query's are."""
    dots = block @ rows.T
    if metric == "dot":
        out = -dots
    elif metric == "cosine_normalized":
        out = np.maximum(0.0, 1.0 - dots)
    elif metric == "cosine":
        sizes = np.linalg.norm(block, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        out = 1.0 - np.divide(dots, sizes, out=np.zeros_like(dots), where=sizes > 0)
    else:
        squares = np.maximum(0.0, (block * block).sum(1)[:, None] + (rows * rows).sum(1)[None, :] - 2 * dots)
        out = squares if metric == "l2_squared" else np.sqrt(squares)
    return np.round(out, 6) + 0.0


def _nearest(distances: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of each line with their ids, ties by id. ids has a line for each line or one for all."""
    ids = np.broadcast_to(ids, distances.shape)
    if distances.shape[1] > 2 * k:
        edge = np.partition(distances, k - 1, axis=1)[:, k - 1 : k]
        width = max(k, int((distances <= edge).sum(axis=1).max()))  # ties at the edge stay in
        if width < distances.shape[1]:
            at = np.argpartition(distances, width - 1, axis=1)[:, :width]
            distances, ids = np.take_along_axis(distances, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, distances), axis=-1)[:, :k]
    return np.take_along_axis(distances, order, 1), np.take_along_axis(ids, order, 1)


def _close(block: np.ndarray, rows: np.ndarray, edge: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Places (query, row) of pairs that may be as near as the query's edge: a product and one comparison a pair; None if they are many.

    The margin is far above what rounding to six places and the product's own rounding can move.
    """
    a, b = (block * block).sum(1), (rows * rows).sum(1)
    if not (np.isfinite(a).all() and np.isfinite(b).all() and np.isfinite(edge).all()):
        return None
    reach = edge + 2e-6
    top = (reach * reach if metric == "l2" else reach) + 1e-9 * (a + b.max(initial=0.0))
    # |q|^2 + |x|^2 - 2 q x <= top
    low = (block @ rows.T) * 2.0
    low -= b[None, :]
    at = np.flatnonzero(low >= (a - top)[:, None])
    return None if len(at) > low.size // 16 else np.divmod(at, low.shape[1])


def _merged(best_d: np.ndarray, best_i: np.ndarray, close: tuple[np.ndarray, np.ndarray], block: np.ndarray, rows: np.ndarray, ids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The best so far with the close pairs among them, whose distances are computed in full."""
    q, r = close
    if not len(q):
        return best_d, best_i
    k = best_d.shape[1]
    d = np.empty(len(q))
    for at in range(0, len(q), 1 << 16):  # the pairs' vectors side by side
        x, y = block[q[at : at + (1 << 16)]], rows[r[at : at + (1 << 16)]]
        squares = ((x - y) ** 2).sum(1)
        d[at : at + (1 << 16)] = np.round(squares if metric == "l2_squared" else np.sqrt(squares), 6) + 0.0
    lines = np.unique(q)
    names = np.concatenate([q, np.repeat(lines, k)])
    d, i = np.concatenate([d, best_d[lines].ravel()]), np.concatenate([ids[r], best_i[lines].ravel()])
    order = np.lexsort((i, d, names))
    names = names[order]
    first = np.searchsorted(names, lines)
    take = order[(first[:, None] + np.arange(k)).ravel()]
    best_d, best_i = best_d.copy(), best_i.copy()
    best_d[lines], best_i[lines] = d[take].reshape(-1, k), i[take].reshape(-1, k)
    return best_d, best_i


def knn_batch(queries: DataFrame, df: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", query_vector: str = "query", id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """query_id, id (both long), distance and rank of the k nearest rows of every query.

    Queries are streamed through the driver in blocks of QUERY_VALUES values, each broadcast and matched with all rows
    by matrix products over Arrow batches, TILE_VALUES distances at a time; a task sends at most k rows per query on.
    Rows with a null vector or one of another length don't take part.
    """
    _k(k)
    spark = df.sparkSession
    schema = f"{query_id} long, {id_col} long, distance double"

    def against(ids: list, block: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array(ids, dtype=np.int64), block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            dim = matrix.shape[1]
            best_d, best_i = np.zeros((len(names), 0)), np.zeros((len(names), 0), dtype=np.int64)
            for batch in batches:
                column = batch.column(vector)
                batch = batch.filter(pc.equal(pc.fill_null(pc.list_value_length(column), -1), dim))
                if not batch.num_rows:
                    continue
                rows = np.asarray(batch.column(vector).flatten(), dtype=np.float64).reshape(-1, dim)
                there = np.asarray(batch.column(id_col).cast(pa.int64()))
                step = max(1, TILE_VALUES // len(names))
                for at in range(0, len(rows), step):
                    tile, here = rows[at : at + step], there[at : at + step]
                    if best_d.shape[1] == k and metric in ("l2", "l2_squared") and (close := _close(matrix, tile, best_d[:, -1], metric)) is not None:
                        best_d, best_i = _merged(best_d, best_i, close, matrix, tile, here, metric)
                        continue
                    d, i = _nearest(_distances(matrix, tile, metric), here, k)
                    best_d, best_i = _nearest(np.concatenate([best_d, d], axis=1), np.concatenate([best_i, i], axis=1), k)
            n = best_d.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], names=[query_id, id_col, "distance"])

        return df.select(id_col, vector).mapInArrow(run, schema)

    parts, ids, held = [], [], []
    for row in queries.select(query_id, query_vector).toLocalIterator():
        ids.append(row[0])
        held.append(row[1])
        if len(held) * max(1, len(held[0])) >= QUERY_VALUES:
            parts.append(against(ids, np.array(held, dtype=np.float64)))
            ids, held = [], []
    if held:
        parts.append(against(ids, np.array(held, dtype=np.float64)))
    if not parts:
        return spark.createDataFrame([], schema + ", rank long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy("distance", id_col)).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn_graph(df: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The exact k-nearest-neighbour graph: every row's k nearest others."""
    near = knn_batch(df.select(F.col(id_col).alias("query_id"), F.col(vector).alias("query")), df, k + 1, metric, id_col=id_col, vector=vector)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col)).cast("long")
    return near.filter(F.col("query_id") != F.col(id_col)).withColumn("rank", rank).filter(F.col("rank") <= k)


def recall_at_k(truth: DataFrame, found: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id") -> DataFrame:
    """Mean share of each query's k true neighbours that were found."""
    hits = truth.filter(F.col("rank") <= k).join(found.filter(F.col("rank") <= k).select(query_id, id_col, F.lit(1).alias("hit")), [query_id, id_col], "left")
    return hits.groupBy(query_id).agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.lit(float(k))).alias("r")).agg(v.rounded(F.avg("r")).alias("recall"))


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stopwords: list[str] | None = None) -> DataFrame:
    """(id, term, tf) of tokenised texts."""
    return docs.select(id_col, F.explode(tx.tokenize(F.col(text), stopwords)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def _is(term: str):
    return lambda x: x == F.lit(term)


def bm25_scores(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every text that holds a term of the query; a query's terms count once each.

    A first pass counts documents, lengths and the query terms' frequencies; the second tokenises only texts in which a
    term occurs as a substring. Both count in the row, so no posting leaves the scan.
    """
    spark = docs.sparkSession
    terms = sorted(set(spark.range(1).select(tx.tokenize(F.lit(query)).alias("t")).first().t))
    if not terms:
        return docs.select(id_col).limit(0).withColumn("score", F.lit(0.0))
    if len(terms) > 16:
        return _bm25_by_postings(docs, F.array(*[F.lit(t) for t in terms]), k1, b, id_col, text)

    def counted(rows: DataFrame) -> DataFrame:
        """id, len and a count for each term; the one-element explode keeps filters on counts from being copied into the tokeniser."""
        rows = rows.select(id_col, tx.tokenize(F.col(text)).alias("tokens"))
        tf = F.struct(F.size("tokens").alias("len"), *[F.size(F.filter("tokens", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
        return rows.select(id_col, F.explode(F.array(tf)).alias("c")).select(id_col, "c.*")

    stats = counted(docs).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    low = F.lower(text)
    # (the case of other letters can depend on what stands next to them)
    rows = counted(docs.filter(reduce(operator.or_, [low.contains(t) for t in terms])) if all(t.isascii() for t in terms) else docs)
    if not stats.n:
        return rows.select(id_col, F.lit(0.0).alias("score"))

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), stats[f"df{i}"]
        idf = F.log(F.lit((stats.n - df + 0.5) / (df + 0.5) + 1.0))
        return F.when(tf > 0, idf * tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.lit(stats.avgdl or 1.0)))).otherwise(F.lit(0.0))

    hit = reduce(operator.add, [F.col(f"tf{i}") for i in range(len(terms))]) > 0
    return rows.filter(hit).select(id_col, reduce(operator.add, [part(i) for i in range(len(terms))]).alias("score"))


def _bm25_by_postings(docs: DataFrame, wanted: Column, k1: float, b: float, id_col: str, text: str) -> DataFrame:
    tokens = docs.select(id_col, tx.tokenize(F.col(text)).alias("tokens"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl")).first()
    found = tokens.select(id_col, F.size("tokens").alias("len"), F.explode(F.filter("tokens", lambda x: F.array_contains(wanted, x))).alias("term"))
    tf = found.groupBy(id_col, "term").agg(F.first("len").alias("len"), F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(F.broadcast(df), "term")  # as many rows as the query has terms
    idf = F.log((F.lit(stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("len") / F.lit(stats.avgdl)))
    return rows.groupBy(id_col).agg(F.sum(part).alias("score"))


def lexical(docs: DataFrame, query: str, k: int, where: Column | None = None, id_col: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score and rank of the k best texts; texts without a query term compete with score 0. Corpus counts are of all rows of docs."""
    scores = bm25_scores(docs, query, k1, b, id_col, text)
    rows = (docs.filter(where) if where is not None else docs).select(id_col)
    rows = rows.join(scores, id_col, "left").select(id_col, v.rounded(F.coalesce("score", F.lit(0.0))).alias("score"))
    rows = rows.orderBy(F.desc("score"), id_col).limit(_k(k))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def hybrid_alpha(vectors: DataFrame, docs: DataFrame, query_vector: list[float], query: str, k: int, alpha: float = 0.5, id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """alpha * dot + (1 - alpha) * BM25 of every document with a vector; the best k."""
    scores = bm25_scores(docs, query, id_col=id_col)
    rows = vectors.select(id_col, v.dot(vector, query_vector).alias("d")).join(scores, id_col, "left")
    total = F.lit(alpha) * F.col("d") + F.lit(1.0 - alpha) * F.coalesce("score", F.lit(0.0))
    rows = rows.select(id_col, v.rounded(total).alias("score")).orderBy(F.desc("score"), id_col).limit(_k(k))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def vector_query(df: DataFrame, query: list[float], k: int, where: Column | None = None, filter_mode: str = "pre", id_col: str = "id", vector: str = "embedding", seq: str = "seq") -> DataFrame:
    """The older request: k rows by dot product, ties by insertion. `post` filters the k rows, so fewer may be left; `pre` filters first."""
    rows = df.filter(where) if where is not None and filter_mode == "pre" else df
    rows = rows.withColumn("score", v.rounded(v.dot(vector, query))).orderBy(F.desc("score"), seq).limit(_k(k))
    rows = rows.filter(where) if where is not None and filter_mode == "post" else rows
    return rows.drop(vector)


def sparse_query(df: DataFrame, indices: list[int], values: list[float], dim: int, k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """A sparse query against dense vectors: made dense, then cosine."""
    dense = [0.0] * dim
    for i, x in zip(indices, values, strict=True):
        dense[i] = x
    return knn(df, dense, k, "cosine", id_col=id_col, vector=vector)


# -- enumeration and paging --------------------------------------------------------------------------------------------


def scroll(df: DataFrame, limit: int = 100, offset: int = 0, where: Column | None = None, order: str = "seq") -> tuple[DataFrame, int, int]:
    """A page of live rows in insertion order, how many there are, and the next offset (-1 at the end)."""
    rows = df.filter(where) if where is not None else df
    total = rows.count()
    end = offset + limit
    return rows.orderBy(order).offset(offset).limit(limit), total, end if end < total else -1


def multi_get(df: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """Rows by id; ids that don't exist are left out."""
    return df.filter(F.col(id_col).isin(list(ids)))


def page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    """A slice of ranked rows (rank from 1)."""
    return ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def fingerprint(request: dict) -> str:
    """Hash of all that determines a query's result."""
    import hashlib

    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:16]


def encode_token(offset: int, request: dict, last_seq: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"offset": offset, "filter_hash": fingerprint(request), "last_seq": last_seq}).encode()).decode()


def decode_token(token: str, request: dict, seq_before: int | None = None) -> int:
    """The token's offset; an error if the query or the row before it has changed."""
    try:
        held = json.loads(base64.urlsafe_b64decode(token.encode()))
    except ValueError as e:
        raise ValueError("invalid page token") from e
    if held["filter_hash"] != fingerprint(request):
        raise ValueError("page token belongs to another query")
    if seq_before is not None and held["last_seq"] != seq_before:
        raise ValueError("page token is stale")
    return held["offset"]


def project(df: DataFrame, include_vectors: bool = False, include_meta: bool = True, vector: str = "embedding", meta: str = "meta") -> DataFrame:
    drop = ([] if include_vectors else [vector]) + ([] if include_meta else [meta])
    return df.drop(*drop)


def hydrate(ranked: DataFrame, docs: DataFrame, id_col: str = "id") -> DataFrame:
    """Ranked ids with their documents; an id without one keeps its place with nulls."""
    return ranked.join(docs, id_col, "left").orderBy("rank")


