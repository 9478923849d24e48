"""Sparse retrieval over postings (doc_id, term, tf): BM25, dot and cosine, with index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v


def postings_of(df: DataFrame, id_col: str = "doc_id", sparse: str = "keywords") -> DataFrame:
    """(id, term, tf) of a sparse-vector column."""
    pairs = F.arrays_zip(F.col(f"{sparse}.indices").alias("term"), F.col(f"{sparse}.values").alias("tf"))
    return df.select(id_col, F.explode(pairs).alias("p")).select(id_col, F.col("p.term").alias("term"), F.col("p.tf").cast("double").alias("tf"))


def hashed_postings(docs: DataFrame, dim: int, stopwords: list[str] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term, tf) of texts by hashed terms; terms that share a bucket add up."""
    tokens = tx.tokenize_terms(F.col(text), tx.STOPWORDS if stopwords is None else stopwords)
    # a text's terms are counted in its row; only texts of one id have to meet
    rows = docs.select(id_col, F.explode(tx.term_counts(tokens, dim)).alias("p")).select(id_col, F.col("p.i").alias("term"), F.col("p.n").alias("n"))
    if repeated(docs, id_col):
        rows = rows.groupBy(id_col, "term").agg(F.sum("n").alias("n"))
    return rows.select(id_col, "term", F.col("n").cast("double").alias("tf"))


def repeated(docs: DataFrame, id_col: str) -> bool:
    """Whether an id (or a missing one) stands in more than one row: a pass over the ids alone."""
    return bool(docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect())


def store(postings: DataFrame, path: str) -> DataFrame:
    """Postings as a table, a term in one file and files in term order, read back: a search's terms are pushed down to the row groups that hold them.

    Terms are dealt by hash: cutting ranges would compute the postings once more for its sample.
    """
    postings.repartition("term").sortWithinPartitions("term").write.parquet(path)
    return postings.sparkSession.read.schema(postings.schema).parquet(path)


def doc_stats(postings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return postings.groupBy(id_col).agg(F.sum(F.abs("tf")).alias("len"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(postings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: documents, terms, postings, avgdl."""
    docs = postings.groupBy(id_col).agg(F.sum(F.abs("tf")).alias("len"), F.count("*").alias("n"))
    totals = docs.agg(F.count("*").alias("documents"), F.sum("n").alias("postings"), v.rounded(F.avg("len")).alias("avgdl"))
    return totals.crossJoin(postings.agg(F.countDistinct("term").alias("terms")))  # one row with one row


def _query(df: DataFrame, query: dict[int, float]) -> DataFrame:
    rows = ", ".join(f"({int(t)}, CAST({float(w)!r} AS DOUBLE))" for t, w in sorted(query.items()))
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS q(qterm, qv)")


def _ranked(scores: DataFrame, k: int, id_col: str) -> DataFrame:
    top = scores.select(id_col, v.rounded(F.col("score")).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def _matches(postings: DataFrame, query: dict[int, float], where: Column | None) -> DataFrame:
    """Postings of the query's terms; the query has a bounded number of terms and is broadcast."""
    rows = postings.filter(where) if where is not None else postings
    rows = rows.filter(F.col("term").isin([int(t) for t in query]))  # reaches the scan of a stored index
    q = _query(postings, query)
    return rows.join(F.broadcast(q), F.col("term") == F.col("qterm"))


def search_bm25(postings: DataFrame, query: dict[int, float], k: int, k1: float = 1.2, b: float = 0.75, where: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """id, score and rank by query-weighted BM25 over all postings; only documents that share a term."""
    lens = postings.groupBy(id_col).agg(F.sum(F.abs("tf")).alias("len"))
    stats = lens.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).first()
    if not stats.n:
        return _ranked(lens.select(id_col, F.lit(0.0).alias("score")), k, id_col)
    hits = _matches(postings, query, where)
    df = _matches(postings, query, None).groupBy("qterm").agg(F.count("*").alias("df"))
    hits = hits.join(F.broadcast(df), "qterm").join(lens, id_col)  # df: a row per query term
    idf = F.log((F.lit(float(stats.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = F.col("qv") * idf * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.lit(stats.avgdl)))
    return _ranked(hits.groupBy(id_col).agg(F.sum(part).alias("score")), k, id_col)


def search_dot(postings: DataFrame, query: dict[int, float], k: int, where: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    return _ranked(_matches(postings, query, where).groupBy(id_col).agg(F.sum(F.col("qv") * F.col("tf")).alias("score")), k, id_col)


def search_cosine(postings: DataFrame, query: dict[int, float], k: int, where: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """Cosine; documents of norm zero are left out."""
    size = sum(x * x for x in query.values()) ** 0.5
    dots = _matches(postings, query, where).groupBy(id_col).agg(F.sum(F.col("qv") * F.col("tf")).alias("dot"))
    rows = dots.join(doc_stats(postings, id_col), id_col).filter("norm > 0")
    return _ranked(rows.select(id_col, (F.col("dot") / (F.lit(size) * F.col("norm"))).alias("score")), k, id_col)


def search_jaccard(postings: DataFrame, query: dict[int, float], k: int, id_col: str = "doc_id") -> DataFrame:
    """Overlap of term sets."""
    shared = _matches(postings, query, None).groupBy(id_col).agg(F.count("*").alias("both"))
    sizes = postings.groupBy(id_col).agg(F.count("*").alias("n"))
    score = F.col("both") / (F.col("n") + F.lit(len(query)) - F.col("both"))
    return _ranked(shared.join(sizes, id_col).select(id_col, score.alias("score")), k, id_col)


def delete(postings: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return postings.join(ids.select(id_col), id_col, "left_anti")


def add(postings: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Postings with those of new documents; a document that is there already is an error."""
    again = new.select(id_col).join(postings.select(id_col), id_col, "left_semi").limit(1).collect()
    if again:
        raise ValueError(f"document {again[0][0]} exists")
    return postings.unionByName(new)
