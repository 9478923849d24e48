"""From the single-vector store to collections: texts to hashed sparse vectors, documents to collection rows; an offline embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v
from .sparse import repeated


def sparse_vectors(docs: DataFrame, dim: int = 10_000, stopwords: list[str] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and keywords (sparse term counts by hashed term; terms that share a bucket add up). A text without terms has an empty vector."""
    words = tx.tokenize_terms(F.col(text), tx.STOPWORDS if stopwords is None else stopwords)
    if not repeated(docs, id_col):
        return docs.select(id_col, _keywords(tx.term_counts(words, dim), dim).alias("keywords"))
    rows = docs.select(id_col, F.explode(tx.term_counts(words, dim)).alias("p")).groupBy(id_col, "p.i").agg(F.sum("p.n").alias("n"))
    made = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("e"))
    return docs.select(id_col).join(made, id_col, "left").select(id_col, _keywords(F.col("e"), dim).alias("keywords"))


def _keywords(pairs: Column, dim: int) -> Column:
    """A sparse vector of (i, n) pairs in term order."""
    indices, values = F.coalesce(pairs["i"], F.array().cast("array<int>")), F.coalesce(pairs["n"].cast("array<float>"), F.array().cast("array<float>"))
    return F.struct(indices.alias("indices"), values.alias("values"), F.lit(dim).alias("dim"))


def to_collection(docs: DataFrame, dim: int = 10_000) -> DataFrame:
    """Rows (id, embedding, keywords, metadata) of documents (doc_id, text, embedding, meta)."""
    rows = docs.select(F.col("doc_id").alias("id"), "doc_id", "text", "embedding", F.to_json("meta").alias("metadata"))
    if not repeated(docs, "doc_id"):
        words = tx.tokenize_terms(F.col("text"), tx.STOPWORDS)
        return rows.filter("doc_id is not null").select("id", "embedding", _keywords(tx.term_counts(words, dim), dim).alias("keywords"), "metadata")
    return rows.drop("text").join(sparse_vectors(docs, dim), "doc_id").select("id", "embedding", "keywords", "metadata")


def hash_embedding(text: Column, dim: int) -> Column:
    """A deterministic unit vector of a text (empty texts count as `empty`), spread by a 64-bit hash of text and place."""
    shown = F.when(F.coalesce(text, F.lit("")) == "", "empty").otherwise(text)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(shown, i), F.lit(2_000_003)) / F.lit(1_000_001.0) - 1.0)
    return v.normalize(raw)
