"""One entry for searches: what is asked decides which operator answers, and how its answer is paged and shown."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as fl
from . import fusion, search, sparse

#: How many more candidates the lists of a hybrid search fetch than are asked for.
OVERFETCH = 2


@dataclass
class Request:
    """Dense queries (one vector or several), a sparse one, or both; a filter document; a page; what to show."""

    dense: list[float] | list[list[float]] | None = None
    sparse: dict[int, float] | None = None
    top_k: int = 10
    metric: str = "cosine"
    filter: dict[str, Any] | None = None
    method: str = "rrf"
    weights: dict[str, float] = field(default_factory=dict)
    offset: int = 0
    limit: int | None = None
    include_vectors: bool = False
    include_meta: bool = True

    def validate(self) -> None:
        if self.dense is None and not self.sparse:
            raise ValueError("a search needs a dense or a sparse query")
        if self.top_k < 1 or self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise ValueError("top_k is at least 1, a page's bounds are not negative")
        if self.sparse and self.many:
            raise ValueError("a hybrid search takes one dense query")
        if self.weights:
            fusion.validate(self.weights)

    @property
    def many(self) -> bool:
        return bool(self.dense) and isinstance(self.dense[0], (list, tuple))


def run(docs: DataFrame, request: Request, postings: DataFrame | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Ranked rows of docs that the request asks for: rank, score (or distance, for several queries) and docs' columns.

    The filter applies before scoring. One dense query is a scan with a top-k, several are a batch by tiles (with
    query_id, their place in the request), a sparse one a search of the postings, both are fused. Empty tables and
    requests that nothing satisfies give no row; ties go by id.
    """
    request.validate()
    where: Column | None = fl.compile_filter(request.filter, fl.Fields.of(docs)) if request.filter else None
    rows = docs.filter(where) if where is not None else docs
    wanted = request.offset + request.limit if request.limit is not None else request.top_k
    k = max(request.top_k, wanted)
    if request.many:
        asked = docs.sparkSession.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(request.dense)], "query_id long, query array<double>")
        found = search.knn_batch(asked, rows, k, request.metric, id_col=id_col, vector=vector)
    elif not request.sparse:
        found = search.knn(rows, request.dense, k, request.metric, id_col=id_col, vector=vector).drop("distance")
    else:
        if postings is None:
            raise ValueError("a sparse query needs postings")
        allowed = postings.join(rows.select(id_col), id_col, "left_semi") if where is not None else postings
        depth = k if request.dense is None else OVERFETCH * k
        found = sparse.search_dot(allowed, request.sparse, depth, id_col=id_col)
        if request.dense is not None:
            near = search.knn(rows, request.dense, depth, request.metric, id_col=id_col, vector=vector)
            named = lambda df: df.select(F.col(id_col).alias("doc_id"), "rank", "score")
            found = fusion.hybrid(named(near), named(found), k, request.method, request.weights or None).withColumnRenamed("doc_id", id_col)
    found = search.page(found, request.offset, wanted - request.offset)
    shown = search.project(docs, request.include_vectors, request.include_meta, vector)
    return found.join(shown.drop(*[c for c in found.columns if c != id_col]), id_col)
