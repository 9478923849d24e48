"""Distances, norms and sparse-vector algebra as Column expressions.

Vectors are arrays of float; everything is computed in double. Sparse vectors are structs of sorted `indices`, `values`
and `dim`. Expressions stay on the JVM, so Catalyst can push filters below them and prune what they don't read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str | list


def constant(values, kind: str = "array<double>") -> Column:
    """Numbers as one literal, nested as `kind` says: the optimizer folds it, so a plan has one node whatever their number."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def vec(v: Vector) -> Column:
    """A vector column, a column's name or a literal list as array<double>."""
    if isinstance(v, (list, tuple)):
        values = [float(x) for x in v]
        return constant(values) if all(map(math.isfinite, values)) else F.array(*[F.lit(x) for x in values])
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: Vector, b: Vector) -> Column:
    """Sum of products; 0 where the lengths differ."""
    a, b = vec(a), vec(b)
    return F.when(F.size(a) == F.size(b), _total(F.zip_with(a, b, lambda x, y: x * y))).otherwise(F.lit(0.0))


def norm(a: Vector) -> Column:
    if isinstance(a, (list, tuple)):  # a literal's is a constant: lambdas are not folded by the optimizer
        total = 0.0
        for x in a:
            total += float(x) * float(x)
        return F.lit(total**0.5)
    return F.sqrt(_total(F.transform(vec(a), lambda x: x * x)))


def l2_squared(a: Vector, b: Vector) -> Column:
    return _total(F.zip_with(vec(a), vec(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Vector, b: Vector) -> Column:
    return F.sqrt(l2_squared(a, b))


def cosine_similarity(a: Vector, b: Vector) -> Column:
    """Cosine; 0 for a zero or empty vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def cosine_distance(a: Vector, b: Vector) -> Column:
    """1 - cosine; 1 for a zero or empty vector."""
    return F.lit(1.0) - cosine_similarity(a, b)


def normalized_cosine_distance(a: Vector, b: Vector) -> Column:
    """1 - dot of unit vectors, not below 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - dot(a, b))


def negative_dot(a: Vector, b: Vector) -> Column:
    return -dot(a, b)


def normalize(a: Vector) -> Column:
    """The vector at unit length; a zero vector stays."""
    a, size = vec(a), norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


#: Metrics by name; smaller is nearer.
DISTANCES: dict[str, Callable[[Vector, Vector], Column]] = {
    "cosine": cosine_distance,
    "cosine_normalized": normalized_cosine_distance,
    "euclidean": l2,
    "l2": l2,
    "l2_squared": l2_squared,
    "dot": negative_dot,
}


def register_distance(name: str, build: Callable[[Vector, Vector], Column]) -> None:
    DISTANCES[name] = build


def score_of(distance: Column) -> Column:
    """The index score 1 / (1 + distance)."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def rounded(value: Column, places: int = 6) -> Column:
    """Rounded, with no negative zero: fit for ordering and comparison across engines."""
    return F.round(value, places) + F.lit(0.0)


# -- packed bits -------------------------------------------------------------------------------------------------------


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words; -1 where the lengths differ."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), bits).otherwise(F.lit(-1))


def hamming_similarity(distance: Column, dim: int) -> Column:
    """Cosine estimate of a Hamming distance: 1 - 2 h / dim."""
    return F.lit(1.0) - F.lit(2.0) * distance / F.lit(float(dim))


# -- sparse vectors ----------------------------------------------------------------------------------------------------


def sparse_from_dense(dense: Vector, threshold: float = 1e-9) -> Column:
    """Entries whose absolute value exceeds the threshold."""
    dense = vec(dense)
    entries = F.filter(F.transform(dense, lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda e: F.abs(e["v"]) > threshold)
    return F.struct(F.transform(entries, lambda e: e["i"]).alias("indices"), F.transform(entries, lambda e: e["v"]).alias("values"), F.size(dense).alias("dim"))


def sparse_map(s: Column) -> Column:
    return F.map_from_arrays(s["indices"], s["values"])


def sparse_to_dense(s: Column) -> Column:
    entries = sparse_map(s)
    return F.transform(F.sequence(F.lit(0), s["dim"] - 1), lambda i: F.coalesce(F.try_element_at(entries, i).cast("double"), F.lit(0.0)))


def sparse_norm(s: Column) -> Column:
    return norm(s["values"])


def sparse_dot(a: Column, b: Column) -> Column:
    """Sum over shared indices; 0 where the dimensions differ."""
    other = sparse_map(b)
    terms = F.zip_with(a["indices"], a["values"], lambda i, v: v.cast("double") * F.coalesce(F.try_element_at(other, i).cast("double"), F.lit(0.0)))
    return F.when(a["dim"] == b["dim"], _total(terms)).otherwise(F.lit(0.0))


def sparse_cosine(a: Column, b: Column) -> Column:
    size = sparse_norm(a) * sparse_norm(b)
    return F.when(size > 0, sparse_dot(a, b) / size).otherwise(F.lit(0.0))


def sparse_l2(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite where the dimensions differ."""
    squares = sparse_norm(a) * sparse_norm(a) + sparse_norm(b) * sparse_norm(b) - 2 * sparse_dot(a, b)
    return F.when(a["dim"] == b["dim"], F.sqrt(F.greatest(F.lit(0.0), squares))).otherwise(F.lit(float("inf")))


def sparse_jaccard(a: Column, b: Column) -> Column:
    """Overlap of index sets; 1 if both are empty."""
    union = F.size(F.array_union(a["indices"], b["indices"]))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a["indices"], b["indices"])) / union)


def sparse_bm25(query: Column, doc: Column, avg_length: float, k1: float = 1.2, b: float = 0.75) -> Column:
    """BM25 saturation without inverse document frequency; a document's length is its number of entries."""
    other = sparse_map(doc)
    scale = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.size(doc["indices"]) / F.lit(float(avg_length)))

    def term(i: Column, q: Column) -> Column:
        tf = F.coalesce(F.try_element_at(other, i).cast("double"), F.lit(0.0))
        return F.when(tf > 0, q.cast("double") * tf * F.lit(k1 + 1.0) / (tf + scale)).otherwise(F.lit(0.0))

    return _total(F.zip_with(query["indices"], query["values"], term))


def sparse_add(a: Column, b: Column, threshold: float = 1e-9) -> Column:
    """Sum; entries that both hold and that cancel are dropped."""
    left, right = sparse_map(a), sparse_map(b)
    zero = F.lit(0.0)
    entries = F.transform(F.array_sort(F.array_union(a["indices"], b["indices"])), lambda i: F.struct(i.alias("i"), (F.coalesce(F.try_element_at(left, i).cast("double"), zero) + F.coalesce(F.try_element_at(right, i).cast("double"), zero)).alias("v"), (F.map_contains_key(left, i) & F.map_contains_key(right, i)).alias("both")))
    entries = F.filter(entries, lambda e: ~e["both"] | (F.abs(e["v"]) > threshold))
    return F.struct(F.transform(entries, lambda e: e["i"]).alias("indices"), F.transform(entries, lambda e: e["v"]).alias("values"), a["dim"].alias("dim"))


def sparse_scale(s: Column, factor: float) -> Column:
    return F.struct(s["indices"].alias("indices"), F.transform(s["values"], lambda v: v.cast("double") * factor).alias("values"), s["dim"].alias("dim"))


def sparse_normalize(s: Column) -> Column:
    return F.struct(s["indices"].alias("indices"), normalize(s["values"]).alias("values"), s["dim"].alias("dim"))


def sparse_nnz(s: Column) -> Column:
    return F.size(s["indices"])


def sparsity(s: Column) -> Column:
    return F.lit(1.0) - F.size(s["indices"]) / s["dim"]


def sparse_valid(s: Column) -> Column:
    """Parallel, sorted and distinct indices within the dimension, no zero value."""
    n = F.size(s["indices"])
    in_range = F.when(n == 0, F.lit(True)).otherwise((F.array_min(s["indices"]) >= 0) & (F.array_max(s["indices"]) < s["dim"]))
    return (n == F.size(s["values"])) & (F.array_sort(F.array_distinct(s["indices"])) == s["indices"]) & in_range & ~F.exists(s["values"], lambda v: v == 0)
