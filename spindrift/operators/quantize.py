"""Vector compression: half floats, 8-bit scalars, bits, product quantisation, and asymmetric distance by table lookup.

Fitting reduces over positions (`posexplode` and one aggregation per dimension, combined on the map side); encoding and
scoring are Column expressions over small literal codebooks whose size is fixed by the parameters.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as v


def _lits(values) -> Column:
    return v.constant([float(x) for x in values])



# -- half floats: mantissas are cut off, subnormal halves are zero, overflow is infinite --------------------------------


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def fp16_encode(vectors: pd.Series) -> pd.Series:
    def one(a) -> list[int]:
        bits = np.asarray(a, dtype=np.float32).view(np.uint32).astype(np.int64)
        sign, exponent, mantissa = bits >> 16 & 0x8000, (bits >> 23 & 0xFF) - 112, bits >> 13 & 0x3FF
        special = bits >> 23 & 0xFF
        half = np.where(exponent <= 0, 0, np.where(exponent >= 31, 0x7C00, exponent << 10 | mantissa))
        half = np.where(special == 255, np.where(bits & 0x7FFFFF, 0x7E00, 0x7C00), half)
        return (sign | half).tolist()

    return vectors.map(lambda a: None if a is None else one(a))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def fp16_decode(codes: pd.Series) -> pd.Series:
    def one(a) -> list[float]:
        halves = np.asarray(a, dtype=np.uint16)
        halves = np.where(halves & 0x7C00, halves, halves & 0x8000).astype(np.uint16)
        return halves.view(np.float16).astype(np.float32).tolist()

    return codes.map(lambda a: None if a is None else one(a))


# -- 8-bit scalars ------------------------------------------------------------------------------------------------------


def u8_train(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """pos, low, high of each dimension."""
    return df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))


def bounds(trained: DataFrame) -> tuple[list[float], list[float]]:
    """Trained bounds on the driver: two numbers per dimension."""
    rows = sorted((r.pos, r.low, r.high) for r in trained.collect())
    return [r[1] for r in rows], [r[2] for r in rows]


def u8_encode(vector: str | Column, low: list[float], high: list[float]) -> Column:
    """floor(255 (x - low) / (high - low)) within 0..255; 0 where a dimension has no range."""
    pairs = F.arrays_zip(v.vec(vector).alias("x"), _lits(low).alias("lo"), _lits(high).alias("hi"))
    code = lambda p: F.when(p["hi"] > p["lo"], F.greatest(F.lit(0), F.least(F.lit(255), F.floor((p["x"] - p["lo"]) / (p["hi"] - p["lo"]) * 255).cast("int")))).otherwise(F.lit(0))
    return F.transform(pairs, code)


def u8_decode(codes: str | Column, low: list[float], high: list[float]) -> Column:
    codes = F.col(codes) if isinstance(codes, str) else codes
    pairs = F.arrays_zip(codes.alias("q"), _lits(low).alias("lo"), _lits(high).alias("hi"))
    return F.transform(pairs, lambda p: p["q"] / F.lit(255.0) * (p["hi"] - p["lo"]) + p["lo"])


# -- bits ---------------------------------------------------------------------------------------------------------------


def binary_train(df: DataFrame, vector: str = "embedding") -> list[float]:
    """Mean of each dimension, rounded so that thresholds don't depend on the order of addition."""
    rows = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m")).collect()
    return [r.m for r in sorted(rows, key=lambda r: r.pos)]


def binary_encode(vector: str | Column, thresholds: list[float]) -> Column:
    """Bits x > threshold, lowest first, in words of 62 bits (so that no shift reaches the sign)."""
    bits = F.zip_with(v.vec(vector), _lits(thresholds), lambda x, t: (x > t).cast("long"))
    words = []
    for at in range(0, len(thresholds), 62):
        part = F.slice(bits, at + 1, min(62, len(thresholds) - at))
        words.append(F.aggregate(F.reverse(part), F.lit(0).cast("long"), lambda s, b: s * 2 + b))
    return F.array(*words)


def binary_decode(words: Column, dim: int) -> Column:
    """1 for a set bit, -1 for another."""
    parts = []
    for n, at in enumerate(range(0, dim, 62)):
        places = F.sequence(F.lit(0), F.lit(min(62, dim - at) - 1))
        parts.append(F.transform(places, _sign(F.get(words, n))))
    return F.concat(*parts)


def _sign(word: Column):
    return lambda k: F.when(F.call_function("shiftright", word, k).bitwiseAND(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def binary_search(df: DataFrame, query: list[float], thresholds: list[float], k: int, rescore: int = 0, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """k nearest by Hamming distance of bits; with rescore, that many candidates are ranked by exact cosine."""
    code = binary_encode(vector, thresholds)
    ask = binary_encode(v.vec(query), thresholds)
    rows = df.select(id_col, vector, v.hamming(code, ask).cast("long").alias("hamming")).orderBy("hamming", id_col)
    if rescore:
        rows = rows.limit(max(k, rescore)).withColumn("distance", v.rounded(v.cosine_distance(vector, query)))
        return _ranked(rows.select(id_col, "hamming", "distance"), "distance", k, id_col)
    rows = rows.limit(k).select(id_col, "hamming", v.rounded(v.hamming_similarity(F.col("hamming"), len(thresholds))).alias("score"))
    return _ranked(rows, "hamming", k, id_col)


def _ranked(rows: DataFrame, by: str, k: int, id_col: str) -> DataFrame:
    rows = rows.orderBy(by, id_col).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(by, id_col)).cast("long"))


# -- product quantisation -----------------------------------------------------------------------------------------------


def _to(part: Column):
    return lambda c, i: F.struct(v.rounded(v.l2_squared(part, c), 9).alias("d"), i.alias("i"))


class Codebook:
    """m subspaces with k centroids each; 16 centroids make the packed 4-bit form."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, dtype=np.float64)
        self.m, self.k, self.width = self.centroids.shape

    def encode(self, vector: str | Column) -> Column:
        """The nearest centroid of each subvector, the first of equals."""
        x = v.vec(vector)
        codes = []
        for j in range(self.m):
            part = F.slice(x, j * self.width + 1, self.width)
            book = v.constant(self.centroids[j].tolist(), "array<array<double>>")
            near = F.transform(book, _to(part))
            codes.append(F.array_min(near)["i"])
        return F.array(*codes)

    def decode(self, codes: str | Column) -> Column:
        codes = F.col(codes) if isinstance(codes, str) else codes
        return F.flatten(F.array(*[F.get(v.constant(self.centroids[j].tolist(), "array<array<double>>"), F.get(codes, j)) for j in range(self.m)]))

    def table(self, query: list[float]) -> np.ndarray:
        """Squared distance of each subquery to each centroid."""
        parts = np.asarray(query, dtype=np.float64).reshape(self.m, 1, self.width)
        return ((parts - self.centroids) ** 2).sum(axis=2)

    def adc(self, codes: str | Column, query: list[float]) -> Column:
        """Asymmetric squared distance: one lookup per subspace, added in order."""
        codes = F.col(codes) if isinstance(codes, str) else codes
        looked = [F.get(_lits(row), F.get(codes, j)) for j, row in enumerate(self.table(query))]
        return sum(looked[1:], looked[0])

    def fast_scan(self, codes: str | Column, query: list[float]) -> Column:
        """Distance by tables of 8-bit entries (rounded, scaled to each table's range) and integer sums."""
        codes = F.col(codes) if isinstance(codes, str) else codes
        table = self.table(query)
        low = table.min(axis=1, keepdims=True)
        scale = np.maximum(table.max(axis=1, keepdims=True) - low, 1e-30).max() / 255.0
        small = np.floor((table - low) / scale + 0.5).astype(int)
        looked = [F.get(v.constant(row.tolist(), "array<int>"), F.get(codes, j)) for j, row in enumerate(small)]
        return sum(looked[1:], looked[0]) * F.lit(float(scale)) + F.lit(float(low.sum()))


def pack_nibbles(codes: Column, m: int) -> Column:
    """4-bit codes two to a byte, the even subspace low."""
    return F.array(*[F.get(codes, j) + (F.get(codes, j + 1) * 16 if j + 1 < m else F.lit(0)) for j in range(0, m, 2)])


def unpack_nibbles(packed: Column, m: int) -> Column:
    return F.slice(F.flatten(F.transform(packed, lambda b: F.array(b % 16, F.floor(b / 16).cast("int")))), 1, m)


def pq_search(encoded: DataFrame, book: Codebook, query: list[float], k: int, id_col: str = "id", codes: str = "codes") -> DataFrame:
    """k nearest by asymmetric distance."""
    return _ranked(encoded.select(id_col, v.rounded(book.adc(codes, query)).alias("distance")), "distance", k, id_col)


def info(dim: int, rows: int, bytes_per_vector: int) -> dict[str, float]:
    return {"original_bytes": 4 * dim * rows, "compressed_bytes": bytes_per_vector * rows, "ratio": 4 * dim / bytes_per_vector}


# -- typed blobs --------------------------------------------------------------------------------------------------------

_KINDS = {"float32": 0, "float16": 1, "uint8": 2, "sparse": 3}


@F.pandas_udf(T.BinaryType())
def blob_encode(vectors: pd.Series) -> pd.Series:
    """float32 vectors as one little-endian blob: kind, dimension, values."""
    return vectors.map(lambda a: None if a is None else struct.pack("<BI", _KINDS["float32"], len(a)) + np.asarray(a, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def blob_decode(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4", offset=5).tolist())
