"""Language identification by hyperdimensional letter-n-gram profiles.

Every letter has a random vector of +-1; an n-gram binds its letters' vectors, each permuted by its place; a text
bundles (adds) the vectors of its n-grams; a language's prototype bundles its training texts, each at unit length.
A text's language is the prototype with the largest cosine. Random vectors come from a fixed seed, so every worker
makes the same ones and nothing but the prototypes (languages x DIMENSIONS numbers) is ever broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHES, bound_batches, file_count, forget_others, give_back, materialize, slices, text_bytes

DIMENSIONS = 1024
#: Letters in an n-gram.
GRAM = 3
#: Symbols: 0 is what stands between words; letters of higher code points share symbols by remainder.
SYMBOLS = 1024
SEED = 20250131
#: n-gram vectors that a worker remembers before it starts again (1 KB each).
GRAM_CACHE = 32_000
#: Prototypes that are broadcast at once (8 KB each); more languages take more passes over the documents.
BLOCK_LANGUAGES = 2_000
#: A text of at least CERTAIN letters whose best cosine is lower resembles no language: four standard deviations (1 /
#: sqrt(DIMENSIONS)) of the cosine to an unlike text. Shorter texts of a known language may score as low.
REJECT_BELOW = 0.125
CERTAIN = 60


class Profiles:
    """n-gram vectors, made on demand."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.letters = (rng.integers(0, 2, (SYMBOLS, DIMENSIONS), dtype=np.int8) * 2 - 1).astype(np.int8)
        # one permutation, applied once for each place
        once = rng.permutation(DIMENSIONS)
        self.places = [np.arange(DIMENSIONS)]
        for _ in range(GRAM - 1):
            self.places.append(self.places[-1][once])
        self.forget()
        self.symbol = np.zeros(0x110000, dtype=np.int32)
        points = np.arange(0x110000)
        alphabetic = np.fromiter((chr(p).isalpha() for p in points), dtype=bool, count=len(points))
        lower = np.fromiter((ord(c) if len(c := chr(p).lower()) == 1 else p for p in points), dtype=np.int64, count=len(points))
        self.symbol[alphabetic] = 1 + lower[alphabetic] % (SYMBOLS - 1)

    def forget(self) -> None:
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((GRAM_CACHE, DIMENSIONS), dtype=np.int8)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Rows of self.vectors for distinct n-gram codes."""
        if len(self.row) + len(grams) > GRAM_CACHE:
            self.row.clear()
        known = self.row
        rows = [known.get(g, -1) for g in grams.tolist()]
        missing = [i for i, r in enumerate(rows) if r < 0]
        if missing:
            need = len(known) + len(missing)
            codes = grams[missing]
            bound = np.ones((len(codes), DIMENSIONS), dtype=np.int8)
            for k in range(GRAM):
                bound *= self.letters[codes % SYMBOLS][:, self.places[k]]
                codes = codes // SYMBOLS
            first = len(known)
            self.vectors[first:need] = bound
            for n, i in enumerate(missing):
                known[int(grams[i])] = rows[i] = first + n
        return np.array(rows)

    def bundles(self, texts: pa.Array) -> Iterator[np.ndarray | None]:
        """The bundle of each text, None for one without a letter (null and empty ones too)."""
        data, offsets = text_bytes(texts)
        # code points of all texts, and where each text starts among them
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        starts = heads[offsets]
        symbols = self.symbol[points]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            s = symbols[a:b]
            letters = s > 0
            if not letters.any():
                yield None
                continue
            keep = letters.copy()  # of a run of other characters one stays, as a word end
            keep[1:] |= letters[:-1]
            s = np.concatenate(([0], s[keep], [0])).astype(np.int64)
            gram = np.zeros(max(1, len(s) - GRAM + 1), dtype=np.int64)
            for k in range(GRAM):
                gram += s[k : k + len(gram)] << (10 * k)
            codes, counts = np.unique(gram, return_counts=True)
            total = np.zeros(DIMENSIONS, dtype=np.float32)
            for at in range(0, len(codes), 1024):  # bounded memory for any text
                rows = self.rows(codes[at : at + 1024])
                total += counts[at : at + 1024].astype(np.float32) @ self.vectors[rows].astype(np.float32)
            yield total


_PROFILES: list[Profiles] = []
CACHES["langid"] = _PROFILES.clear


def profiles() -> Profiles:
    forget_others("langid")
    if not _PROFILES:
        _PROFILES.append(Profiles())
    return _PROFILES[0]


def train(docs: DataFrame) -> DataFrame:
    """Prototypes (lang, part: sums as bytes), a row for each language of all rows with a text and a non-null lang.

    Bundles are added up within each task, then by language over tasks, so that one language may hold any share of
    the rows. Texts without a letter add nothing; an empty table gives no prototype. The result is a table in the
    shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        made = profiles()
        for part in slices(batches, "text", 2 << 20):
            for lang, bundle in zip(part.column("lang").to_pylist(), made.bundles(part.column("text")), strict=True):
                if lang is not None and bundle is not None and (norm := float(np.linalg.norm(bundle))) > 0:
                    sums[lang] = sums.get(lang, 0.0) + bundle.astype(np.float64) / norm
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "part": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, part in zip(b.column("lang").to_pylist(), b.column("part").to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0.0) + np.frombuffer(part)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "part": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    bound_batches(docs.sparkSession)
    schema = "lang string, part binary"
    parts = docs.select("lang", "text").filter("lang is not null and text is not null").mapInArrow(run, schema)
    # sums of task sums: a salted round keeps what one task reads small
    merged = parts.withColumn("salt", F.spark_partition_id() % 16).repartition("lang", "salt").select("lang", "part").mapInArrow(merge, schema)
    return materialize(merged.repartition("lang").mapInArrow(merge, schema), "op8-prototypes", file_count(docs))


def _blocks(prototypes: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages in order and their prototypes at unit length, BLOCK_LANGUAGES at a time."""
    langs: list[str] = []
    rows: list[np.ndarray] = []
    for r in prototypes.orderBy("lang").toLocalIterator():
        langs.append(r.lang)
        rows.append((found := np.frombuffer(r.part)) / (np.linalg.norm(found) or 1.0))
        if len(langs) == BLOCK_LANGUAGES:
            yield langs, np.array(rows)
            langs, rows = [], []
    if langs:
        yield langs, np.array(rows)


def identify(docs: DataFrame, prototypes: DataFrame, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two columns more: the language of the nearest prototype, and its cosine cut to 0..1, by all of the text.

    `und` with score 0 where the text is null, empty or without a letter, or where there is no prototype. Ties go to
    the language first in order. All columns of docs are kept but those of the two names.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop(*names)
    found = docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(-1.0)})
    for langs, unit in _blocks(prototypes):
        found = _nearest(found, langs, unit, names)
    return found.withColumn(names[1], F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), names[1])), 6))


def _nearest(docs: DataFrame, langs: list[str], unit: np.ndarray, names: tuple[str, str]) -> DataFrame:
    """docs whose last two columns are the language and cosine so far, and of this block where it is nearer."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = shared.value
        made = profiles()
        for part in slices(batches, "text", 2 << 20):
            best, score = (part.column(x).to_pylist() for x in names)
            for i, bundle in enumerate(made.bundles(part.column("text"))):
                norm = float(np.linalg.norm(bundle)) if bundle is not None else 0.0
                if norm:
                    cosine = np.round(matrix @ (bundle.astype(np.float64) / norm), 9)  # so that ties are ties
                    k = int(np.argmax(cosine))
                    if best[i] == "und" or float(cosine[k]) > score[i]:
                        best[i], score[i] = known[k], float(cosine[k])
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=part.schema.names)
        give_back()

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4
