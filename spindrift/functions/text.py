"""Tokenisers, hashes, sentiment and chunkers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stop words and sentiment words.
STOPWORDS = ["the", "a", "an", "in", "on", "for", "and", "or", "but", "of", "to", "is"]
POSITIVE = """great|good|excellent|perfect|helpful|useful|accurate|correct|thanks|thank|awesome|amazing|love|best|well done|exactly|right|yes|nice|fantastic|wonderful""".split("|")
NEGATIVE = """bad|wrong|incorrect|useless|unhelpful|terrible|awful|missed|missing|didn't|not|no|poor|worse|worst|fail|failed|error|broken|confused|confusing|irrelevant""".split("|")
SEPARATORS = r"[\p{P}\p{S}\s]+"


def tokenize(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case runs between white space, punctuation and symbols, less stop words."""
    stop = F.array(*[F.lit(w) for w in (STOPWORDS if stopwords is None else stopwords)])
    words = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w)) if stopwords != [] else F.filter(words, lambda w: w != "")


def tokenize_terms(text: Column, stopwords: list[str]) -> Column:
    """Lower-case runs of letters and digits of more than two bytes, less stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~F.array_contains(stop, w))


def term_hash(term: Column) -> Column:
    """h = 33 h + code point, from 5381, in 32 bits without sign."""
    points = F.transform(F.filter(F.split(term, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF)))


def hash_terms(terms: pd.Series) -> np.ndarray:
    """term_hash of many terms at once, a character place at a time over the whole batch; of a null 5381."""
    sizes = terms.str.len().fillna(-1).to_numpy(dtype=np.int64) if len(terms) else np.zeros(0, dtype=np.int64)
    points = np.frombuffer("".join(t for t in terms if t is not None).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))[:-1]))
    h = np.full(len(terms), 5381, dtype=np.uint64)
    for k in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > k)
        h[on] = (h[on] * np.uint64(33) + points[starts[on] + k]) & np.uint64(0xFFFFFFFF)
    return h.astype(np.int64)


@F.pandas_udf(T.LongType())
def term_hashes(terms: pd.Series) -> pd.Series:
    """term_hash of many terms at once; a null stays one."""
    return pd.Series(hash_terms(terms)).where(terms.notna().to_numpy(), None).astype("Int64")


def term_bucket(term: Column, dim: int) -> Column:
    return (term_hashes(term) % F.lit(dim)).cast("int")


def term_counts(words: Column, dim: int) -> Column:
    """Hashed terms i, ascending, with their counts n, of an array of words; words that share a bucket add up. Counted in the row, a word of a batch is hashed once."""

    @F.arrow_udf("array<struct<i:int,n:bigint>>")
    def count(lists: pa.Array) -> pa.Array:
        known = lists.flatten().dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        buckets = hash_terms(known.dictionary.to_pandas()) % dim
        at = np.repeat(np.arange(len(lists), dtype=np.int64), sizes) * dim + buckets[known.indices.to_numpy(zero_copy_only=False)]
        at, n = np.unique(at, return_counts=True)
        ends = np.searchsorted(at, np.arange(len(lists) + 1, dtype=np.int64) * dim).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array((at % dim).astype(np.int32)), pa.array(n.astype(np.int64))], names=["i", "n"])
        return pa.ListArray.from_arrays(pa.array(ends), pairs)

    return count(words)


def query_hash(query: Column) -> Column:
    return F.substring(F.sha2(query.cast("binary"), 256), 1, 16)


def chunk_id(text: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat(text, F.lit(":"), index.cast("string")).cast("binary"), 256), 1, 16)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("long")


def sentiment(text: Column) -> Column:
    """0.2 for each positive and -0.25 for each negative word that occurs anywhere, also inside others, cut to -1..1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(low.contains(w), F.lit(4)).otherwise(F.lit(0)) for w in POSITIVE] + [F.when(low.contains(w), F.lit(-5)).otherwise(F.lit(0)) for w in NEGATIVE]
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum(hits[1:], hits[0]) / F.lit(20.0)))


def clean_fences(text: Column) -> Column:
    """Text without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:glyph|json|text)?\s*", ""), r"\s*```$", ""))


def parse_pairs(text: Column) -> Column:
    """`k=v,k2=v2` as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All character n-grams of low to high letters."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in range(low, high + 1)]
    return F.concat(*grams)


def glyph_rows(results: DataFrame, id_col: str = "id", score_col: str = "score", metadata_col: str | None = None) -> DataFrame:
    """A ranked page as one tabular text: a head line, a line per row by rank, an end line. Pages are small (top-k)."""
    meta = F.coalesce(F.col(metadata_col), F.lit("{}")) if metadata_col else F.lit("{}")
    line = F.concat_ws(" ", F.col(id_col).cast("string"), F.format_string("%.4f", F.col(score_col)), meta)
    rows = results.select(F.struct(F.col("rank").alias("r"), line.alias("line")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    body = F.transform("xs", lambda x: x["line"])
    return rows.select(F.array_join(F.concat(F.array(F.lit("@tab SearchResult [id score metadata]")), body, F.array(F.lit("@end"))), "\n").alias("glyph"))


def glyph_map(pairs: Column) -> Column:
    """A string map as {key:"value" ...} in key order."""
    items = F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit(':"'), F.regexp_replace(e["value"], '(["\\\\])', "\\\\$1"), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(items, " "), F.lit("}"))


def parse_glyph(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, section, row number, cells) of `@tab Name [columns] ... @end` blocks; cells are words, quoted strings or [lists]."""
    blocks = texts.select(key, F.posexplode(F.regexp_extract_all(clean_fences(F.col(text)), F.lit(r"(?s)@tab\s+\w+\s*\[[^\]]*\].*?@end"), F.lit(0))).alias("block", "b"))
    rows = blocks.select(
        key,
        "block",
        F.regexp_extract("b", r"@tab\s+(\w+)", 1).alias("section"),
        F.split(F.trim(F.regexp_extract("b", r"\[([^\]]*)\]", 1)), r"\s+").alias("columns"),
        F.posexplode(F.filter(F.transform(F.split(F.regexp_extract("b", r"(?s)^@tab[^\n]*\n(.*)@end$", 1), "\n"), F.trim), lambda x: x != "")).alias("row", "line"),
    )
    cell = r"\"(?:[^\"\\]|\\.)*\"|\[[^\]]*\]|[^\s]+"
    cells = F.transform(F.regexp_extract_all("line", F.lit(cell), F.lit(0)), lambda c: F.when(c.startswith('"'), F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), r"\\(.)", "$1")).otherwise(c))
    return rows.select(key, "section", "block", "row", F.map_from_entries(F.filter(F.arrays_zip(F.col("columns").alias("k"), cells.alias("v")), lambda e: e["k"].isNotNull())).alias("cells"))


# -- chunkers: stateful walks over a text's sentences, so Arrow batches of texts --------------------------------------


def sentences(text: str) -> list[str]:
    """Trimmed sentences, ended by . ! ? or a line feed; a full stop before a small letter or digit ends none."""
    out, start = [], 0
    for i, c in enumerate(text):
        if c in ".!?\n" and not (c == "." and text[i + 1 : i + 2] and ("a" <= text[i + 1] <= "z" or "0" <= text[i + 1] <= "9")):
            out.append(text[start : i + 1].strip())
            start = i + 1
    out.append(text[start:].strip())
    return [s for s in out if s]


def _by_words(text: str, size: int) -> list[str]:
    out: list[list[str]] = [[]]
    used = 0
    for word in text.split():
        n = len(word.encode())
        if used and used + n + 1 > size:
            out.append([])
            used = 0
        used += n + (1 if used else 0)
        out[-1].append(word)
    return [" ".join(x) for x in out if x]


def embedding_chunks(text: str | None, size: int, overlap: int = 200) -> list[str]:
    """Sentences packed up to `size` bytes; a chunk opens with the words that end the one before (overlap); long sentences are cut at words."""
    text = text or ""
    if len(text.encode()) <= size:
        return [text]
    out: list[str] = []
    held, used = "", 0
    for s in sentences(text):
        n = len(s.encode())
        if n > size:
            if used:
                out.append(held.strip())
            held, used = "", 0
            out += _by_words(s, size)
            continue
        if used and used + n > size:
            done = held.strip()
            out.append(done)
            held, used = "", 0
            if 0 < overlap < len(done.encode()):
                tail = done.encode()[-overlap:].decode("utf-8", "ignore")
                if (at := tail.rfind(" ")) > 0:
                    tail = tail[at + 1 :]
                held, used = tail + " ", len(tail.encode()) + 1
        held += s + " "
        used += n + 1
    return out + [held.strip()] if used else out


def extraction_sentences(text: str) -> list[str]:
    """Sentences with their ends: after . ! ? before a space, line feed or the end, and at blank lines; one space after an end is dropped."""
    out, start, i = [], 0, 0
    while i < len(text):
        c = text[i]
        if c in ".!?" and (i + 1 == len(text) or text[i + 1] in " \n"):
            out.append(text[start : i + 1])
            i += 1 if text[i + 1 : i + 2] == " " else 0
            start = i + 1
        elif c == "\n" and text[i + 1 : i + 2] == "\n":
            out.append(text[start : i + 1])
            start = i + 1
        i += 1
    return out + [text[start:]] if start < len(text) else out


def extraction_chunks(text: str | None, size: int = 2000, overlap: int = 200) -> list[tuple[int, int, str]]:
    """(index, offset, chunk) with sentences packed up to `size` bytes; a chunk opens with the last bytes of the one before."""
    overlap = max(0, overlap) if overlap < size else size // 4
    out: list[tuple[int, int, str]] = []
    held, start, at = b"", 0, 0
    for s in map(str.encode, extraction_sentences(text or "")):
        if held and len(held) + len(s) > size:
            out.append((len(out), start, held.decode("utf-8", "ignore")))
            held = held[-overlap:] if overlap else b""
            start = at - len(held)
        held += s
        at += len(s)
    return out + [(len(out), start, held.decode("utf-8", "ignore"))] if held else out


#: Bytes of chunks that a worker holds before it sends them on.
PIECE = 1 << 20


def _cut(docs: DataFrame, key: str, text: str, cut: Callable[[str | None], Iterator[tuple]], columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """key and the columns of every row that `cut` makes of a text: a text at a time, sent on whenever PIECE bytes of chunks are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            size = 0

            def piece(keys: pa.Array = batch.column(0)) -> pa.RecordBatch:
                cells = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *cells], names=[key, *columns])

            for i, t in enumerate(batch.column(1)):
                for row in cut(t.as_py()):
                    at.append(i)
                    rows.append(row)
                    size += 64 + len(row[-1])
                    if size >= PIECE:
                        yield piece()
                        at, rows, size = [], [], 0
            if rows:
                yield piece()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}")


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2000, overlap: int = 200) -> DataFrame:
    """key, index, offset, chunk_id and chunk of every text, for extraction. Null texts have none."""

    def cut(t: str | None) -> Iterator[tuple]:
        whole = hashlib.sha256((t or "").encode())  # chunk_id of each chunk goes on from here, so that no chunk carries its text along
        for i, o, c in extraction_chunks(t, size, overlap):
            named = whole.copy()
            named.update(f":{i}".encode())
            yield i, o, named.hexdigest()[:16], c

    columns = {"index": pa.int32(), "offset": pa.int32(), "chunk_id": pa.string(), "chunk": pa.string()}
    return _cut(docs, key, text, cut, columns, "index int, offset int, chunk_id string, chunk string")


def chunk_for_embedding(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """key, index and chunk of every text, for embedding."""
    return _cut(docs, key, text, lambda t: enumerate(embedding_chunks(t, size, overlap)), {"index": pa.int32(), "chunk": pa.string()}, "index int, chunk string")
