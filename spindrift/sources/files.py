"""Readers and writers: JSON lines, binary vector files, markdown vaults, snapshots, change logs, exports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# -- JSON lines ---------------------------------------------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """id, text, meta and collection of documents given as {id, doc or text, meta, collection}; bad lines and empty texts are left out."""
    schema = "id string, doc string, text string, meta map<string,string>, collection string, _corrupt string"
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema).json(path)
    rows = rows.filter("_corrupt is null").select("id", F.coalesce("doc", "text").alias("text"), "meta", "collection")
    return rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


# -- binary vectors -----------------------------------------------------------------------------------------------------


def read_fvecs(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """embedding of each record (int32 dimension, then float32 values) and its place; files are cut at record bounds, so large ones are read in parallel."""
    size = 4 * (dim + 1)
    records = spark.sparkContext.binaryRecords(path, size)  # the one input format that splits fixed-length records
    rows = records.zipWithIndex().map(lambda x: (x[1], bytearray(x[0]))).toDF("id long, record binary")

    @F.pandas_udf("array<float>")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda b: np.frombuffer(b, dtype="<f4", offset=4).tolist())

    return rows.select("id", decode("record").alias("embedding"))


def fvecs_bytes(vectors: np.ndarray) -> bytes:
    vectors = np.asarray(vectors, dtype="<f4")
    return b"".join(struct.pack("<i", vectors.shape[1]) + row.tobytes() for row in vectors)


def read_binary_import(spark: SparkSession, path: str) -> DataFrame:
    """id and embedding of bulk files: uint32 count and dimension, then uint64 id and float32 values of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                n, dim = struct.unpack_from("<II", content)
                if len(content) != 8 + n * (8 + 4 * dim):
                    raise ValueError("bulk file of the wrong length")
                rows = np.frombuffer(content, dtype=np.dtype([("id", "<u8"), ("v", "<f4", (dim,))]), offset=8)
                for at in range(0, n, 4096):
                    part = rows[at : at + 4096]
                    yield pd.DataFrame({"id": part["id"].astype(np.int64), "embedding": list(part["v"])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, embedding array<float>")


def binary_import_bytes(ids: list[int], vectors: np.ndarray) -> bytes:
    vectors = np.asarray(vectors, dtype="<f4")
    head = struct.pack("<II", *vectors.shape)
    return head + b"".join(struct.pack("<Q", i) + row.tobytes() for i, row in zip(ids, vectors, strict=True))


# -- markdown vaults ----------------------------------------------------------------------------------------------------

LINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"
TAG = r"(?:^|\s)#([\p{L}][\p{L}\p{N}_/-]*)"


def read_vault(spark: SparkSession, path: str, exclude: tuple[str, ...] = (".obsidian", ".trash", ".git"), newer: Column | None = None) -> DataFrame:
    """path, modified, size and content of the markdown files under a folder, less those in excluded folders (and, for a sync, older ones)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    for name in exclude:
        rows = rows.filter(~F.col("path").contains(f"/{name}/"))
    rows = rows.filter(F.col("modificationTime") > newer) if newer is not None else rows
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))


def front_matter(content: Column) -> Column:
    """The block between the first two --- lines; empty without one."""
    return F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---", 1)


def body(content: Column) -> Column:
    return F.regexp_replace(content, r"(?s)\A---\n.*?\n---\n?", "")


def entry(block: Column, *names: str) -> Column:
    """A front-matter value, without quotes; null if it is missing or empty."""
    got = F.regexp_extract(block, r"(?m)^\s*(?:" + "|".join(names) + r")\s*:[ \t]*(.*)$", 1)
    return F.nullif(F.trim(F.regexp_replace(got, "[\"']", "")), F.lit(""))


def note_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def tags(block: Column, text: Column) -> Column:
    """Front-matter tags (inline or listed) and inline #tags in order of appearance, the first spelling of each."""
    inline = F.split(F.regexp_replace(F.coalesce(entry(block, "tags"), F.lit("")), r"[\[\]]", ""), ",")
    listed = F.regexp_extract_all(F.regexp_extract(block, r"(?ms)^\s*tags\s*:\s*\n((?:\s*-\s+.*(?:\n|\z))+)", 1), F.lit(r"(?m)-\s+(.*)$"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(r"^#(?:$|[ #])"))
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(TAG), F.lit(1))))
    every = F.filter(F.transform(F.concat(inline, listed, found), lambda t: F.regexp_replace(F.trim(t), "^#", "")), lambda t: t != "")
    lower = F.transform(every, F.lower)
    return F.filter(every, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)


def links(text: Column) -> Column:
    """Names of linked notes, without folders, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.element_at(F.split(F.trim(x), "/"), -1)))


def parse_notes(files: DataFrame, strip: bool = True) -> DataFrame:
    """path, name, title, author, created, zettel_id, tags, links and content of notes (path, content, modified)."""
    block, text = front_matter(F.col("content")), body(F.col("content"))
    name = note_name(F.col("path"))
    zettel = F.nullif(F.regexp_extract(name, r"^(\d{12,14})", 1), F.lit(""))
    author = F.regexp_replace(entry(block, "author"), r"\[\[|\]\]", "")
    return files.select(
        "path",
        name.alias("name"),
        F.coalesce(entry(block, "title"), name).alias("title"),
        author.alias("author"),
        F.coalesce(entry(block, "created", "date"), F.date_format("modified", "yyyy-MM-dd")).alias("created"),
        F.coalesce(entry(block, "zettelkasten_id", "uid", "zettel"), zettel).alias("zettel_id"),
        tags(block, text).alias("tags"),
        links(text).alias("links"),
        (text if strip else F.col("content")).alias("content"),
    )


def backlinks(notes: DataFrame) -> DataFrame:
    """notes with `backlinks`, the names of the notes that link to them."""
    back = notes.select(F.col("name").alias("source"), F.explode("links").alias("target")).groupBy("target").agg(F.sort_array(F.collect_set("source")).alias("backlinks"))
    return notes.join(back.withColumnRenamed("target", "name"), "name", "left").withColumn("backlinks", F.coalesce("backlinks", F.array().cast("array<string>")))


def orphans(docs: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Documents whose file is gone."""
    return docs.join(files.select(key), key, "left_anti")


def sync_plan(docs: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """path and action (`add`, `update` or `delete`) that bring docs (path, modified) up to the files found (path, modified)."""
    both = docs.select(key, F.col("modified").alias("had")).join(found.select(key, F.col("modified").alias("has")), key, "full_outer")
    action = F.when(F.col("had").isNull(), "add").when(F.col("has").isNull(), "delete").when(F.col("has") > F.col("had"), "update")
    return both.select(key, action.alias("action")).filter("action is not null")


# -- snapshots, exports, logs -------------------------------------------------------------------------------------------


def save_snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet with zstd: columns are read singly, so vectors cost nothing unless they are asked for."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def load_snapshot(spark: SparkSession, path: str, formats: tuple[str, ...] = ("parquet", "orc", "json")) -> DataFrame:
    """A snapshot in the first format that reads."""
    from pyspark.errors import AnalysisException

    for f in formats:
        try:
            return spark.read.format(f).load(path)
        except AnalysisException:
            continue
    raise ValueError(f"no snapshot of a known format at {path}")


def export_collection(docs: DataFrame, collection: str, path: str) -> str:
    """Live rows of a collection as JSON; returns a checksum that doesn't depend on their order."""
    rows = docs.filter((F.col("collection") == collection) & ~F.col("deleted"))
    rows.write.mode("overwrite").json(path)
    return checksum(rows)


def checksum(rows: DataFrame) -> str:
    return str(rows.agg(F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)")), F.lit(0))).first()[0])


def import_collection(spark: SparkSession, path: str, schema: str, expected: str | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    if expected is not None and checksum(rows) != expected:
        raise ValueError("checksum differs")
    return rows


def write_costs(ops: DataFrame, path: str) -> None:
    ops.write.mode("overwrite").option("header", True).csv(path)


LOG_SCHEMA = "seq long, op string, id string, doc string, meta map<string,string>, vec array<float>, coll string, tenant string, time long"


def read_log(spark: SparkSession, path: str, from_seq: int = 0) -> DataFrame:
    """Change-log records from a sequence number on, in order; torn lines are left out."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter(F.col("seq") >= from_seq).orderBy("seq")


def since(log: DataFrame, seq: int) -> DataFrame:
    """Entries after a sequence number; an error if some of them have been trimmed already."""
    first = log.agg(F.min("seq")).first()[0]
    if first is not None and first > seq + 1:
        raise ValueError(f"the log begins at {first}; a follower at {seq} needs a snapshot")
    return log.filter(F.col("seq") > seq).orderBy("seq")


def log_stats(log: DataFrame) -> DataFrame:
    """One row: first and last sequence number and the number of operations of each kind."""
    return log.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("entries"), *[F.count_if(F.col("op") == x).alias(x) for x in ("insert", "upsert", "delete")])


def truncate_log(log: DataFrame, before: int) -> DataFrame:
    return log.filter(F.col("seq") >= before)


def sparse_json(s: Column) -> Column:
    return F.to_json(s)


def parse_sparse_json(text: Column) -> Column:
    return F.from_json(text, "struct<indices:array<int>,values:array<float>,dim:int>")
