"""Shared plumbing of the training-data operators: tables, shared folders, bounded Arrow slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
#: Bytes of an Arrow batch between the JVM and Python: batches of long texts hold fewer rows.
BATCH_BYTES = 4 << 20
#: Rows of a batch of a Parquet scan.
SCAN_ROWS = 512
#: Bytes of input below which no table derived from it gets one more file.
LEAST_FILE = 32 << 20
#: What a Python worker remembers between tasks, by operator: how to forget it.
CACHES: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes and the scan's batches by rows, unless the session bounds them more tightly.

    A scan keeps arrays as large as the texts of its largest batch, so batches of few rows bound what long texts take.
    The settings stay with the session, as plans are run after the operator returns.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > SCAN_ROWS:
        spark.conf.set(key, str(SCAN_ROWS))


def forget_others(name: str) -> None:
    """Called where a task starts: workers are reused, so what other operators' tasks remember in this one goes."""
    for other, forget in CACHES.items():
        if other != name:
            forget()
    give_back()


def give_back() -> None:
    """Free memory goes back to the system, which allocators keep from task to task otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries do without
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIR:
        _OWN_DIR[key] = "file://" + tempfile.mkdtemp(prefix="spindrift-")
    return _OWN_DIR[key]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def file_count(like: DataFrame) -> int:
    """Files for a table that grows as `like` does: one for each input split (of LEAST_FILE at least) of its estimated size, and one for each core at least."""
    spark = like.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(spark.sparkContext.defaultParallelism, -(-size // max(split, LEAST_FILE))), 1 << 20)  # a plan of unknown size counts as huge


def few_files(df: DataFrame, like: DataFrame) -> DataFrame:
    """df in file_count(like) partitions at most, so that no write leaves many small files."""
    return df.coalesce(file_count(like))


def materialize(df: DataFrame, tag: str, files: int | None = None, path: str | None = None) -> DataFrame:
    """Write df as a table (of at most `files` files) in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, tag)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's file system, wherever it lives."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one run of an operator in the shared folder; all but the kept one are deleted when it is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
        """df as a table, see materialize."""
        path = scratch_path(self.spark, tag)
        found = materialize(df, tag, files, path)
        self.tables.append((found, path))
        return found

    def drop(self, *tables: DataFrame) -> None:
        for entry in [x for x in self.tables if any(x[0] is t for t in tables)]:
            delete_path(self.spark, entry[1])
            self.tables.remove(entry)

    def keep(self, df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
        """df as a table that outlives the run, the operator's result; everything else is deleted."""
        found = materialize(df, tag, files)
        self.drop(*[x[0] for x in self.tables])
        return found


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice hold max_bytes at most (or are a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
            yield batch.slice(at, end - at)
            at = end


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null as empty) and the offsets of its rows in them."""
    array = pc.fill_null(array, "") if array.null_count else array
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    large = pa.types.is_large_string(array.type)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]
