"""Token-id files with Elias-Fano document boundaries.

A file is a run of blocks, each followed by one line feed (the text writer's line separator, which lets Spark's own
commit protocol write the raw bytes to any file system it knows). A block:

    8 bytes   magic b"EFTOKEN1"
    8 x u64   shard, block, documents, ids, bytes per id, null ids at the front, bytes of each of the two sequences
    ...       Elias-Fano sequence of the document ends (ids of the block before the end of each document)
    ...       Elias-Fano sequence of the doc_ids (less the smallest), after an i64 with the smallest
    ...       concatenated ids, little-endian, 2 bytes each where the vocabulary allows it, else 4

An Elias-Fano sequence of n values up to u takes about 2 + log2(u / n) bits a value: the low bits of each value lie
in a packed array, the high bits as unary gaps in a bit vector; a sample of the positions of every 64th set bit
makes select, and so any document's offset, constant time without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, delete_path, materialize, scratch_path, slices
from .tokens import encoder

MAGIC = b"EFTOKEN1"
HEAD = struct.Struct("<8s8Q")
SAMPLE = 64
#: Ids of a block at most, unless one document has more.
BLOCK_IDS = 1 << 20
#: Bytes of text that a file holds about; the number of files grows with the input.
FILE_BYTES = 24 << 20


class EliasFano:
    """A non-decreasing sequence of unsigned integers."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) + 1 if n else 0), dtype=np.uint8)
        bits[at] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<4Q", self.n, self.width, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        n, width, low, high = struct.unpack_from("<4Q", data)
        raw = np.frombuffer(data, dtype=np.uint8)
        samples = np.frombuffer(raw[32 + low + high : 32 + low + high + 4 * (-(-n // SAMPLE))].tobytes(), dtype="<u4")
        return cls(n, width, raw[32 : 32 + low], raw[32 + low : 32 + low + high], samples)

    def _low_of(self, i: int) -> int:
        value = 0
        for k in range(self.width):
            bit = i * self.width + k
            value |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return value

    def select(self, i: int) -> int:
        """The i-th value: a sampled position, then at most SAMPLE set bits are passed."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        position = 8 * byte + (word & -word).bit_length() - 1
        return (position - i) << self.width | self._low_of(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        bits = np.unpackbits(self.high, bitorder="little")
        high = (np.flatnonzero(bits)[: self.n] - np.arange(self.n)).astype(np.uint64)
        low = np.unpackbits(self.low, count=self.n * self.width, bitorder="little").reshape(self.n, self.width)
        out = high << np.uint64(self.width)
        for k in range(self.width):
            out |= low[:, k].astype(np.uint64) << np.uint64(k)
        return out


def encode_block(shard: int, block: int, doc_ids: list[int | None], ids: list[bytes], id_bytes: int) -> bytes:
    """A block of documents in ascending doc_id order, null doc_ids first."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids])).to_bytes()
    names = struct.pack("<q", base) + EliasFano.of((known - base).astype(np.uint64)).to_bytes()
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    head = HEAD.pack(MAGIC, shard, block, len(doc_ids), len(flat), id_bytes, nulls, len(ends), len(names))
    return head + ends + names + flat.astype(f"<u{id_bytes}").tobytes()


def read_blocks(content: bytes) -> Iterator[tuple[int, int, list[int | None], EliasFano, np.ndarray]]:
    """(shard, block, doc_ids, document ends, ids) of each block of a file."""
    at = 0
    while at < len(content):
        magic, shard, block, n, total, id_bytes, nulls, ends, names = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at += HEAD.size
        view = memoryview(content)
        boundary = EliasFano.from_bytes(view[at : at + ends])
        (base,) = struct.unpack_from("<q", content, at + ends)
        known = (EliasFano.from_bytes(view[at + ends + 8 : at + ends + names]).values().astype(np.int64) + base).tolist()
        at += ends + names
        ids = np.frombuffer(content, dtype=f"<u{id_bytes}", count=total, offset=at)
        at += total * id_bytes + 1  # and the line feed
        yield shard, block, [None] * nulls + known, boundary, ids


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, files: int | None = None) -> None:
    """Write all documents' ids to `path` in ascending doc_id order (null first; ties by text).

    docs needs doc_id and text; other columns are ignored. A null or empty text is the end id alone; repeated rows are
    written as often as they occur; an empty table writes no block.
    """
    bound_batches(docs.sparkSession)
    if files is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-size // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        id_bytes = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], dtype="<u4").tobytes()
        shard, block, held, names, ids = TaskContext.get().partitionId(), 0, 0, [], []
        for part in slices(batches, "text", 4 << 20):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                names.append(doc)
                ids.append(coder.encode(text) + end)
                held += len(ids[-1]) // 4
                if held >= BLOCK_IDS:
                    yield pa.RecordBatch.from_pydict({"block": [encode_block(shard, block, names, ids, id_bytes)]})
                    block, held, names, ids = block + 1, 0, [], []
        if names:
            yield pa.RecordBatch.from_pydict({"block": [encode_block(shard, block, names, ids, id_bytes)]})

    dealt = docs.select("doc_id", "text").repartitionByRange(int(files), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("compression", "none").text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files at `path`, from their boundaries and ids.

    Null doc_ids come back as null, repeated rows as often as they were written; a folder without blocks gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for shard, block, names, boundary, ids in read_blocks(content.as_py()):
                    ends = boundary.values().astype(np.int64)
                    starts = np.concatenate(([0], ends[:-1]))
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    n = len(names)
                    columns = [np.full(n, shard), np.full(n, block), names, starts, ends - starts, crc]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(run, "shard long, block long, doc_id long, within long, n_tokens long, ids_crc32 long"), "op5-rows")
    blocks = rows.groupBy("shard", "block").agg(F.sum("n_tokens").alias("ids"))
    shards = blocks.groupBy("shard").agg(F.sum("ids").alias("ids"))
    # one row per file: the only ordering that spans the files
    bases = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    inner = Window.partitionBy("shard").orderBy("block")
    starts = blocks.select("shard", "block", (F.sum("ids").over(inner) - F.col("ids")).alias("inner")).join(bases, "shard")
    starts = starts.select("shard", "block", (F.col("base") + F.col("inner")).alias("before"))
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, keep: bool = False) -> DataFrame:
    """Write all documents to token-id files in the shared folder and return what is read back from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "op5-files")
    write_token_files(docs, path, tokenizer, end_id)
    found = read_token_files(spark, path)
    if not keep:  # the rows read back are a table of their own
        delete_path(spark, path)
    return found
