"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are tokenised where they lie. A document's full windows become sequences of their own; its rest is cut into
pieces of a quarter window at most, and GROUP pieces at a time are packed into near-equal windows: every piece starts as
a partial partition, and the two partials with the largest imbalance are merged with opposing loads until one is left.
Where a window exceeds the capacity, the window count rises and the differencing starts again; as pieces are small
against a window, it seldom rises more than once, and padding stays below some hundredths. (With cut=True the excess is
cut off instead and poured into windows with room.) There is no shuffle and no global state: a group never spans
partitions, memory is bounded by GROUP windows, and a retried task gives the same sequences.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bound_batches, slices
from .tokens import encoder

#: Pieces that are packed together, and how many of the largest fill a window.
GROUP = 1024
PARTS = 4
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: the items of each of `windows` near-equal windows.

    A partial partition holds its non-zero loads in falling order, with the items behind each load. Partials are
    taken by falling imbalance (largest load less smallest, zero while a load is empty); ties fall by first item,
    so that equal inputs give equal windows. Empty input gives empty windows.
    """
    if windows < 1:
        return []
    tick = itertools.count()
    heap = [(-size, next(tick), [(size, [i])]) for i, size in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0]))]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = windows - len(b)  # empty loads of b, which meet the largest loads of a
        merged = a[:free]
        for i in range(free, max(len(a), windows if b else free)):
            rest = b[windows - 1 - i] if 0 <= windows - 1 - i < len(b) else (0, [])
            mine = a[i] if i < len(a) else (0, [])
            merged.append((mine[0] + rest[0], mine[1] + rest[1]))
        merged = sorted((x for x in merged if x[1]), key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (-(merged[0][0] - least), next(tick), merged))
    loads = heap[0][2] if heap else []
    return [items for _, items in loads] + [[] for _ in range(windows - len(loads))]


def pack(sizes: list[int], capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in the item, length), each at most capacity.

    Sizes are positive and, without cutting, at most capacity. Ties and repeated sizes are fine; no item, no window.
    """
    total = sum(sizes)
    windows = -(-total // capacity)
    while True:
        found = difference(sizes, windows)
        if cut or all(sum(sizes[i] for i in w) <= capacity for w in found):
            break
        windows += 1
    out: list[list[tuple[int, int, int]]] = []
    excess: list[tuple[int, int, int]] = []
    room: list[list[int]] = []
    for w in found:
        used, placed = 0, []
        for i in w:
            keep = min(sizes[i], capacity - used)
            if keep:
                placed.append((i, 0, keep))
            if keep < sizes[i]:
                excess.append((i, keep, sizes[i] - keep))
            used += keep
        out.append(placed)
        if used < capacity:
            room.append([len(out) - 1, capacity - used])
    room.sort(key=lambda x: -x[1])
    for i, start, length in excess:
        while length:
            if not room:  # the window count rises
                out.append([])
                room.append([len(out) - 1, capacity])
            window, space = room[-1]
            take = min(space, length)
            out[window].append((i, start, take))
            start, length = start + take, length - take
            room[-1][1] -= take
            if not room[-1][1]:
                room.pop()
    return [w for w in out if w]


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, cut: bool = False, group: int = GROUP) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` ids (SCHEMA); with `cut`, overflowing windows are cut instead of opening more.

    docs needs doc_id and text; other columns, whatever their names, are ignored. A null or empty text is the end id
    alone; a null doc_id is kept as null; repeated rows are packed as often as they occur; no row, no piece.
    """

    piece = max(1, capacity // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        waiting: list[tuple] = []
        numbers = itertools.count(base)

        def settle() -> None:
            for window in pack([len(x[3]) // 4 for x in waiting], capacity, cut):
                number, offset = next(numbers), 0
                for i, start, length in window:
                    doc, first, total, ids = waiting[i]
                    rows.append((doc, first + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, number, offset))
                    offset += length
            waiting.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for part in slices(batches, "text", 4 << 20):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                total = len(ids) // 4
                full = total - total % capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, next(numbers), 0))
                for start in range(full, total, piece):
                    waiting.append((doc, start, total, ids[4 * start : 4 * min(total, start + piece)]))
                    if len(waiting) >= group:
                        settle()
            yield flush()
        settle()
        yield flush()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
