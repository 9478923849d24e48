"""N-gram Jaccard self-join by size-banded tiles with hashed bitmap signatures.

Two sets are linked when 100 * |x & y| >= PERCENT * |x | y|. No link is lost, no set of rows is compared all with all:

1.  One pass over the texts gives each document the size of its shingle set, a fingerprint of the set (its key) and a
    parity bitmap. Equal sets form a class, which takes part as one node from here on, named by its key.
2.  Sizes are cut into bands of the ratio that links allow, so that linked sets lie in the same band or in adjacent
    ones; tile b joins band b with itself and with band b - 1. Linked sets of tile b differ in at most H(b) shingles.
    Dealing each set's shingles into buckets by hash leaves at least one filled bucket alike in both wherever one of
    them fills more than H(b) buckets (pigeonhole), so every set posts the hash of each of its buckets, and only sets
    that share a posting are compared. There are a few levels of buckets, and a set posts up to the first level at
    which it fills enough of them: its rarer shingles alone (those that very many documents hold are left out; dropping
    them from both sets cannot raise their difference), in finer and finer buckets, at last one by one, then the same
    with all its shingles.
3.  Postings name their set by its key, so copies in other tasks add nothing. They travel as sorted binary blocks by
    hash range and are read in chunks of a bounded size, whatever one hash holds. A group (the sets of one posting)
    gives one row per member with the group's pivot, and, beyond two members, one row of membership, so that what is
    made grows with the postings alone; groups of the same members are one group.
4.  A candidate's sizes and the bit count of its two bitmaps' difference bound the overlap from above; pairs that
    pass are settled by exact intersection of the sorted shingle arrays.
5.  Members of a group that the links found so far do not yet bring into one component are compared in further rounds:
    those outside the group's largest component with all others, in tiles of a bounded size, by sizes and bitmaps
    before a row is made. As one link joins two components, a member gives only its few most alike others in a tile;
    groups in which one had more come again with the components that these links made, and with a higher limit, until
    none is cut short. So every pair that could join two components is tested, and those that no longer can make no row.
6.  Components by alternating large-star and small-star rounds over the links.

Shingles are 64-bit hashes; two different ones agree with probability 2^-64 (sets with 2^-63).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, file_count, forget_others, give_back, slices
from .shingles import U, mix, shingle_sets

WORDS = 5
PERCENT = 80
#: Bits of a parity bitmap.
BITS = 1024
#: A shingle in more than this share of the documents is left out of buckets; at most HEAVY_MAX of them are (a speed-up: any such set gives the same links).
HEAVY_SHARE = 0.0005
HEAVY_MAX = 400_000
#: Shingles that are counted together when frequent ones are looked for.
COUNT_WINDOW = 4_000_000
#: Members of a group in a block of a tile, about.
TILE = 2048
#: Tiles of up to so many rows are compared many at once.
SMALL_TILE = 24
#: Pairs that a member gives in a tile in the first of the rounds across components, and how the limit grows by round.
FIRST_PAIRS = 4
MORE_PAIRS = 32
#: Postings that a task holds before it sends them, that a range of hashes holds about, and that are read at once.
FLUSH = 1_000_000
RANGE = 1_000_000
CHUNK = 2_000_000
#: Slots of the filter by which texts of candidates are picked (1 MB, whatever the input).
SLOTS = (1 << 23) - 15
TEXT_SLICE = 2 << 20


def bands(percent: int, top: int) -> np.ndarray:
    """Lower bounds of the size bands up to `top`: a set's links reach no further than the next band."""
    low = [1, 2]
    while low[-1] <= top:
        low.append(max(low[-1] + 1, (low[-1] - 1) * 100 // percent + 1))
    return np.array(low, dtype=np.int64)


def difference_bound(low: np.ndarray, percent: int) -> np.ndarray:
    """H(b): most shingles in which two linked sets of tile b differ."""
    sums = 2 * (low[1:, None] - 1) - np.arange(16)
    shared = -(-percent * sums // (100 + percent))
    return np.where(sums > 0, sums - 2 * shared, 0).max(axis=1)


def set_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each set, an even number; 0 or any for empty sets."""
    mixed, sums = mix(flat + U(0x51ED270B)), np.zeros(len(counts), dtype=np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        sums[filled] = np.add.reduceat(mixed, np.concatenate(([0], np.cumsum(counts)))[filled])
    return mix(sums + counts.astype(np.uint64)) & ~U(1)


def set_profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """For each document (kind 0): doc_id, n, key of its shingle set, bitmap; for each frequent shingle of a window of documents (kind 1): its hash as key, n documents."""

    names = ["kind", "doc_id", "n", "key", "bitmap"]

    def frequent(held: list[np.ndarray], n: int) -> pa.RecordBatch:
        every = np.concatenate(held)
        held.clear()
        every.sort()
        common = np.unique(every[2:][every[2:] == every[:-2]])  # those that occur three times
        times = np.searchsorted(every, common, side="right") - np.searchsorted(every, common)
        often = times >= max(3, HEAVY_SHARE * n)
        common, times = common[often].view(np.int64), times[often]
        none = len(common)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(none), pa.int32()), pa.nulls(none, pa.int64()), pa.array(times, pa.int64()), pa.array(common, pa.int64()), pa.nulls(none, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("shingles")
        held: list[np.ndarray] = []
        size = rows = 0
        for part in slices(batches, "text", TEXT_SLICE):
            flat, counts = shingle_sets(part.column("text"), words)
            n = len(counts)
            held.append(flat)
            size, rows = size + len(flat), rows + n
            doc = np.repeat(np.arange(n), counts)
            bits = np.bincount(doc * BITS + (flat & U(BITS - 1)).astype(np.int64), minlength=n * BITS).reshape(n, BITS) & 1
            maps = np.packbits(bits.astype(np.uint8), axis=1)
            keys = set_keys(flat, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(n), pa.int32()),
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array([m.tobytes() for m in maps], pa.binary()),
                ],
                names=names,
            )
            if size >= COUNT_WINDOW:
                yield frequent(held, rows)
                held, size, rows = [], 0, 0
        if held:
            yield frequent(held, rows)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, key long, bitmap binary")


def _buckets(flat: np.ndarray, doc: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First element, owner and number of each filled bucket; wide is the number of buckets for each element's set."""
    if not len(flat):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    bucket = ((flat >> U(32)) * wide.astype(np.uint64)) >> U(32)
    new = np.ones(len(flat), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return first, doc[first], bucket[first]


def postings(flat: np.ndarray, counts: np.ndarray, heavy: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner (twice the number of the set, and 1 more where it is a guest from the band below) of every posting of the given sets."""
    low = bands(percent, max(2, 2 * int(counts.max(initial=1))))
    most = difference_bound(low, percent)
    doc = np.repeat(np.arange(len(counts)), counts)
    rare = np.ones(len(flat), dtype=bool)
    if len(heavy):
        sieve = np.zeros(1 << 22, dtype=bool)
        sieve[heavy >> U(42)] = True
        maybe = np.flatnonzero(sieve[flat >> U(42)])
        at = np.searchsorted(heavy, flat[maybe])
        at[at == len(heavy)] = 0
        rare[maybe] = heavy[at] != flat[maybe]
    mixed = mix(flat)
    band = np.searchsorted(low, np.maximum(counts, 1), side="right") - 1
    hashes, owners = [], []

    def post(tile: np.ndarray, keep: np.ndarray, level: int, wide: np.ndarray | None) -> np.ndarray:
        """Posts the kept elements of each set in its tile; returns the sets' filled buckets."""
        f, d = flat[keep], doc[keep]
        first, owner, bucket = _buckets(f, d, wide[d]) if wide is not None else (np.arange(len(f)), d, np.zeros(len(f), dtype=np.uint64))
        if len(first):
            total = np.add.reduceat(mixed[keep], first)
            hashes.append(mix(total + mix(tile[owner].astype(np.uint64) * U(1 << 40) + bucket * U(8) + U(level))))
            owners.append(2 * owner + guest)
        return np.bincount(owner, minlength=len(counts))

    for guest in (False, True):
        tile = band + guest
        left = counts > 0
        if guest:
            left &= counts * 100 // percent >= low[tile]
        enough = most[tile]
        wide = enough + 1 + -(-3 * enough // 20)
        for level in range(0 if len(heavy) else 3, 6):
            keep = left[doc] & rare if level < 3 else left[doc]
            left &= post(tile, keep, level, (wide, wide * 4, None)[level % 3]) <= enough
            if not left.any():
                break
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _post_blocks(docs: DataFrame, heavy: np.ndarray, bits: int, words: int, percent: int) -> DataFrame:
    """Rows (range, block of sorted postings); copies of a set within a task post once (a saving, as postings name the set)."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("shingles")
        often = shared.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            h, owner = (np.concatenate([x[k] for x in held]) for k in range(2))
            held.clear()
            order = np.argsort(h)
            h, owner = h[order], owner[order]
            edges = np.searchsorted(h >> U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            names, blocks, held_bytes = [], [], 0
            for r, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if b > a:
                    names.append(r)
                    blocks.append(pack_block(h[a:b] << U(bits), owner[a:b]))
                    held_bytes += len(blocks[-1])
                if names and (held_bytes >= TEXT_SLICE or r + 1 == 1 << bits):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], names=["range", "block"])
                    names, blocks, held_bytes = [], [], 0

        for part in slices(batches, "text", TEXT_SLICE):
            flat, counts = shingle_sets(part.column("text"), words)
            keys = set_keys(flat, counts)
            keep = ~np.asarray(part.column("doc_id").is_null()) & (counts > 0)  # rows without an id post nothing and hide no copy
            if len(seen) > 200_000:
                seen.clear()
            for i in np.flatnonzero(keep).tolist():
                keep[i] = (key := int(keys[i])) not in seen
                seen.add(key)
            flat, keys, counts = flat[np.repeat(keep, counts)], keys[keep], counts[keep]
            h, owner = postings(flat, counts, often, percent)
            if len(h):
                held.append((h, keys[owner >> 1] | (owner & 1).astype(np.uint64)))
                size += len(h)
            if size >= FLUSH:
                yield from send()
                size = 0
        if size:
            yield from send()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "range int, block binary")


def pack_block(tails: np.ndarray, owners: np.ndarray) -> bytes:
    """A block of postings: the leading 48 bits of each hash's tail, and its owner (a key, odd for a guest of the tile)."""
    kept = tails >> U(16)
    return (kept >> U(32)).astype("<u2").tobytes() + kept.astype("<u4").tobytes() + owners.astype("<u8").tobytes()


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(block) // 14
    high, low = np.frombuffer(block, "<u2", n), np.frombuffer(block, "<u4", n, 2 * n)
    return high.astype(np.uint64) << U(32) | low, np.frombuffer(block, "<u8", n, 6 * n)


def group_rows(h: np.ndarray, owner: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Pairs (pivot, other) and memberships (group, key) of the groups of equal h, and what later postings of h have to meet.

    A group's pivot is its least host. Guests meet each other as hosts of their own tile, so a group of guests alone
    gives nothing, and two members are settled by their pair. Where a range comes in several chunks (split), a group may
    go on in the next one: any group of two gives its memberships, and one posting of each hash is held for what follows.
    """
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    alone = first[size == 1]
    single = h[alone], owner[alone]
    many = np.repeat(size > 1, size)
    h, owner = h[many], owner[many]
    # hosts first, then by key; equal postings of copies fall together
    order = np.lexsort((owner, owner & U(1), h))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    pivot = owner[first]
    held = np.concatenate([single[0], h[first]]), np.concatenate([single[1], pivot])
    wanted = (size > 1) & (split | (pivot & U(1) == 0))
    key, pivot = owner & ~U(1), pivot & ~U(1)
    rows = np.repeat(wanted, size)
    rows[first] = False
    other, pivot_of = key[rows], np.repeat(pivot, size)[rows]
    a, b = np.minimum(other, pivot_of), np.maximum(other, pivot_of)
    order = np.lexsort((b, a))
    pairs = np.stack([a[order], b[order]])
    new = np.ones(pairs.shape[1], dtype=bool)
    new[1:] = np.any(pairs[:, 1:] != pairs[:, :-1], axis=0)
    pairs = pairs[:, new & (pairs[0] != pairs[1])]
    wanted &= size > (1 if split else 2)
    if split:
        name = mix(h[first])
    else:
        name = mix(np.add.reduceat(mix(key), first) + size.astype(np.uint64)) if len(first) else h[:0]
        once = np.zeros(len(first), dtype=bool)
        chosen = np.flatnonzero(wanted)
        once[chosen[np.unique(name[chosen], return_index=True)[1]]] = True
        wanted &= once
    rows = np.repeat(wanted, size)
    return pairs, np.stack([np.repeat(name, size)[rows], key[rows]]), held


def candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (range, block) in order of ranges: pairs (kind 0: a < b) and memberships (kind 1: group, key)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now, size, split = None, 0, False

    def settle() -> Iterator[pa.RecordBatch]:
        pairs, members, later = group_rows(*(np.concatenate([x[k] for x in held]) for k in range(2)), split)
        held[:] = [later]
        made = np.concatenate([pairs, members], axis=1).view(np.int64)
        kind = np.repeat([0, 1], [pairs.shape[1], members.shape[1]])
        for at in range(0, len(kind), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(kind[part], pa.int32()), pa.array(made[0, part], pa.int64()), pa.array(made[1, part], pa.int64())], names=["kind", "a", "b"])

    for batch in batches:
        for number, block in zip(batch.column("range").to_pylist(), batch.column("block"), strict=True):
            if number != now:
                if held:
                    yield from settle()
                held.clear()
                now, size, split = number, 0, False
            held.append(unpack_block(block.as_py()))
            size += len(held[-1][0])
            if size > CHUNK:
                split = True
                yield from settle()
                size = 0
    if held:
        yield from settle()
    held.clear()
    give_back()


def most_apart(total: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles in which linked sets of `total` shingles together differ."""
    return total - 2 * -(-percent * total // (100 + percent))


def _bitmap_bound(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b), smallest doc_ids in order, of the pairs of keys whose sizes and bitmaps allow a link."""
    side = lambda x: nodes.select(F.col("key").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint64).reshape(part.num_rows, -1) for c in ("bits_a", "bits_b"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array(apart <= most_apart(np.asarray(part.column("total")), percent))
            yield part.select(["a", "b"]).filter(keep)

    found = both.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), (F.col("n_a") + F.col("n_b")).alias("total"), "bits_a", "bits_b")
    return found.mapInArrow(run, "a long, b long")


def across_components(left: np.ndarray, doc: np.ndarray, component: np.ndarray, n: np.ndarray, raw: np.ndarray, percent: int, most: int | None = None) -> Iterator[tuple[np.ndarray, bool]]:
    """Of one tile: pairs of different components that sizes and bitmaps (rows of bytes) allow, left rows with all others, and whether some were left out.

    left is 0 for rows on the tile's left side alone, 1 for those on its right side alone, 2 for those on both. Of more
    than `most` pairs of a left row the most alike are given.
    """
    right = np.flatnonzero(left > 0)
    # bit counts of differences by a product of +-1 vectors, exact in single precision
    signs = (np.unpackbits(raw, axis=1).astype(np.int8) * 2 - 1).astype(np.float32)
    against, wide = signs[right].T, signs.shape[1]
    mine = np.flatnonzero(left != 1)
    for at in range(0, len(mine), 256):
        x = mine[at : at + 256]
        i, j = np.nonzero(component[x][:, None] != component[right][None, :])
        apart = ((wide - signs[x] @ against) / 2).astype(np.int64)[i, j]
        i, j = x[i], right[j]
        fits = (apart <= most_apart(n[i] + n[j], percent)) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
        i, j, cut = i[fits], j[fits], False
        if most is not None and len(i):
            order = np.lexsort((apart[fits] / (n[i] + n[j]), i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            kept = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < most
            i, j, cut = i[kept], j[kept], not kept.all()
        yield np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])]), cut


def across_small(tile: np.ndarray, left: np.ndarray, doc: np.ndarray, component: np.ndarray, n: np.ndarray, raw: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """All pairs of many small tiles at once, by the distance of rows in a tile."""
    words = np.ascontiguousarray(raw).view(np.uint64)
    k = 1
    while len(i := np.flatnonzero(tile[k:] == tile[:-k])):
        j = i + k
        i, j = (x[(component[i] != component[j]) & ((left[i] != left[j]) | (left[i] == 2)) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)] for x in (i, j))
        fits = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= most_apart(n[i] + n[j], percent)
        yield np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])])[:, fits]
        k += 1


def tile_pairs(batches: Iterator[pa.RecordBatch], percent: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Of the tiles (g, i, j), whose rows follow one another: pairs (kind 0: a < b), and the groups of tiles that had more than `most` for a row (kind 1: g, g)."""
    names = ["g", "i", "j", "left", "doc", "component", "n"]

    def rows(batch: pa.RecordBatch) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(batch.column("bitmap").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
        return [*(np.asarray(batch.column(c)).astype(np.int64) for c in names), raw]

    def settle(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tile = np.zeros(len(held[0]), dtype=np.int64)
        tile[1:] = np.cumsum(np.any([x[1:] != x[:-1] for x in held[:3]], axis=0))
        size = np.bincount(tile)
        small = size[tile] <= SMALL_TILE
        found = [(0, pairs) for pairs in across_small(tile[small], *(x[small] for x in held[3:]), percent)] if small.any() else []
        ends = np.cumsum(size)
        short = set()
        for t in np.flatnonzero(size > SMALL_TILE).tolist():
            for pairs, cut in across_components(*(x[ends[t] - size[t] : ends[t]] for x in held[3:]), percent, most):
                found.append((0, pairs))
                if cut:
                    short.add(int(held[0][ends[t] - 1]))
        found.append((1, np.array([sorted(short)] * 2, dtype=np.int64)))
        for kind, pairs in found:
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(pairs.shape[1], kind), pa.int32()), pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["kind", "a", "b"])

    open_rows: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = rows(batch)
        last = open_rows[-1] if open_rows else now
        others = np.flatnonzero(np.any([x != x[-1] for x in now[:3]], axis=0))
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut or any(int(last[k][-1]) != int(now[k][0]) for k in range(3)):  # the tiles before the batch's last are whole
            yield from settle([np.concatenate([x[k] for x in open_rows] + [now[k][:cut]]) for k in range(8)])
            open_rows.clear()
        open_rows.append([x[cut:] for x in now])
    if open_rows:
        yield from settle([np.concatenate([x[k] for x in open_rows]) for k in range(8)])
    give_back()


def _across(members: DataFrame, nodes: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs across components of the groups (g, doc, component), and the groups that have more, see tile_pairs.

    Rows of a group's largest component need not meet each other: the m others are dealt over blocks that meet one
    another and the blocks of the large component, so a group of n rows makes some n * m / TILE rows of tiles.
    """
    counts = members.groupBy("g", "component").agg(F.count("*").alias("rows"))
    groups = counts.groupBy("g").agg(F.max(F.struct("rows", "component")).alias("top"), F.sum("rows").alias("all"))
    share = lambda rows: F.ceil(rows / TILE).cast("int")
    groups = groups.select("g", F.col("top.component").alias("major"), share(F.col("top.rows")).alias("majors"), F.greatest(F.lit(1), share(F.col("all") - F.col("top.rows"))).alias("minors"))
    rows = members.join(groups, "g")
    rows = rows.withColumn("is_major", F.col("component") == F.col("major"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda i, j, left: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), left.cast("int").alias("left"))
    block, minors = F.col("block"), F.col("minors")
    # tile (i, j): block i of the others with block j of them, or from `minors` on with a block of the large component
    as_major = F.transform(numbers(minors), lambda i: tile(i, minors + block, F.lit(1)))
    as_minor = F.concat(
        F.transform(numbers(minors), lambda j: tile(F.least(block, j), F.greatest(block, j), F.when(block == j, 2).when(block < j, 0).otherwise(1))),
        F.transform(numbers(F.col("majors")), lambda k: tile(block, minors + k, F.lit(0))),
    )
    rows = rows.select("g", "doc", "component", F.explode(F.when(F.col("is_major"), as_major).otherwise(as_minor)).alias("t"))
    rows = rows.select("g", "t.i", "t.j", "t.left", "doc", "component").join(nodes.select(F.col("rep").alias("doc"), "n", "bitmap"), "doc")
    rows = rows.select("g", "i", "j", "left", "doc", "component", "n", "bitmap").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return rows.mapInArrow(lambda batches: tile_pairs(batches, percent, most), "kind int, a long, b long").distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """doc, set (sorted hashes as bytes) of the wanted documents; the texts of few others are shingled with them."""
    spark = docs.sparkSession
    slot = F.pmod("doc", F.lit(SLOTS))
    taken = wanted.select((slot / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(doc, {SLOTS}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    words_of = np.zeros(SLOTS // 64 + 1, dtype=np.int64)
    for r in taken:  # at most SLOTS / 64 rows
        words_of[r.word] = r.bits
    shared = spark.sparkContext.broadcast(words_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value.view(np.uint64)
        for part in slices(batches, "text", TEXT_SLICE):
            names = part.column("doc_id").cast(pa.int64())
            at = np.mod(np.asarray(names.fill_null(0)), SLOTS)
            hit = (filled[at >> 6] >> (at & 63).astype(np.uint64) & U(1)).astype(bool) & ~np.asarray(names.is_null())
            part = part.filter(pa.array(hit))
            flat, counts = shingle_sets(part.column("text"), words)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([flat[b - n : b].tobytes() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())], names=["doc", "set"])
        give_back()

    found = docs.select("doc_id", "text").mapInArrow(run, "doc long, set binary")
    return found.join(wanted.hint("shuffle_hash"), "doc", "left_semi")


def _exact(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked, by intersection of their sorted shingle arrays."""
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    sets = _sets_of(docs, wanted, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    left = sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b"))
    # merge joins spill, and a pivot of very many pairs is a skewed key that adaptive execution splits
    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str = "components", files: int | None = None) -> DataFrame:
    """node, component (smallest node reachable) of every node that an edge (a, b) names, by large-star and small-star rounds."""
    now = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag, files)
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == state or not seen.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
        state = (seen.n, seen.h)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = scratch.table(small.filter("u <> v").distinct(), tag, files)
        scratch.drop(now)
        now = after


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    docs needs doc_id and text; other columns are ignored. A null or empty text, or one of white space, has no shingle
    and is a component of its own. A null doc_id links with nothing and has a null component. Rows that repeat a doc_id
    stay rows, each with its own set. An empty table gives an empty result. The result is a table in the shared folder.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if docs.columns.count("doc_id") != 1:
        raise ValueError("docs needs one column doc_id")
    scratch = Scratch(spark)
    files = file_count(docs)
    few = max(2, files // 4)  # for tables of ids alone
    docs = docs.select("doc_id", "text")
    profiles = scratch.table(set_profiles(docs, words), "op3-profiles", files)
    every = profiles.filter("kind = 0")
    total = every.agg(F.sum("n").alias("n"), F.count("*").alias("docs")).first()
    often = profiles.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(8.0, HEAVY_SHARE * total.docs))
    heavy = np.sort(np.array([r.key for r in often.orderBy(F.desc("n"), "key").limit(HEAVY_MAX).collect()], dtype=np.int64).view(np.uint64))
    known = every.filter("n > 0 and doc_id is not null")
    nodes = scratch.table(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "op3-nodes", files)

    bits = max(4, (int(0.6 * (total.n or 0)) // RANGE).bit_length())
    blocks = _post_blocks(docs, heavy, bits, words, percent)
    found = blocks.repartitionById(1 << bits, "range").sortWithinPartitions("range").mapInArrow(candidate_rows, "kind int, a long, b long")
    found = scratch.table(found.distinct(), "op3-found", files)

    def settle(possible: DataFrame) -> DataFrame:
        return scratch.table(_exact(possible, docs, words, percent), "op3-links", few)

    possible = scratch.table(_bitmap_bound(found.filter("kind = 0").select("a", "b"), nodes, percent), "op3-possible", few)
    links = settle(possible)
    labels = components(links, scratch, "op3-components", few)

    def still_open(members: DataFrame) -> DataFrame:
        """(g, doc, component) of the groups (g, doc) whose members are not yet in one component."""
        rows = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("g", "doc", F.coalesce("component", "doc").alias("component"))
        groups = rows.groupBy("g").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("g")
        return scratch.table(rows.join(groups, "g", "left_semi").distinct(), "op3-members", few)

    members = still_open(found.filter("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("key")).join(nodes.select("key", F.col("rep").alias("doc")), "key").select("g", "doc"))
    tested, most = possible, FIRST_PAIRS
    while not members.isEmpty():
        made = scratch.table(_across(members, nodes, percent, most), "op3-across", few)
        across = scratch.table(made.filter("kind = 0").select("a", "b").join(tested, ["a", "b"], "left_anti"), "op3-possible", few)
        more = settle(across)
        if not more.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch, "op3-components", few)
        short = made.filter("kind = 1").select(F.col("a").alias("g"))
        if short.isEmpty():
            break
        members = still_open(members.join(short, "g", "left_semi").select("g", "doc"))
        tested, most = tested.union(across), most * MORE_PAIRS

    rows = every.join(nodes.select("key", "rep"), "key", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return scratch.keep(rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")), "op3-rows", few)
