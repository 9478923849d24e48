"""Benchmark decontamination by template canonicalisation.

Benchmark items and documents are cut into lower-case tokens. In a template, numbers become a number slot, units behind
numbers a unit slot, and capitalised words a name slot. A capitalised word that opens a sentence may be a name or not, so
there are three templates: such words as slots, as slots unless they are function words, and as plain tokens. Every window
of WINDOW tokens is hashed as plain tokens and as each template.

The items' windows are a table. One pass over the documents passes their window hashes through a filter of bounded size
and writes a row for each document that may hold one; its hashes are then joined with the table. Items of which COVERAGE
of the windows are found as they are contaminate the document. The others that share a window of at least LITERALS plain
tokens with it (any plain token for items of which most windows have fewer) are looked at pair by pair: such a window
aligns item and document, and along each alignment, those of most windows first, all windows of the item are compared,
those made of slots too. They count only if the aligned windows together have LITERALS plain tokens and their slots
agree: equal values of the item must meet equal values of the document and different values different ones, so a
question asked again with other numbers and names is caught, while a chance mixture is not. Items of fewer than LITERALS
plain tokens are found only as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, file_count, forget_others, give_back, slices, text_bytes
from .htmltext import STOPWORDS
from .shingles import U, mix, token_hashes, windows

WINDOW = 8
COVERAGE = 0.5
#: Plain tokens that windows found by templates need.
LITERALS = 4
#: Bits of the filter for each window of the benchmark, its places in the filter, and the power of two of bits at most
#: (32 MB, whatever the benchmark; a fuller filter lets more pass to the join, which is exact).
FILTER_BITS, PROBES, FILTER_POWER = 64, 4, 28
# Unit words and signs.
UNITS = """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg t oz lb lbs
gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute
minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kph
kmh hz khz mhz ghz v w kw j kj cal kcal pa kpa n""".split()
NUMBER, UNIT, NAME = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:;\n\""]] = True


class Tokens(NamedTuple):
    plain: np.ndarray
    #: of each token: 1 a number, 2 a unit, 4, 8, 16 a name by the three readings of capitalised words
    flags: np.ndarray
    #: where each text's tokens begin
    bounds: np.ndarray

    def slots(self, reading: int) -> np.ndarray:
        return (self.flags & (3 | 4 << reading)) > 0

    def template(self, reading: int) -> np.ndarray:
        flags = self.flags
        return np.where(flags & 1, NUMBER, np.where(flags & 2, UNIT, np.where(flags & (4 << reading), NAME, self.plain)))

    def space(self, space: int) -> np.ndarray:
        """Tokens as they are (space 0) or by a template (1 to 3)."""
        return self.template(space - 1) if space else self.plain

    def to_bytes(self, text: int) -> bytes:
        part = slice(int(self.bounds[text]), int(self.bounds[text + 1]))
        return self.plain[part].tobytes() + self.flags[part].tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tokens:
        n = len(data) // 9
        return cls(np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint8, n, 8 * n), np.array([0, n]))


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each token: letters or digits in a row; marks between digits belong to their number."""
    word, digit = _WORD[data], _DIGIT[data]
    inner = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        mark = (data[1:-1] == 46) | (data[1:-1] == 44)
        inner[1:-1] = mark & digit[:-2] & digit[2:]
    digit = digit | inner
    word = word | inner
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1] | (digit[1:] != digit[:-1])
    closes[:-1] &= ~word[1:] | (digit[1:] != digit[:-1])
    heads = offsets[(offsets > 0) & (offsets < len(data))]
    opens[heads] = word[heads]
    closes[heads - 1] = word[heads - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _sorted_hashes(words: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(words))
    return np.sort(token_hashes(data, offsets[:-1], offsets[1:]))


_UNIT_HASHES, _FUNCTION_HASHES = _sorted_hashes(UNITS), _sorted_hashes(sorted(STOPWORDS))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


def tokens(texts: pa.Array) -> Tokens:
    """Tokens of texts, one text after another."""
    texts = pc.fill_null(texts, "")
    data, offsets = text_bytes(pc.utf8_lower(texts))
    starts, ends = _cut(data, offsets)
    plain = token_hashes(data, starts, ends)
    number = _DIGIT[data[starts]] if len(starts) else np.zeros(0, dtype=bool)
    unit = _among(plain, _UNIT_HASHES)
    unit[1:] &= number[:-1]
    unit[:1] = False
    names = [np.zeros(len(plain), dtype=bool)] * 3
    original, cased = text_bytes(texts)
    first, last = _cut(original, cased)
    if len(first) == len(starts) and len(first):
        lead, follow = original[first], original[np.minimum(first + 1, len(original) - 1)]
        latin = (lead == 0xC3) & (follow >= 0x80) & (follow <= 0x9E)
        after = original[np.minimum(first + 2, len(original) - 1)]
        capital = ((lead >= 65) & (lead <= 90) & (follow >= 97) & (last - first > 1)) | (latin & (after >= 97) & (last - first > 2))
        stops = np.concatenate(([0], np.cumsum(_STOP[original])))
        inside = np.zeros(len(first), dtype=bool)
        inside[1:] = stops[first[1:]] == stops[last[:-1]]
        inside[np.searchsorted(first, cased[:-1][cased[:-1] < cased[1:]]).clip(max=len(first) - 1)] = False
        names = [capital, capital & (inside | ~_among(plain, _FUNCTION_HASHES)), capital & inside]
    flags = (number * 1 + unit * 2 + names[0] * 4 + names[1] * 8 + names[2] * 16).astype(np.uint8)
    return Tokens(plain, flags, np.searchsorted(starts, offsets))


def _literals(slot: np.ndarray, length: int) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(~slot)))
    return total[length:] - total[:-length] if len(total) > length else np.zeros(0, np.int64)


def _consistent(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether slot values map one to one."""
    for part in (slice(0, 32), slice(None)):  # most that disagree do so soon
        there, back = {}, {}
        for x, y in zip(item[part].tolist(), doc[part].tolist(), strict=True):
            if there.setdefault(x, y) != y or back.setdefault(y, x) != x:
                return False
    return True


def window_count(tokens_: int, window: int) -> int:
    """Windows of an item; one shorter than a window is one window of its own length, one without tokens none."""
    return tokens_ - window + 1 if tokens_ >= window else min(tokens_, 1)


def window_keys(made: Tokens, space: int, length: int) -> np.ndarray:
    """A hash of each window of `length` tokens that tells spaces and lengths apart."""
    return mix(windows(made.space(space), length) ^ mix(np.array([8 * length + space], dtype=np.uint64)))


def aligned(item: Tokens, doc: Tokens, window: int, coverage: float) -> tuple[int, bool]:
    """Windows of an item found in a document by alignments, and whether any by its template; memory grows with the two lengths alone.

    Alignments of most windows come first; no more are looked at once `coverage` of the windows are found.
    """
    m, n = len(item.plain), len(doc.plain)
    length = min(window, m)
    count = window_count(m, window)
    found = np.zeros(count, dtype=bool)
    if not count or n < length:
        return 0, False
    bare = [window_keys(x, 0, length) for x in (item, doc)]
    found |= np.isin(bare[0], bare[1])
    reshaped = False
    seen: set[bytes] = set()
    for space in (1, 2, 3):
        if np.count_nonzero(found) >= coverage * count:
            break
        there, here = window_keys(item, space, length), window_keys(doc, space, length)
        # slots of this reading
        mine, other = item.slots(space - 1), doc.slots(space - 1)
        if (reading := mine.tobytes() + other.tobytes()) in seen:
            continue
        seen.add(reading)
        enough = (literals := _literals(mine, length)) >= min(LITERALS, length)
        rich = enough if 2 * np.count_nonzero(enough) >= count else literals > 0
        votes = np.zeros(m + n, dtype=np.int32)
        order = np.argsort(here, kind="stable")
        ranked = here[order]
        for place in np.flatnonzero(rich).tolist():
            low, high = np.searchsorted(ranked, there[place]), np.searchsorted(ranked, there[place], side="right")
            votes[order[low:high] - place + m] += 1
        shifts = np.flatnonzero(votes)
        for at in shifts[np.argsort(-votes[shifts], kind="stable")].tolist():
            shift = at - m
            low, high = max(0, -shift), min(count, n - shift - length + 1)
            equal = np.zeros(count, dtype=bool)
            equal[low:high] = there[low:high] == here[low + shift : high + shift]
            if not np.any(equal & ~found):
                continue
            as_is = np.zeros(count, dtype=bool)
            as_is[low:high] = bare[0][low:high] == bare[1][low + shift : high + shift]
            # what windows of slots add may disagree, where the others alone do not
            alone = equal & (enough | as_is)
            for chosen in (equal, alone) if np.count_nonzero(alone) < np.count_nonzero(equal) else (equal,):
                if not np.any(chosen & ~as_is):
                    continue
                ends = np.zeros(m + 1, dtype=np.int32)
                ends[:count] += chosen
                ends[length : length + count] -= chosen
                span = np.flatnonzero(np.cumsum(ends[:m]))
                slots = mine[span] & other[span + shift]
                if np.count_nonzero(~slots) >= min(LITERALS, length) and _consistent(item.plain[span[slots]], doc.plain[span[slots] + shift]):
                    reshaped |= bool(np.any(chosen & ~found))
                    found |= chosen
                    break
            if np.count_nonzero(found) >= coverage * count:
                break
    return int(np.count_nonzero(found)), reshaped


def _item_rows(bench: DataFrame, window: int) -> DataFrame:
    """A row for each item (kind 0: item, item_id, n windows, tokens), and for each of its windows and spaces (kind 1: item, key, times it occurs as n, of which length and space)."""
    schema = "kind int, item long, item_id long, n long, tokens binary, key long, length int, space int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 36
        for part in slices(batches, "text", 1 << 20):
            rows = []
            made = tokens(part.column("text"))
            for text, item_id in enumerate(part.column("item_id").cast(pa.int64()).to_pylist()):
                one = Tokens.from_bytes(made.to_bytes(text))
                size = len(one.plain)
                count, length = window_count(size, window), min(window, size)
                rows.append((0, item, item_id, count, made.to_bytes(text), None, length, None))
                for space in range(4 if count else 0):
                    keys = window_keys(one, space, length)
                    if space:  # windows that align by a template
                        literals = _literals(one.slots(space - 1), length)
                        rich = literals >= min(LITERALS, length)
                        keys = keys[rich if 2 * np.count_nonzero(rich) >= count else literals > 0]
                    rows += [(1, item, None, k, None, key, length, space) for key, k in zip(*(x.tolist() for x in np.unique(keys.view(np.int64), return_counts=True)), strict=True)]
                item += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return bench.select("item_id", "text").mapInArrow(run, schema)


def probes(keys: np.ndarray, power: int) -> Iterator[np.ndarray]:
    """A key's places in a filter of 2 ** power bits."""
    for k in range(PROBES):
        yield (keys if not k else mix(keys + U(k))) >> U(64 - power)


def _filter(items: DataFrame) -> tuple[int, np.ndarray]:
    """The power of two of its bits, and the filter of all keys as 64-bit words, merged by Spark."""
    power = min(FILTER_POWER, max(16, (FILTER_BITS * items.filter("kind = 1").count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys = np.asarray(part.column("key")).view(np.uint64)
            at = np.unique(np.concatenate(list(probes(keys, power))))
            word, first = np.unique(at >> U(6), return_index=True)
            bits = np.bitwise_or.reduceat(U(1) << (at & U(63)), first) if len(first) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64), pa.int64()), pa.array(bits.view(np.int64), pa.int64())], names=["word", "bits"])

    made = items.filter("kind = 1").select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (power - 6), dtype=np.int64)  # at most 2 ** (FILTER_POWER - 6) rows
    words[np.asarray(made.column("word"))] = np.asarray(made.column("bits"))
    return power, words.view(np.uint64)


def _hit_rows(docs: DataFrame, lengths: list[int], power: int, words: np.ndarray) -> DataFrame:
    """Of each document that may hold a window: doc (a number of its own), doc_id, a digest of the text, tokens and the keys that pass the filter."""
    schema = "doc long, doc_id long, digest binary, tokens binary, keys array<long>"
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("shingles")
        filled = shared.value
        number = TaskContext.get().partitionId() << 36
        for part in slices(batches, "text", 1 << 20):
            made = tokens(part.column("text"))
            texts, keys = [], []
            for length in lengths:
                for space in range(4):
                    h = window_keys(made, space, length)
                    at = np.arange(len(h))
                    for k in range(PROBES):
                        probe = (h[at] if not k else mix(h[at] + U(k))) >> U(64 - power)
                        at = at[(filled[probe >> U(6)] >> (probe & U(63)) & U(1)).astype(bool)]
                    text = np.searchsorted(made.bounds, at, side="right") - 1
                    whole = at + length <= made.bounds[text + 1]
                    texts.append(text[whole])
                    keys.append(h[at[whole]])
            text, key = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (texts, keys))
            order = np.lexsort((key, text))
            text, key = text[order], key[order].view(np.int64)
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
            text, key = text[new], key[new]
            hit, first = np.unique(text, return_index=True)
            some = part.take(pa.array(hit, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number + np.arange(len(hit)), pa.int64()),
                    some.column("doc_id").cast(pa.int64()),
                    some.column("digest").cast(pa.binary()),
                    pa.array([made.to_bytes(i) for i in hit.tolist()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(key, pa.int64())),
                ],
                names=[x.split()[0] for x in schema.split(", ")],
            )
            number += len(hit)
        give_back()

    return docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")).mapInArrow(run, schema)


def _found(docs: DataFrame, bench: DataFrame, window: int, coverage: float, scratch: Scratch) -> DataFrame:
    """doc_id, digest (of the text), item_id, n_windows, coverage and reparameterised of each contaminated document and item."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = scratch.table(_item_rows(bench, window), "op7-items", file_count(bench))
    lengths = sorted(r.length for r in items.filter("kind = 0 and n > 0").select("length").distinct().collect())  # at most `window` of them
    hits = scratch.table(_hit_rows(docs, lengths, *_filter(items)), "op7-hits", file_count(docs))
    item = items.filter("kind = 0 and n > 0").select("item", "item_id", F.col("n").alias("count"), F.col("tokens").alias("item_tokens"))
    shared = hits.select("doc", F.explode("keys").alias("key")).join(items.filter("kind = 1").select("key", "item", "n", "space"), "key")
    plain, shaped = F.when(F.col("space") == 0, F.col("n")), F.col("space") > 0
    pairs = shared.groupBy("doc", "item").agg(F.coalesce(F.sum(plain), F.lit(0)).alias("n_windows"), F.max(shaped).alias("shaped"))
    pairs = scratch.table(pairs.join(item.select("item", "count"), "item"), "op7-pairs", file_count(docs))
    as_is = pairs.filter(F.col("n_windows") >= coverage * F.col("count")).select("doc", "item", "n_windows", F.lit(False).alias("reparameterised"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = defaultdict(list)
            for doc, number, mine, other in zip(*(part.column(c).to_pylist() for c in ("doc", "item", "tokens", "item_tokens")), strict=True):
                n, reshaped = aligned(Tokens.from_bytes(other), Tokens.from_bytes(mine), window, coverage)
                if reshaped and n >= coverage * window_count(len(other) // 9, window):
                    for name, value in zip(("doc", "item", "n_windows", "reparameterised"), (doc, number, n, True), strict=True):
                        rows[name].append(value)
            kinds = {"doc": pa.int64(), "item": pa.int64(), "n_windows": pa.int64(), "reparameterised": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], k) for c, k in kinds.items()], names=list(kinds))
        give_back()

    open_pairs = pairs.filter(F.col("shaped") & (F.col("n_windows") < coverage * F.col("count"))).select("doc", "item")
    open_pairs = open_pairs.join(item.select("item", "item_tokens"), "item").join(hits.select("doc", "tokens"), "doc")
    again = open_pairs.mapInArrow(look, "doc long, item long, n_windows long, reparameterised boolean")
    both = scratch.table(as_is.unionByName(again), "op7-found", file_count(docs))
    rows = both.join(item.select("item", "item_id", "count"), "item").join(hits.select("doc", "doc_id", "digest"), "doc")
    return rows.select("doc_id", "digest", "item_id", "n_windows", F.round(F.col("n_windows") / F.col("count"), 6).alias("coverage"), "reparameterised")


def contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows (of the item, found), coverage (their share) and reparameterised, a row per contaminated document and item.

    docs needs doc_id and text, bench item_id and text; other columns are ignored. n_windows counts windows found as
    they are where these suffice; else windows found by alignments, until they suffice. Null and empty texts match
    nothing; null ids are kept; repeated rows give repeated results; empty tables give an empty result. The result is a
    table in the shared folder.
    """
    scratch = Scratch(docs.sparkSession)
    return scratch.keep(_found(docs, bench, window, coverage, scratch).drop("digest"), "op7-rows", file_count(docs))


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns.

    A row goes by its text alone: rows that repeat a contaminated text all go, whatever their ids; null and empty texts
    stay; null ids and repeated rows stay as they are; an empty benchmark leaves docs as they are.
    """
    scratch = Scratch(docs.sparkSession)
    bad = scratch.keep(_found(docs, bench, window, coverage, scratch).select("digest").distinct(), "op7-bad", max(2, file_count(docs) // 4))
    return docs.join(bad, F.unhex(F.md5(docs["text"].cast("binary"))) == bad["digest"], "left_anti")
