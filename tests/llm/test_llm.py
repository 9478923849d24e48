"""The training-data operators against brute force, round trips, held-out accuracy and edge cases."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import chat, common, decontam, htmltext, jaccard, langid, licenses, media, packing, sharding, shingles, tokenfile
from spindrift.llm import queries as q
from spindrift.llm.tokens import default_tokenizer, encoder

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, more: str = ""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"component_id": F.lit("clash"), "score": F.lit("clash"), "n": F.lit("clash"), "_lang_pred": F.lit("clash")}) if more else df


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "null id text here now"), (7, "é ß 日本 \U0001f600 </s>"), (8, "word " * 30_000), (9, "x" * 200_000)]


# -- tokens, packing, files ---------------------------------------------------------------------------------------------


def whole(text):
    return np.array(encoder(default_tokenizer()).tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbZéÉßñÑΣσİıŉ'’.,!?<|>endoftext 0123\n\t ́ẞ日´ªº_-|")), max_size=60))
def test_chunks_encode_as_whole_texts(text):
    assert encoder(default_tokenizer()).encode(text) == whole(text)


def test_special_tokens_and_tables():
    for text in ["<|endoftext|> a<|startoftext|>B", "x<|endoftext|>.", "don't. I'LL's", ""]:
        assert encoder(default_tokenizer()).encode(text) == whole(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.booleans())
def test_pack_is_a_partition(sizes, cut):
    windows = packing.pack(sizes, 100, cut)
    seen = collections.defaultdict(list)
    for w in windows:
        assert 0 < sum(n for _, _, n in w) <= 100
        for i, a, n in w:
            seen[i].append((a, n))
    for i, size in enumerate(sizes):
        at = 0
        for a, n in sorted(seen[i]):
            assert a == at and n > 0
            at += n
        assert at == size
    if cut:
        assert len(windows) == -(-sum(sizes) // 100)
    else:
        assert all(len(p) == 1 for p in seen.values())


def test_the_window_count_rises_with_little_padding():
    rng = random.Random(4)
    for top in (100, 400, 2048):
        sizes = [rng.randint(1, top) for _ in range(600)]
        pieces = [min(512, s - at) for s in sizes for at in range(0, s, 512)]
        windows = packing.pack(pieces, 2048, cut=False)
        assert sum(n for w in windows for _, _, n in w) == sum(sizes) and all(sum(n for _, _, n in w) <= 2048 for w in windows)
        assert len(windows) <= 1.02 * sum(sizes) / 2048 + 1
    # where whole items are kept together, the count rises above what their sum needs
    assert len(packing.pack([60, 60, 60], 100, cut=False)) == 3


def test_differencing_is_near_equal():
    rng = random.Random(3)
    sizes = [rng.randint(1, 400) for _ in range(300)]
    loads = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 30)]
    assert max(loads) - min(loads) <= 0.01 * max(loads) and sum(loads) == sum(sizes)
    assert packing.difference([], 2) == [[], []] and packing.difference([5], 1) == [[0]]


def check_pieces(rows, texts):
    ids = collections.defaultdict(list)
    for doc, text in texts:
        ids[doc].append(np.frombuffer(whole(text or ""), "<u4").tolist() + [1])
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
    return by_sequence


def test_pack_documents(spark):
    docs = documents(spark, AWKWARD, "clash")
    rows = packing.pack_documents(docs, default_tokenizer()).collect()
    check_pieces(rows, AWKWARD)
    assert packing.pack_documents(docs.limit(0), default_tokenizer()).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pack_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in common.table(spark, DATA, "documents").collect()]
    rows = q.op4_packing(spark, DATA).collect()
    sequences = check_pieces(rows, texts)
    padding = sum(2048 - sum(r.length for r in s) for s in sequences.values())
    assert padding <= 0.02 * sum(r.length for r in rows) + 2048


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=300))
def test_elias_fano(values):
    values = sorted(values)
    made = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes())
    assert made.values().tolist() == values
    assert [made.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        made.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000)).astype(np.uint64)
    assert len(tokenfile.EliasFano.of(values).to_bytes()) * 8 / len(values) < 14


def check_files(found, texts):
    start = 0
    got = sorted(found, key=lambda r: r.start)
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert len(got) == len(order)
    for r, (doc, text) in zip(got, order, strict=True):
        ids = whole(text or "") + struct.pack("<I", 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 50_000)
    check_files(tokenfile.token_files(documents(spark, AWKWARD, "clash"), default_tokenizer()).collect(), AWKWARD)
    assert tokenfile.token_files(documents(spark, [(1, "a")]).limit(0), default_tokenizer()).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_token_files_whole_table(spark):
    check_files(q.op5_token_files(spark, DATA).collect(), [(r.doc_id, r.text) for r in common.table(spark, DATA, "documents").collect()])


# -- near-duplicates ----------------------------------------------------------------------------------------------------

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [(i, shingle_set(t)) for i, t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            same = sets[a][0] == sets[b][0] and sets[a][0] is not None
            if None not in (sets[a][0], sets[b][0]) and (x and y and 100 * len(x & y) >= 80 * len(x | y) or same and x and y and x == y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return sorted(((i, len(s), min(x for x in least[find(k)]) if i is not None else None) for k, (i, s) in enumerate(sets)), key=repr)


def family(rng, base, copies, share):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(max(0, int(len(w) * share))):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    texts = [rng.choices(words, k=rng.randint(1, 120)) for _ in range(60)]
    passage = rng.choices(words, k=60)
    every = [" ".join(t) for t in texts]
    every += [" ".join(rng.choices(words, k=60) + passage) for _ in range(30)]
    for size, share in ((8, 0.03), (40, 0.01), (100, 0.02), (300, 0.01), (300, 0.03), (1500, 0.005)):
        every += family(rng, rng.choices(words, k=size), 14, share)
    every += [every[0].upper(), every[0] + " ", "same small text", "Same Small Text", "a b c d", "a b c d e"]
    cases = [*enumerate(every, 100), *AWKWARD]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, cases, "clash")).collect()), key=repr)
    assert got == brute_components(cases)
    assert jaccard.jaccard_components(documents(spark, cases).limit(0)).count() == 0


def hashes(rng, n):
    return rng.integers(0, 1 << 40, n, dtype=np.uint64)


@pytest.mark.parametrize("chunk", [4_000_000, 50])
def test_groups_keep_their_members_together(chunk, monkeypatch):
    """Rows of a range: linear in the postings, and any two hosts of a posting share a pair or a group, however it is cut."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    h = np.concatenate([hashes(rng, 200), *[np.repeat(hashes(rng, 1), n) for n in (2, 3, 8, 9, 40, 300)]])
    owner = rng.integers(0, 1 << 62, len(h), dtype=np.uint64) * np.uint64(2) + (rng.random(len(h)) < 0.2).astype(np.uint64)
    order = rng.permutation(len(h))
    cuts = np.array_split(order, 9)
    batch = pa.RecordBatch.from_pydict({"range": pa.array([3] * 9, pa.int32()), "block": [jaccard.pack_block(np.sort(h[c]) << np.uint64(24), owner[c][np.argsort(h[c])]) for c in cuts]})
    rows = [r for b in jaccard.candidate_rows(iter([batch])) for r in b.to_pylist()]
    assert len(rows) <= 2 * len(h)
    near = {(r["a"], r["b"]) for r in rows if r["kind"] == 0}
    groups = collections.defaultdict(set)
    for r in rows:
        if r["kind"] == 1:
            groups[r["b"]].add(r["a"])
    key = (owner & ~np.uint64(1)).view(np.int64).tolist()
    host = (owner & np.uint64(1) == 0).tolist()
    for value in np.unique(h):
        same = np.flatnonzero(h == value).tolist()
        for i in same:
            for j in same:
                if i < j and (host[i] or host[j]):
                    x, y = sorted((key[i], key[j]), key=lambda v: v % (1 << 64))
                    assert (x, y) in near or groups[x] & groups[y]


@pytest.mark.parametrize("copies", [2, 5, 8, 9, 40])
def test_families_of_any_size_are_one_component(spark, copies):
    rng = random.Random(copies)
    cases = [*enumerate(family(rng, rng.choices([f"w{i}" for i in range(900)], k=200), copies, 0.01), 1)]
    cases += [*enumerate(family(rng, rng.choices([f"v{i}" for i in range(900)], k=60), copies, 0.04), 1000)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, cases)).collect()), key=repr)
    assert got == brute_components(cases)


def test_large_family_and_tiles(spark, monkeypatch):
    """3,000 near copies around one text: every one lies within reach of the first, and tiles are cut small."""
    monkeypatch.setattr(jaccard, "TILE", 64)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for k in range(2999):
        w = list(base)
        w[rng.randrange(120)] = f"n{k % 1500}"  # and exact copies
        texts.append(" ".join(w))
    found = jaccard.jaccard_components(documents(spark, [*enumerate(texts)]))
    assert {r.component_id for r in found.collect()} == {0}


@pytest.mark.parametrize("small", [0, 24, 1000])
def test_tiles_are_brute_force(small, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_TILE", small)
    rng = np.random.default_rng(8)
    sizes = [1, 2, 60, 3, 3, 90, 30, 1]
    tile = np.repeat(np.arange(len(sizes)), sizes)
    m = len(tile)
    n = rng.integers(20, 40, m)
    raw = rng.integers(0, 256, (m, 128), dtype=np.uint8) * (rng.random((m, 128)) < 0.02).astype(np.uint8)
    left, component = rng.integers(0, 3, m), rng.integers(0, 3, m)
    rows = pa.RecordBatch.from_pydict({"g": tile // 4, "i": tile % 4, "j": tile % 2, "left": left, "doc": np.arange(m), "component": component, "n": n, "bitmap": pa.array([r.tobytes() for r in raw], pa.binary())})
    want = set()
    for i in range(m):
        for j in range(m):
            apart = int(np.bitwise_count(raw[i] ^ raw[j]).sum())
            total = int(n[i] + n[j])
            if tile[i] == tile[j] and left[i] != 1 and left[j] > 0 and component[i] != component[j] and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and apart <= total - 2 * -(-80 * total // 180):
                want.add((min(i, j), max(i, j)))
    for step in (7, 50, 1000):
        batches = [rows.slice(at, step) for at in range(0, m, step)]
        assert {(r["a"], r["b"]) for b in jaccard.tile_pairs(iter(batches), 80) for r in b.to_pylist()} == want and want


@pytest.mark.parametrize("most", [1, 3, 500])
def test_tiles_give_few_pairs_a_row_and_tell_of_more(most):
    """Of a large tile at most `most` pairs a row, the most alike; none is left out untold."""
    rng = np.random.default_rng(3)
    m, n = 200, np.full(200, 100)
    raw = np.packbits((rng.random((m, 1024)) < 0.008).astype(np.uint8), axis=1)
    rows = pa.RecordBatch.from_pydict({"g": np.full(m, 7), "i": np.zeros(m, int), "j": np.zeros(m, int), "left": np.full(m, 2), "doc": np.arange(m), "component": np.arange(m), "n": n, "bitmap": pa.array([r.tobytes() for r in raw], pa.binary())})
    apart = np.bitwise_count(raw[:, None] ^ raw[None]).sum(axis=2, dtype=np.int64)
    fits = (apart <= 200 - 2 * 89) & ~np.eye(m, dtype=bool)
    got = [r for b in jaccard.tile_pairs(iter([rows]), 80, most) for r in b.to_pylist()]
    near = {(r["a"], r["b"]) for r in got if r["kind"] == 0}
    assert near <= {(i, j) for i, j in np.argwhere(fits).tolist() if i < j}
    assert sum(r["kind"] == 0 for r in got) == np.minimum(fits.sum(axis=1), most).sum()
    assert [(r["a"], r["b"]) for r in got if r["kind"] == 1] == ([(7, 7)] if (fits.sum(axis=1) > most).any() else [])
    for i in range(m):
        if fits[i].any():
            best = apart[i][fits[i]].min()
            assert any(i in pair and apart[pair] == best for pair in near)


def spread_copies():
    """Copies of a text changed in two or three places, which link, and those changed in four, which are the pivots of most groups and link with some of them."""
    rng = random.Random(12)
    base, copies = [f"w{i}" for i in range(300)], []
    for k in range(900):
        w = list(base)
        for at in rng.sample(range(10, 290), 4 if k % 2 else rng.choice([2, 3])):
            w[at] = f"n{rng.randrange(10**6)}"
        copies.append((" ".join(w), k % 2))
    keys = jaccard.set_keys(*shingles.shingle_sets(pa.array([t for t, _ in copies]))).tolist()
    least = sorted(key for key, (_, far) in zip(keys, copies, strict=True) if far)[150]
    return [*enumerate(t for key, (t, far) in zip(keys, copies, strict=True) if far or key > least)]


def count_tested(monkeypatch):
    """Numbers of pairs that the rounds test, filled as they run."""
    tested, exact = [], jaccard._exact
    monkeypatch.setattr(jaccard, "_exact", lambda pairs, *more: tested.append(pairs.count()) or exact(pairs, *more))
    return tested


@pytest.mark.parametrize("first", [1, 4])
def test_a_large_group_is_linked_with_few_pairs(spark, monkeypatch, first):
    """The pairs tested grow with the copies, not with their square."""
    monkeypatch.setattr(jaccard, "FIRST_PAIRS", first)
    cases, tested = spread_copies(), count_tested(monkeypatch)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, cases)).collect()), key=repr)
    assert got == brute_components(cases)
    assert sum(tested[1:]) <= 8 * len(cases)


def test_copies_without_an_id_hide_no_link(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    docs = documents(spark, [(None, text), (1, text), (2, near)]).coalesce(1)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).filter("doc_id is not null").collect()) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("heavy", [False, True])
def test_no_link_without_shared_posting(heavy):
    """Pigeonhole: linked sets share a posting, whichever shingles are left out of the buckets."""
    rng = np.random.default_rng(11)
    for n in [1, 2, 4, 5, 7, 9, 10, 16, 30, 77, 200, 600, 1700]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = int(len(a) * 0.2 * rng.random() if rng.random() < 0.7 else len(a) * 0.2)
            kept = rng.permutation(a)[: len(a) - gone]
            room = int(len(kept) / 0.8 - len(a) + 1e-9)
            b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, max(0, int(room * rng.random())), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            out = np.sort(rng.permutation(a)[: int(len(a) * rng.random())]) if heavy else np.zeros(0, np.uint64)
            h, owner = jaccard.postings(np.concatenate([a, b]), np.array([len(a), len(b)]), out, 80)
            mine, other = h[owner >> 1 == 0], h[owner >> 1 == 1]
            shared = np.intersect1d(mine, other)
            hosts = set(h[(owner & 1) == 0].tolist())
            assert any(x in hosts for x in shared.tolist())


def test_bitmap_bound_never_rejects_a_link():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(5, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(0.92 * len(a))], rng.integers(0, 1 << 63, max(1, n // 20), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        bits = [np.packbits((np.bincount((x & np.uint64(1023)).astype(int), minlength=1024) & 1).astype(np.uint8)) for x in (a, b)]
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(a) + len(b) - 2 * both


def test_shingle_hashes_follow_words():
    texts = ["A b  c\td e f", "a B c d E F", "", None, "one two", "One  TWO", "a b c d e", "x a b c d e f"]
    flat, counts = shingles.shingle_sets(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(counts)))
    sets = [set(flat[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    assert counts.tolist() == [2, 2, 0, 0, 1, 1, 1, 3]
    assert sets[0] == sets[1] and sets[4] == sets[5] and sets[6] < sets[0] < sets[7]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = dict(jaccard.components(spark.createDataFrame(chain, "a long, b long").dropna(), common.Scratch(spark)).collect())
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and 7 in got


# -- decontamination ----------------------------------------------------------------------------------------------------

ITEM = "If Alice buys 3 apples for 5 dollars and then Alice sells 3 apples, how much money has she?"


def test_decontamination_cases(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "Short one here now"), (3, None), (4, ""), (None, "seven words make up this whole item")], "item_id long, text string")
    cases = [
        (1, "x y z. " + ITEM + " More."), (2, ITEM.upper() + "!!"), (3, "so if Bob buys 7 apples for 9 euros and then Bob sells 7 apples, how much money has she?"),
        (4, "so if Bob buys 7 apples for 9 euros and then Carl sells 8 apples, how much money has she?"), (5, "a short ONE here now!"), (6, "nothing of that kind is in this text, not at all"),
        (7, None), (8, ""), (9, "1 2 3 4 5 6 7 8 9 10 11 12"), (10, "seven words make up this whole item"), (11, "word " * 50_000 + ITEM),
    ]
    docs = documents(spark, cases, "clash")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1): False, (2, 1): False, (3, 1): True, (5, 2): False, (10, None): False, (11, 1): False}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {4, 6, 7, 8, 9}
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_names_that_open_sentences(spark):
    """Names at the head of sentences, and items of which most windows are made of slots."""
    item = "Tom has 5 apples. Ann has 3 pears. Tom gives Ann 2 apples. Ann eats 1 pear. How many fruits has Ann?"
    dense = "Tom 5 kg Ann 3 kg Bob 2 kg Eve 9 kg sum of Tom 5 kg Bob 2 kg less Ann 3 kg and Eve 9 kg"
    bench = spark.createDataFrame([(1, item), (2, dense)], "item_id long, text string")
    cases = [
        (1, "A quiz: Bob has 7 apples. Eve has 4 pears. Bob gives Eve 6 apples. Eve eats 2 pear. How many fruits has Eve?"),
        (2, "A quiz: Bob has 7 apples. Eve has 4 pears. Carl gives Bob 6 apples. Eve eats 2 pear. How many fruits has Dan?"),
        (3, "so: Jim 7 kg Pam 4 kg Kim 8 kg Lee 6 kg sum of Jim 7 kg Kim 8 kg less Pam 4 kg and Lee 6 kg"),
        (4, "so: Jim 7 kg Pam 4 kg Kim 8 kg Lee 6 kg sum of Pam 1 kg Jim 2 kg less Kim 4 kg and Pam 6 kg"),
        (5, "1 kg 2 kg 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg 9 kg 10 kg"), (6, item), (7, item.replace("Tom", "Will")),
    ]
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.contaminated(documents(spark, cases), bench).collect()}
    assert got == {(1, 1): True, (3, 2): True, (6, 1): False, (7, 1): True}


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontam, "FILTER_POWER", 7)
    own = ["ash", "birch", "cedar", "elm", "fir", "oak"]
    bench = spark.createDataFrame([(i, f"item {w} has some words that are its own {w} and some more of them") for i, w in enumerate(own)], "item_id long, text string")
    docs = documents(spark, [(i, f"pre item {w} has some words that are its own {w} and some more of them post") for i, w in enumerate(own)])
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()) == [(i, i) for i in range(6)]
    assert decontam.clean(docs, bench).count() == 0


def test_repeated_items_and_rows(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, ITEM)], "item_id long, text string")
    docs = documents(spark, [(5, ITEM), (5, ITEM), (None, ITEM), (None, "clean"), (6, "clean"), (6, "clean")])
    rows = [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()]
    assert collections.Counter(rows) == {(5, 1): 4, (5, 2): 2, (None, 1): 2, (None, 2): 1}
    assert sorted(((r.doc_id, r.text) for r in decontam.clean(docs, bench).collect()), key=repr) == [(6, "clean"), (6, "clean"), (None, "clean")]


def test_reparameterised_plants_in_a_table(spark):
    """Items asked again with other values are found, those whose values disagree are not: the slots decide every row."""
    rng = random.Random(3)
    names, units = ["Tom", "Ann", "Bob", "Eve", "Jim", "Pam", "Kim", "Lee"], ["kg", "miles", "dollars", "hours"]
    words = [f"zu{i}ne".replace(str(i), "abcdefghij"[i % 10] * (i // 10 + 1)) for i in range(60)]

    def item(k):
        body = " ".join(rng.choices(words, k=5))
        return f"{{0}} has {{2}} {units[k % 4]} of {body} and {{1}} has {{3}} of them when {{0}} gives {body} {{2}} to {{1}}, how many has {{1}} with {{3}} now?"

    shapes = [item(k) for k in range(12)]
    bench = spark.createDataFrame([(k, x.format("Tom", "Ann", 5, 7)) for k, x in enumerate(shapes)], "item_id long, text string")
    cases, want = [], set()
    for k, x in enumerate(shapes):
        a, b = rng.sample(names, 2)
        cases.append((10 * k, f"before {x.format(a, b, 11 + k, 90 + k)} after"))
        want.add((10 * k, k, True))
        mixed = x.replace("{2} to {1}", "41 to {0}").replace("{1} with {3}", "{0} with 43")
        cases.append((10 * k + 1, f"before {mixed.format(a, b, 11 + k, 90 + k)} after"))
        cases.append((10 * k + 2, "before " + x.format("Tom", "Ann", 5, 7)))
        want.add((10 * k + 2, k, False))
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in decontam.contaminated(documents(spark, cases), bench).collect()}
    assert got == want
    assert {r.doc_id % 10 for r in decontam.clean(documents(spark, cases), bench).collect()} == {1}


def test_repetitive_texts_take_bounded_memory(spark):
    """A 50,000-word text of one phrase against a 5,000-word item of it: memory grows with the lengths, not their product."""
    import tracemalloc

    item = decontam.tokens(pa.array(["if Tom has 5 kg of it then Ann has 6 kg of it " * 360]))
    doc = decontam.tokens(pa.array(["if Bob has 7 kg of it then Eve has 7 kg of it " * 3600]))
    tracemalloc.start()
    n, _ = decontam.aligned(item, doc, decontam.WINDOW, decontam.COVERAGE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n < 100 and peak < 200 << 20
    docs = documents(spark, [(1, "one two three four five six seven eight " * 6000), (2, "other words")])
    bench = spark.createDataFrame([(1, "one two three four five six seven eight " * 600)], "item_id long, text string")
    assert [(r.doc_id, r.coverage) for r in decontam.contaminated(docs, bench).collect()] == [(1, 1.0)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_decontamination_whole_table(spark):
    docs = [(r.doc_id, (r.text or "").lower()) for r in common.table(spark, DATA, "documents").collect()]
    items = [(r.item_id, r.text.lower()) for r in common.table(spark, DATA, "benchmark").collect()]
    planted = {(d, i) for d, t in docs for i, x in items if x in t}
    assert {(r.doc_id, r.item_id) for r in q.op7_decontamination(spark, DATA).collect()} == planted


# -- languages ----------------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_language_accuracy(spark):
    docs = common.table(spark, DATA, "documents").select("doc_id", "lang")
    rows = q.op8_language_id(spark, DATA).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out for r in rows} == {True, False} and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = documents(spark, [(1, "the cat and the dog")]).select("doc_id", "text", F.lit("en").alias("lang")).union(documents(spark, [(2, "der hund und die katze"), (3, None), (4, "123")]).select("doc_id", "text", F.lit("de")))
    made = langid.train(train)
    assert {r.lang for r in made.collect()} == {"en", "de"}
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in langid.identify(documents(spark, [*AWKWARD[:4], (20, "the cat"), (21, "12 !!"), (22, "und die katze")], "clash"), made).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (20, "en", True), (21, "und", False), (22, "de", True)} <= got
    none = langid.train(train.limit(0))
    assert none.count() == 0 and langid.identify(train, none).filter("lang_pred <> 'und' or score <> 0").count() == 0


def test_languages_in_blocks_and_ties(spark, monkeypatch):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the cat and the dog", "ab"), ("el perro y el gato", "es"), ("le chat et le chien", "fr")])]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(train, langid.train(train)).collect()}
    assert whole[0][0] == whole[2][0] == "ab" and [whole[i][0] for i in (1, 3, 4)] == ["de", "es", "fr"]  # ties go to the first in order
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 2)
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(train, langid.train(train)).collect()} == whole


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_languages_are_brute_force(spark):
    """Prototypes, cosines and predictions of a table, recomputed n-gram by n-gram."""
    p = langid.Profiles()
    grams: dict = {}

    def bundle(text):
        symbols, last = [0], True
        for c in text or "":
            letter = c.isalpha()
            if letter or last:
                symbols.append(int(p.symbol[ord(c)]) if letter else 0)
            last = letter
        symbols = [0, *symbols[2 if len(symbols) > 1 and not symbols[1] else 1 :], 0]
        total = np.zeros(langid.DIMENSIONS)
        for g, n in collections.Counter(zip(symbols, symbols[1:], symbols[2:], strict=False)).items():
            if g not in grams:
                grams[g] = np.prod([p.letters[s][p.places[k]].astype(float) for k, s in enumerate(g)], axis=0)
            total += n * grams[g]
        return total

    docs = common.table(spark, DATA, "documents").collect()
    made = {r.doc_id: bundle(r.text) for r in docs if any(c.isalpha() for c in r.text or "")}
    sums = collections.defaultdict(float)
    for r in docs:
        if r.doc_id in made and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sums[r.lang] += made[r.doc_id] / np.linalg.norm(made[r.doc_id])
    for r in q.op8_language_id(spark, DATA).collect():
        if r.doc_id not in made:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {lang: float(made[r.doc_id] @ v / np.linalg.norm(made[r.doc_id]) / np.linalg.norm(v)) for lang, v in sums.items()}
        assert abs(max(0.0, max(cosines.values())) - r.score) < 1e-4 and cosines[r.lang_pred] > max(cosines.values()) - 1e-4


def test_bundle_is_bound_and_permuted():
    p = langid.Profiles()
    (bundle,) = p.bundles(pa.array(["ab"]))
    by_hand = np.zeros(langid.DIMENSIONS)
    text = [0, int(p.symbol[97]), int(p.symbol[98]), 0]
    for i in range(2):
        gram = np.ones(langid.DIMENSIONS)
        for k in range(3):
            gram *= p.letters[text[i + k]][p.places[k]]
        by_hand += gram
    assert np.array_equal(bundle, by_hand)


# -- html ---------------------------------------------------------------------------------------------------------------


def test_marked_article():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>a</a></li></ul></nav>
    <div class="ad">Buy</div><article><header><h1>Head &amp;amp; more</h1></header><p>One&nbsp;<b>two</b><br>three<p>Four &lt;5 <aside>side</aside>
    <div class="cookie-notice">cookies</div><form>f<input></form><!-- x --><p>Last &eacute;</p><section id="comments"><p>So true</p></section></article><footer>f</footer></body></html>"""
    assert htmltext.main_text(page) == "Head &amp; more\n\nOne two three\n\nFour <5\n\nLast é"


def test_articles_in_boilerplate():
    long = "This is one of the paragraphs that we would like to keep in the text, and it is long enough to be judged by itself as it is."
    teaser = "<article><p>Read what others have said about it</p></article>"
    for part in (f"<section id=comments>{teaser}</section>", f"<div class=related><div>{teaser}</div></div>", f"<nav>{teaser}</nav>", f"<footer>{teaser}</footer>", f"<div class=sidebar>{teaser}</div>"):
        assert htmltext.main_text(f"<body><main><p>{long}</main>{part}</body>") == long
        assert htmltext.main_text(f"<body><p>{long}</p>{part}</body>") == long
    comment = "<article class=comment><p>So true</p></article>"
    assert htmltext.main_text(f"<article><p>{long}</p>{comment}</article>{comment}") == long
    # a class of the only article, elements left open
    assert htmltext.main_text(f"<article class='post share'><p>{long}</p></article>") == long
    assert htmltext.main_text(f"<body><div id=menu><a href=x>Home</a><article><p>{long}</p></article></body>") == long
    assert htmltext.main_text(f"<body><div id=page><div id=menu><a href=x>Home</a><article><p>{long}</p></article></div></body>") == long


def test_unmarked_page():
    long = "This is one of the paragraphs that we would like to keep in the text, and it is long enough to be judged by itself as it is."
    page = f"<body><div id=menu><a href=x>Home</a></div><div><h2>The title</h2><p>{long}</p><p>Short one.</p><p>{long}</p></div><div class=sidebar>{long}</div><p><a href=y>a link that is long enough to be a block of its own, really it is</a></p></body>"
    assert htmltext.main_text(page) == f"The title\n\n{long}\n\nShort one.\n\n{long}"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pages_against_their_template(spark):
    import html

    pages = {r.page_id: r.html for r in common.table(spark, DATA, "pages").collect()}
    for r in q.op6_html(spark, DATA).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>/!-&;=\"' apdivscriptbn\n")), max_size=80))
def test_any_markup(page):
    assert isinstance(htmltext.main_text(page), str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_html_pages_without_marks(spark):
    """With <article> and <main> taken out, the two passes alone find the same text."""
    import html

    hit = made = wanted = 0
    for r in common.table(spark, DATA, "pages").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want = collections.Counter(x for x in parts if x)
        got = collections.Counter(htmltext.main_text(re.sub(r"</?(article|main)[^>]*>", "", r.html)).split("\n\n"))
        size = lambda c: sum(len(k) * n for k, n in c.items())
        hit, made, wanted = hit + size(got & want), made + size(got), wanted + size(want)
    assert hit / made > 0.99 and hit / wanted > 0.97


def test_html_pages_by_their_blocks():
    rich = "It is one of the things that we had to do when all of this was over, and they said so to him. " * 3
    menu = "".join(f"<li><a href=x>Item {i} of the menu</a></li>" for i in range(60))
    # menus that don't say so, around and between the text
    assert htmltext.main_text(f"<body><ul>{menu}</ul><h2>Title</h2><p>{rich}</p><p>Short.</p><p>{rich}</p><ul>{menu}</ul></body>") == f"Title\n\n{rich.strip()}\n\nShort.\n\n{rich.strip()}"
    # nothing but short paragraphs
    short = ["It was late.", "They went to the sea.", "He said no.", "We had to do it all the same."]
    assert htmltext.main_text("<nav>Home</nav>" + "".join(f"<p>{x}</p>" for x in short)) == "\n\n".join(short)
    # a long block poor in stop words is none
    poor = "Model X200 Chrome Silver Fitting Bolt Nut Washer M8 Steel Kit Box Pack Offer Price Stock Order Ship Brand Size Colour Weight Grade Type Batch Serial Label Part Code Unit Set Lot Range Series"
    assert htmltext.main_text(f"<p>{rich}</p><div>{poor} {poor}</div>") == rich.strip()
    # in an article it is kept, and a short block between lists of links is not
    assert htmltext.main_text(f"<article><p>{poor}</p></article>") == poor
    assert htmltext.main_text(f"<article><p>{rich}</p><ul>{menu}</ul><div>More</div><ul>{menu}</ul></article>") == rich.strip()
    # text in none of the languages goes by length
    other = "wqoe rtyu iopa sdfg hjkl zxcv bnmq " * 9
    assert htmltext.main_text(f"<nav>x</nav><p>{other}</p><div>tiny</div>") == f"{other.strip()}\n\ntiny"


def test_html_nested_tags_are_linear():
    import time

    start = time.perf_counter()
    for n in (100_000,):
        assert htmltext.main_text("<div>" * n + "<p>hello there</p>" + "</span></p></div>" * n) == "hello there"
    assert time.perf_counter() - start < 5


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (3, "u", "<article><p>" + "word " * 40_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.url, r.n_chars) for r in htmltext.extract(pages).collect()}
    assert got == {1: (None, 0), None: ("u", 0), 3: ("u", 199_999)} and htmltext.extract(pages.limit(0)).count() == 0


# -- media --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 384, 577, 5000])
def test_media_round_trip(n):
    length, payload = media.to_payload("é" * (n // 2) + "x" * (n % 2))
    blob = media.store(payload)
    (found,) = media.sniff(blob)
    assert (found.offset, found.length) == (0, len(blob)) and media.correct_type("image/jpeg", [found]) == found.kind
    assert media.load(blob, found.kind)[0] == payload and len(payload) % 192 == 0 and len(payload) >= max(192, length)


def test_sniffing_and_carving(spark):
    png, wav = media.store(b"a" * 384), media.store(b"b" * 576)
    blob = b"junk BM %PDF- " + png + b"..\x1f\x8b\x08" + wav + b"tail"
    assert [(f.kind, blob[f.offset : f.offset + f.length]) for f in media.sniff(blob)] == [("image/png", png), ("audio/wav", wav)]
    assert media.sniff(None) == [] and media.sniff(b"") == [] and media.sniff(png[:-1]) == [] and media.correct_type("image/png", []) == "application/octet-stream" and media.correct_type("text/plain", []) == "text/plain"
    import gzip
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "hello")
    for kind, b in {
        "application/gzip": gzip.compress(b"x" * 999), "application/zip": buffer.getvalue(), "image/gif": b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;",
        "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF", "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4cd\1\2\xff\0\3\xff\xd9",
    }.items():
        assert [(f.kind, f.offset, f.length) for f in media.sniff(b"??" + b + b"??")] == [(kind, 2, len(b))]
    rows = media.carve(spark.createDataFrame([(1, blob), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.kind) for r in rows] == [(1, "image/png"), (1, "audio/wav")]


def test_media_table(spark):
    got = media.store_and_read(documents(spark, AWKWARD, "clash")).collect()
    texts = collections.defaultdict(set)
    for doc, t in AWKWARD:
        texts[doc].add(t or "")
    assert len(got) == len(AWKWARD)
    for r in got:
        n, payload = media.to_payload(next(iter(texts[r.doc_id])))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media.store_and_read(documents(spark, [(1, "a")]).limit(0)).count() == 0


def remainder(data, poly, bits):
    """CRC by long division, bit by bit."""
    value = 0
    for byte in data:
        for k in range(7, -1, -1):
            top = value >> (bits - 1) & 1 ^ byte >> k & 1
            value = (value << 1 & (1 << bits) - 1) ^ (poly if top else 0)
    return value


def flac(frames):
    head = b"fLaC" + bytes([0x80, 0, 0, 34]) + struct.pack(">HH", 16, 16) + b"\0" * 6
    rate, total = 44100, 16 * frames
    head += (rate << 44 | 0 << 41 | 15 << 36 | total).to_bytes(8, "big") + b"\0" * 16
    out = b""
    for k in range(frames):
        frame = bytes([0xFF, 0xF8, 0x70, 0x08, k]) + struct.pack(">H", 15)
        frame += bytes([remainder(frame, 0x07, 8)]) + b"\0" + struct.pack(">H", 1000 + k)
        out += frame + struct.pack(">H", remainder(frame, 0x8005, 16))
    return head + out


def mp3(frames):
    body = bytes([0xFF, 0xFB, 0x90, 0x00])  # 128 kbit/s at 44.1 kHz: 417 bytes a frame
    return b"ID3\3\0\0\0\0\0\5" + b"xxxxx" + (body + b"\1" * 413) * frames


def webm(known):
    head = bytes.fromhex("1A45DFA3") + bytes([0x80 | 7]) + bytes.fromhex("4282") + bytes([0x84]) + b"webm"
    parts = bytes.fromhex("1549A966") + bytes([0x83]) + b"abc" + bytes.fromhex("1F43B675") + bytes([0x85]) + b"defgh"
    return head + bytes.fromhex("18538067") + (bytes([0x80 | len(parts)]) if known else b"\x01" + b"\xff" * 7) + parts


def test_lengths_are_confirmed():
    """Audio and video end where their own lengths say, so what is embedded behind them is found too."""
    tail = b"plain text " + media.store(b"z" * 384) + b" more"
    for kind, b in [("audio/flac", flac(3)), ("audio/mpeg", mp3(3)), ("audio/mpeg", mp3(2) + b"TAG" + b"t" * 125), ("video/webm", webm(True)), ("video/webm", webm(False))]:
        found = media.sniff(b"??" + b + tail)
        assert [(f.kind, f.offset, f.length) for f in found][0] == (kind, 2, len(b)) and found[1].kind == "image/png" and len(found) == 2
        assert media.sniff(b[:-1] if kind != "audio/mpeg" else b[:440]) == []
    broken = bytearray(flac(2))
    broken[-1] ^= 1
    for junk in (bytes(broken), b"\x1aE\xdf\xa3 junk webm junk and more of it", flac(0) + b"plain text", b"ID3\3\0\0\0\0\0\0\xff\xe0text", b"fLaC" + b"\0" * 50):
        assert media.sniff(junk) == []


def test_many_marks_take_linear_time():
    import time

    start = time.perf_counter()
    assert media.sniff(b"%PDF-1.4 " * 200_000) == [] and media.sniff(b"PK\x03\x04 zip " * 200_000) == []
    assert media.sniff(b"PK\x03\x04 zip " * 100_000 + b"PK\x05\x06" + b"\0" * 18) == []
    assert time.perf_counter() - start < 10


def test_every_type_is_inspected(spark):
    import io
    import wave

    grey, stereo = media.store(b"a" * 384), io.BytesIO()
    with wave.open(stereo, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\1\2\3\4" * 9)
    filtered = bytearray(zlib.decompress(grey[41:-16]))
    filtered[0] = 1
    other = grey[:33] + struct.pack(">I", len(zlib.compress(bytes(filtered)))) + b"IDAT" + zlib.compress(bytes(filtered)) + b"\0\0\0\0" + grey[-12:]
    blobs = [b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4cd\1\2\xff\0\3\xff\xd9", b"text " + grey, b"", b"plain", None, flac(2), stereo.getvalue(), other, grey]
    rows = spark.createDataFrame([(i, len(b or b""), "image/jpeg", b, "clash") for i, b in enumerate(blobs)], "doc_id long, n_bytes long, declared string, media binary, feature string")
    got = {r.doc_id: r for r in media.inspect(rows).collect()}
    assert [got[i].kind for i in range(9)] == ["image/jpeg", *["application/octet-stream"] * 4, "audio/flac", "audio/wav", "image/png", "image/png"]
    assert [got[i].payload_bytes for i in range(9)] == [None] * 8 + [384] and got[8].payload_sha256 == hashlib.sha256(b"a" * 384).hexdigest()
    assert got[0].feature == "image/jpeg;embedded=0" and got[1].feature == "application/octet-stream;embedded=1" and got[4].media_sha256 is None
    assert all(got[i].media_sha256 == hashlib.sha256(blobs[i]).hexdigest() for i in range(9) if blobs[i] is not None)
    assert media.inspect(rows.limit(0)).count() == 0 and media.carve(rows.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_media_of_a_table_by_other_readers(spark):
    """Stored forms and features of a whole table, decoded by the standard library and by hand."""
    import io
    import statistics
    import wave

    docs = common.table(spark, DATA, "documents")
    blobs = {r.doc_id: bytes(r.media) for r in media.to_media(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in q.op10_media(spark, DATA).collect():
        raw = texts[r.doc_id].encode()
        want = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        blob = blobs[r.doc_id]
        if blob[:4] == b"RIFF":
            with wave.open(io.BytesIO(blob)) as w:
                samples, kind, shape = w.readframes(w.getnframes()), "audio/wav", f"{len(want)}@{w.getframerate()}"
        elif blob[:2] == b"BM":
            assert struct.unpack_from("<ii", blob, 18) == (64, -len(want) // 192)
            samples, kind, shape = blob[54:], "image/bmp", f"64x{len(want) // 192}"
        else:
            lines = zlib.decompress(blob[41:-16])
            samples, kind, shape = b"".join(lines[i + 1 : i + 193] for i in range(0, len(lines), 193)), "image/png", f"192x{len(want) // 192}"
        assert samples == want and (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
        counts = collections.Counter(want)
        entropy = -sum(n / len(want) * np.log2(n / len(want)) for n in counts.values())
        assert re.fullmatch(re.escape(f"{kind};{shape};") + r"mean=([\d.]+);dev=([\d.]+);entropy=([\d.]+);embedded=0", r.feature)
        numbers = [float(x) for x in re.findall(r"=([\d.]+)", r.feature)[:3]]
        assert np.allclose(numbers, [statistics.fmean(want), statistics.pstdev(want), entropy], atol=2e-3)


# -- chat ---------------------------------------------------------------------------------------------------------------


def test_control_strings_are_reversible(spark):
    texts = ["</s>", "<\\/s>", "[INST] ok [/INST]", "[\\\\/INST]", "<<s>>", "a<", "[", "</s", "<s></s>[INST][/INST]", "\\", "", "</s>[INST] ok [/INST]", "/s>", "INST]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t and not re.search(r"</?s>|\[/?INST\]", r.e) for r in rows)


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_conversations(spark):
    turns = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, None, None), (3, 5, "[INST]", "<s>"), (3, 9, "assistant", None), (3, 11, "assistant", "x" * 100_000), (None, 1, "user", "z"), (4, None, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"tree": F.lit("clash"), "node": F.lit("clash")})
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {-1, 1, 2, 3, 4, None}
    assert got[1].turns_sha256 == digest([("user", "a"), ("assistant", "b</s>")]) and got[1].loss_chars == 5 and got[1].loss_sha256 == hashlib.sha256(b"b</s>").hexdigest()
    assert got[2].n_turns == 2 and got[2].turns_sha256 == digest([("", ""), ("", "")])
    assert got[3].turns_sha256 == digest([("[INST]", "<s>"), ("assistant", ""), ("assistant", "x" * 100_000)]) and got[3].loss_chars == 100_000
    control = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == digest([("user", control), ("assistant", control)]) and got[-1].loss_sha256 == hashlib.sha256(control.encode()).hexdigest()
    assert [r.conv_id for r in chat.format_conversations(df.limit(0)).collect()] == [-1]


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "r", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", "c", 0.5), (1, 5, 3, "user", "d", 0.5), (2, 1, 9, "user", "orphan", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, s double")
    assert sorted((r.tree, r.leaf, list(r.path)) for r in chat.paths(df).collect()) == [(1, 2, [1, 2]), (1, 4, [1, 3, 4]), (1, 5, [1, 3, 5]), (2, 1, [1])]
    best = {(r.tree, r["rank"]): r for r in chat.format_trees(df, F.col("s"), 2).collect()}
    assert best[1, 1].leaf == 4 and best[1, 2].leaf == 5 and set(best) == {(1, 1), (1, 2), (2, 1)}
    assert best[1, 1].formatted == "<s>[INST]user[/INST]r</s><s>[INST]assistant[/INST]b</s><s>[INST]user[/INST]c</s>"


def test_deep_thread(spark):
    df = spark.range(300).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    (r,) = chat.paths(df).collect()
    assert list(r.path) == list(range(300))


def test_trees_with_awkward_rows(spark):
    rows = [
        (None, 1, None, "user", "a", 1.0), (None, 2, 1, "assistant", "é</s>", None), (5, None, 1, "user", "no node", 9.0), (5, 1, None, None, None, None), (5, 1, None, "user", "twice", 2.0),
        (6, 1, 1, "user", "its own parent", 0.0), (7, 1, None, "user", "root", 0.0), (7, 2, 1, "assistant", "x", 1.0), (7, 3, 1, "assistant", "x", 1.0), (7, 4, 8, "user", "above a loop", 0.0), (7, 8, 9, "u", "", 0.0), (7, 9, 8, "u", "", 0.0),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, s double").withColumns({"t": F.lit("clash"), "leaf": F.lit("clash"), "up": F.lit("clash"), "rank": F.lit("clash")})
    got = {(r.tree, r["rank"]): r for r in chat.format_trees(df, F.col("s"), 9).collect()}
    assert {k: (r.leaf, r.score, r.n_turns) for k, r in got.items()} == {(None, 1): (2, 1.0, 2), (5, 1): (1, 0.0, 1), (7, 1): (2, 1.0, 2), (7, 2): (3, 1.0, 2)}
    r = got[None, 1]
    assert r.formatted == "<s>[INST]user[/INST]a</s><s>[INST]assistant[/INST]é<\\/s></s>"
    assert [r.formatted.encode()[s.start - 1 : s.start - 1 + s.length].decode() for s in r.loss_spans] == ["é<\\/s>"]
    assert chat.format_trees(df.limit(0)).count() == 0 and chat.paths(df.limit(0)).count() == 0


def test_random_trees_are_brute_force(spark):
    rng = random.Random(6)
    rows = [(t, n, rng.randrange(n) if n else None, rng.choice(["user", "assistant"]), f"m{n}", float(rng.randrange(5))) for t in range(12) for n in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, s double")
    by = {(r[0], r[1]): r for r in rows}
    inner = {(r[0], r[2]) for r in rows}
    want = collections.defaultdict(list)
    for r in rows:
        if (r[0], r[1]) not in inner:
            path, at = [], r
            while at:
                path.insert(0, at)
                at = by.get((r[0], at[2]))
            want[r[0]].append((-sum(x[5] for x in path), -len(path), r[1], "".join(f"<s>[INST]{x[3]}[/INST]{x[4]}</s>" for x in path)))
    best = {(t, k): (x[2], x[3]) for t, found in want.items() for k, x in enumerate(sorted(found)[:3], 1)}
    assert {(r.tree, r["rank"]): (r.leaf, r.formatted) for r in chat.format_trees(df, F.col("s"), 3).collect()} == best


def test_very_long_conversation(spark):
    """50,000 turns: what is made grows with n log n, not with the square."""
    n = 50_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text é "), F.col("id").cast("string")).alias("text"))
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}[1]
    turns = [("user" if i % 2 == 0 else "assistant", f"text é {i}") for i in range(n)]
    loss = "".join(t for r, t in turns if r == "assistant")
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (n, digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# -- licences and shards ------------------------------------------------------------------------------------------------


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Some words.\nReleased under the MIT License.\nMore."), ("a/b/c/x", "no statement"), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/z", None), ("d/x", ""), ("a/b/own", "This work is licensed under the GNU General Public License, version 2."), (None, "Released under the MIT License."), ("a/b/c/x", "no statement"),
        ("ab/x", "the licence of nothing in particular is what this long line is about, and nothing else at all"), ("e", "x " * 50_000),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({"score": F.lit("clash"), "license": F.lit("clash")})
    got = {r.path: (r.license, r.origin, r.directory) for r in licenses.scan(df).collect()}
    assert got["a/b/c/x"] == ("Apache-2.0", "inherited", "a/b") and got["a/z"] == ("MIT", "inherited", "a") and got["a/b/own"] == ("GPL-2.0", "own", None)
    assert got["d/x"] == got["ab/x"] == got["e"] == (None, "none", None) and got["a/LICENSE"][0] == "MIT"
    assert licenses.scan(df.limit(0)).count() == 0


GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */

int main() { return 0; }"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at http://mozilla.org/MPL/2.0/.

import os"""
MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation."""
LONG_LINE = "this module reads the tables of a run and writes them out again as one file for each of the days. Released under the MIT License. It is used by all of the other parts"


def test_headers_licence_files_and_notices_inside_lines(spark):
    rows = [("p/gpl.c", GPL), ("p/mpl.py", MPL), ("q/LICENSE.txt", MIT), ("q/x/y", "nothing"), ("r/bsd", BSD), ("r/other", "nothing"), ("s/long", LONG_LINE), ("LICENSE", "Licensed under CC BY-NC 4.0."), ("top", "x"), ("p/none", "y")]
    got = {r.path: (r.license, r.origin, r.directory) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: got[k][0] for k in ("p/gpl.c", "p/mpl.py", "q/LICENSE.txt", "r/bsd", "s/long")} == {"p/gpl.c": "GPL-3.0", "p/mpl.py": "MPL-2.0", "q/LICENSE.txt": "MIT", "r/bsd": "BSD-3-Clause", "s/long": "MIT"}
    # files that are no licence files say nothing of their directory
    assert got["q/x/y"] == ("MIT", "inherited", "q") and got["r/other"] == got["p/none"] == got["top"] == ("CC-BY-NC-4.0", "inherited", "")


def test_licenses_of_documents_without_an_id(spark):
    docs = documents(spark, [(None, "Released under the MIT License."), (12, "Released under the MIT License."), (13, "none")])
    got = sorted(((r.doc_id, r.path, r.license, r.origin) for r in licenses.scan_documents(docs).collect()), key=repr)
    assert got == [(12, "s/1/2", "MIT", "own"), (13, "s/1/3", "MIT", "inherited"), (None, None, None, "none")]


def test_placing_rows_with_clashing_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "k long, _slot string").withColumns({"slot": F.lit("x"), "shard": F.lit("x"), "__slot": F.lit("y")})
    got = sharding.place(rows, F.col("k").cast("string"), ["s0", "s1"], 101).collect()
    assert len(got) == 3
    assert len({(r["slot"], r["shard"]) for r in got if r["k"] is not None}) == 1 and [r["shard"] for r in got if r["k"] is None] == [None]
    placed = sharding.place(rows, F.col("k").cast("string"), ["s0", "s1"], 101)
    sharding.write_shards(placed.select("k", "shard"), f"file://{tmp_path}/a")
    sharding.write_shards(placed.select("k", "shard").limit(0), f"file://{tmp_path}/b")
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 3


def test_sharding_table():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(10))
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.15 * 1009
    for bad in (([], 7), (names, 1000)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_placement(spark):
    df = spark.createDataFrame([(1, "s", 2), (1, "s", 2), (None, "s", 3), (None, None, None)], "doc_id long, source string, n_chars long").withColumns({"slot": F.lit("clash"), "shard": F.lit("clash"), "text": F.lit("")})
    rows = sharding.place_documents(df).collect()
    assert len(rows) == 4 and all(r.shard for r in rows) and len({r.slot for r in rows if r.doc_id == 1}) == 1
    assert sharding.place_documents(df.limit(0)).count() == 0


def test_write_shards(spark, tmp_path):
    placed = sharding.place(spark.range(500).withColumn("k", F.col("id").cast("string")), F.col("k"), ["a", "b", "c"], 101)
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500


# -- SQL and the pipeline -----------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = q.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in found.collect())
    made = con.execute(q.oracle_sql()[name])
    at = [[c[0] for c in made.description].index(c) for c in columns]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in made.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = common.table(spark, DATA, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [(i, t) for i, t in texts if any(c.isalpha() for c in t or "")]
    first = {a for a, _, c in brute_components(kept) if a == c}
    kept = [(i, t) for i, t in kept if i in first]
    items = [r.text.lower() for r in common.table(spark, DATA, "benchmark").collect()]
    kept = [(i, t) for i, t in kept if not any(x in t.lower() for x in items)]
    rows = cp.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in kept}
    check_pieces(rows, kept)
    assert [n for n, _ in cp.STAGES] == ["language ID", "near-duplicates", "decontamination", "packing"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline_drops_unlearned_scripts(spark):
    import corpus_pipeline as cp

    rng = random.Random(3)
    scripts = [(0x4E00, 0x9FFF), (0x430, 0x44F), (0x3B1, 0x3C9), (0x627, 0x64A), (0xAC00, 0xD7A3)]
    made = ["".join(chr(rng.randint(a, b)) for _ in range(n)) for a, b in scripts for n in (80, 400) for _ in range(4)]
    known = common.table(spark, DATA, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs = known.unionByName(spark.createDataFrame([(-i, t, None, "s", len(t)) for i, t in enumerate(made, 1)], DOCS))
    kept = [r.doc_id for r in cp.language(spark, docs, DATA).collect()]
    assert not [i for i in kept if i < 0] and len(made) == 40 and len(kept) == known.filter(r"text rlike '\\p{L}'").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_what_each_stage_drops(spark, monkeypatch, broadcast):
    """Planted rows fall at the stage meant for them, and nothing else does."""
    import corpus_pipeline as cp

    monkeypatch.setattr(cp, "BROADCAST_IDS", broadcast)
    rng = random.Random(1)
    good = [(i, r.text) for i, r in enumerate(common.table(spark, DATA, "documents").filter("lang = 'en' and length(text) > 400").dropDuplicates(["text"]).orderBy("doc_id").limit(12).collect())]
    first = {a for a, _, c in brute_components(good) if a == c}
    items = [r.text for r in common.table(spark, DATA, "benchmark").orderBy("item_id").limit(3).collect()]
    good = [(i, t) for i, t in good if i in first and not any(r.text.lower() in t.lower() for r in common.table(spark, DATA, "benchmark").collect())]
    foreign = [(100 + i, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(200))) for i in range(3)] + [(110, "12 34 !!"), (111, ""), (112, None)]
    copies = [(200 + i, t) for i, t in good[:4]]
    leaks = [(300 + i, f"{good[5][1].split('.')[0]} number {i}. {x}") for i, x in enumerate(items)]
    docs = documents(spark, good + foreign + copies + leaks)
    dropped, before = [], {i for i, _ in good + foreign + copies + leaks}
    for _, stage in cp.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, DATA), "test")
        now = {r.doc_id for r in docs.collect()}
        dropped.append(before - now)
        before = now
    assert dropped == [{i for i, _ in foreign}, {i for i, _ in copies}, {i for i, _ in leaks}] and before == {i for i, _ in good}


def test_pipeline_stages_take_awkward_rows(spark):
    import corpus_pipeline as cp

    docs = documents(spark, AWKWARD).withColumns({"_rows": F.lit("clash"), "_score": F.lit("clash"), "_LANG_PRED": F.lit("clash")})
    letters = sorted(i for i, t in AWKWARD if i is not None and any(c.isalpha() for c in t or ""))
    assert sorted(r.doc_id for r in cp.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), DATA).filter("doc_id is not null").collect()) == letters
    for k, (_, stage) in enumerate(cp.STAGES):
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, DATA)
            assert out.count() >= 0 and (k == 3 or out.columns == docs.columns)


def test_near_duplicates_of_a_large_group_test_few_pairs(spark, monkeypatch):
    """The stage keeps the first of each component, and the pairs tested grow with the copies."""
    import corpus_pipeline as cp

    cases, tested = spread_copies(), count_tested(monkeypatch)
    kept = {r.doc_id for r in cp.near_duplicates(spark, documents(spark, cases), DATA).collect()}
    assert kept == {i for i, _, c in brute_components(cases) if i == c}
    assert sum(tested[1:]) <= 8 * len(cases)
