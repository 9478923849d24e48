"""Fixtures with answers worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.functions import filters as fl
from spindrift.functions import text as tx
from spindrift.functions import vectors as v
from spindrift.operators import collection as cl
from spindrift.operators import feedback as fb
from spindrift.operators import fusion, graph, ivf, kg, quantize, recommend, request, search, sparse
from spindrift.sources import files
from spindrift.streaming import changes as ch


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        (1, '{"name":"iPhone 15 Pro","category":"electronics","price":999.0,"stock":50,"tags":["phone","apple","5g"],"specs":{"brand":"Apple","storage":256}}'),
        (2, '{"name":"Samsung Galaxy S24","category":"electronics","price":899.0,"stock":0,"tags":["phone","samsung","android"],"specs":{"brand":"Samsung","storage":128}}'),
        (3, '{"name":"MacBook Pro 16","category":"computers","price":2499.0,"stock":20,"tags":["laptop","apple","professional"],"specs":{"brand":"Apple","ram":32}}'),
    ]
    return spark.createDataFrame(rows, "id int, j string").select("id", F.expr("parse_json(j)").alias("m"))


@pytest.mark.parametrize(
    ("document", "ids"),
    [
        ({"category": "electronics", "price": {"$lt": 1000}}, {1, 2}),
        ({"$and": [{"specs.brand": "Apple"}, {"stock": {"$gt": 0}}]}, {1, 3}),
        ({"$or": [{"price": {"$gt": 2000}}, {"stock": 0}]}, {2, 3}),
        ({"$and": [{"tags": {"$contains": "phone"}}, {"specs.storage": {"$gte": 256}}]}, {1}),
        ({"$and": [{"$not": {"specs.brand": "Samsung"}}, {"stock": {"$gt": 0}}]}, {1, 3}),
        ({"tags": {"$contains": "5g"}}, {1}),
        ({"specs.ram": {"$ne": 32}}, {1, 2}),
        ({"specs.ram": {"$exists": False}}, {1, 2}),
        ({"price": "999"}, {1}),
        ({}, {1, 2, 3}),
    ],
)
def test_filters(products, document, ids):
    assert {r.id for r in products.filter(fl.compile_filter(document, fl.Fields(variant="m"))).collect()} == ids


def test_filter_rejects_unknown_operator():
    with pytest.raises(ValueError):
        fl.compile_filter({"a": {"$near": 1}}, {"a": None})


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_typed_columns_push_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 10).cast("int").alias("label"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("name")).write.parquet(path)
    df = spark.read.parquet(path)
    found = df.filter(fl.compile_filter({"label": {"$gt": 5, "$in": [6, 8]}, "name": "s16"}, fl.Fields.of(df)))
    assert [r.id for r in found.collect()] == [16]
    assert "GreaterThan(label,5)" in plan_of(found) and "EqualTo(name,s16)" in plan_of(found) and "In(label" in plan_of(found)
    # missing values: false, and true under a negation
    assert df.filter(fl.compile_filter({"name": {"$gt": "a"}}, fl.Fields.of(df))).count() == 50
    assert df.filter(fl.compile_filter({"$not": {"name": {"$gt": "a"}}}, fl.Fields.of(df))).count() == 50
    assert df.filter(fl.compile_filter({"name": {"$nin": ["s16"]}}, fl.Fields.of(df))).count() == 99


def test_search_prunes_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.lit("long text").alias("text"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding")).write.parquet(path)
    plan = plan_of(search.knn(spark.read.parquet(path), [1.0, 0.0], 3))
    assert "ReadSchema: struct<id:bigint,embedding:array<double>>" in plan and "TakeOrderedAndProject" in plan


def test_fusion_by_hand(spark):
    rows = [("dense", 1, 1, 0.9), ("dense", 2, 2, 0.8), ("dense", 3, 3, 0.7), ("sparse", 3, 1, 10.0), ("sparse", 1, 2, 8.0), ("sparse", 4, 3, 6.0)]
    lists = spark.createDataFrame(rows, "list string, doc_id long, rank int, score double")
    found = fusion.rrf(lists, 10).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [1, 3, 2, 4]
    assert found[0].score == pytest.approx(1 / 60 + 1 / 61, abs=1e-9)
    w = {r.doc_id: r.score for r in fusion.weighted(lists, 10, {"dense": 0.7, "sparse": 0.3}).collect()}
    assert w == {1: pytest.approx(0.85), 2: pytest.approx(0.35), 3: pytest.approx(0.3), 4: pytest.approx(0.0)}
    with pytest.raises(ValueError):
        fusion.validate({"a": -1.0})


def test_bm25_corpus(spark):
    docs = spark.createDataFrame([(i, [0, i + 1], [1.0, i + 1.0], 100) for i in range(10)], "doc_id long, i array<int>, v array<double>, d int")
    docs = docs.select("doc_id", F.struct(F.col("i").alias("indices"), F.col("v").alias("values"), F.col("d").alias("dim")).alias("keywords"))
    found = sparse.search_bm25(sparse.postings_of(docs), {0: 1.0}, 10).orderBy("rank").collect()
    assert len(found) == 10 and found[0].doc_id == 0 and all(r.score > 0 for r in found)
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True)


def test_knn_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0])], "id long, embedding array<double>")
    got = search.knn(df, [1.0, 0.0], 10).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in got] == [(1, 0.0), (5, 0.0), (2, 1.0)]
    batch = search.knn_batch(spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query array<double>"), df, 2).orderBy("rank").collect()
    assert [r.id for r in batch] == [1, 5]
    with pytest.raises(ValueError):
        search.knn(df, [1.0, 0.0], 0)


def test_page_tokens():
    request = {"q": "x", "top_k": 3}
    token = search.encode_token(20, request, 7)
    assert search.decode_token(token, request, 7) == 20
    for bad in (lambda: search.decode_token(token, {"q": "y"}), lambda: search.decode_token(token, request, 8), lambda: search.decode_token("!!", request)):
        with pytest.raises(ValueError):
            bad()


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.tokenize(F.lit("The Cat, and a DOG!")).alias("t"),
        tx.term_hash(F.lit("ab")).alias("h"),
        tx.clean_fences(F.lit('```json\n{"a":1}\n```')).alias("c"),
        tx.parse_pairs(F.lit("k=v,k2=v2")).alias("p"),
        tx.char_ngrams(F.lit("abcd"), 3, 4).alias("g"),
        tx.glyph_map(F.create_map(F.lit("b"), F.lit('x"'), F.lit("a"), F.lit("y"))).alias("m"),
    ).first()
    assert row.t == ["cat", "dog"] and row.h == (5381 * 33 + 97) * 33 + 98 and row.c == '{"a":1}' and row.p == {"k": "v", "k2": "v2"}
    assert row.g == ["abc", "bcd", "abcd"] and row.m == '{a:"y" b:"x\\""}'


def test_chunkers():
    assert tx.sentences("One. two is 3.5 long. Three!\nFour") == ["One.", "two is 3.5 long.", "Three!", "Four"]
    assert tx.embedding_chunks("short", 100) == ["short"] and tx.embedding_chunks(None, 10) == [""]
    parts = tx.embedding_chunks("Aaa bbb. Ccc ddd. Eee fff.", 18, 4)
    assert parts[0] == "Aaa bbb. Ccc ddd." and all(len(p) <= 22 for p in parts)
    chunks = tx.extraction_chunks("Ab. Cd. Ef.", 6, 2)
    assert [c[2] for c in chunks][0] == "Ab.Cd." and chunks[1][1] == 4
    assert tx.extraction_chunks("", 10) == [] and tx.extraction_chunks(None, 10) == []


def test_half_floats(spark):
    values = [1.0, -2.5, 65504.0, 1e6, 1e-6, 0.0, math.inf, 1.0009765]
    df = spark.createDataFrame([(values,)], "x array<float>").select(quantize.fp16_decode(quantize.fp16_encode("x")).alias("y"))
    assert df.first().y[:7] == [1.0, -2.5, 65504.0, math.inf, 0.0, 0.0, math.inf]


def test_bits_round_trip(spark):
    df = spark.createDataFrame([(1, [0.5, -0.5] * 40)], "id long, x array<double>")
    row = df.select(quantize.binary_decode(quantize.binary_encode("x", [0.0] * 80), 80).alias("y")).first()
    assert row.y == [1.0, -1.0] * 40


def test_pq_recall(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(200, 8))
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "embedding": rows.tolist()}))
    book = ivf.fit_pq(df, 4, 16, 3)
    q = rows[3].tolist()
    got = {r.id for r in quantize.pq_search(df.select("id", book.encode("embedding").alias("codes")), book, q, 20).collect()}
    true = set(np.argsort(((rows - rows[3]) ** 2).sum(1))[:5].tolist())
    assert len(got & true) >= 4


def test_recommend_errors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "id long, embedding array<double>")
    with pytest.raises(ValueError):
        recommend.recommend(df, [])
    with pytest.raises(KeyError):
        recommend.recommend(df, [9])
    assert [r.id for r in recommend.recommend(df, [1], k=2).collect()] == [2]


def test_graph(spark):
    nodes = spark.createDataFrame([(1, "alice", "Alice Smith"), (1, "acme", "Acme Corp"), (2, "bob", "Bob Jones"), (2, "acme", "Acme Corp"), (2, "alice", "Alice Smith"), (3, "charlie", "Charlie Brown"), (3, "bigco", "BigCo Inc")], "doc_id long, id string, name string").withColumns({"type": F.lit("E"), "description": F.lit("")})
    edges = spark.createDataFrame([(1, "alice", "acme", "WORKS_FOR"), (2, "bob", "acme", "WORKS_FOR"), (2, "bob", "alice", "KNOWS"), (3, "charlie", "bigco", "WORKS_FOR")], "doc_id long, src string, dst string, rel string").withColumn("weight", F.lit(1.0))
    found = {r.doc_id: r.score for r in graph.graph_search(nodes, edges, ["alice"], 10).collect()}
    assert {1, 2} <= set(found) and found.get(3, 0.0) <= max(found.values())
    ranks = {r.id: r.rank for r in graph.pagerank(nodes, edges).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks["acme"] == max(ranks.values())
    assert graph.pagerank(nodes.limit(0), edges).count() == 0
    v_ = graph.violations(nodes, edges.unionByName(spark.createDataFrame([(4, "x", "", "R", 1.0)], edges.schema))).first()
    assert (v_.nodes_without_id, v_.edges_without_end, v_.edges_to_unknown) == (0, 1, 1)
    pairs = [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2"), ("b2", "b3"), ("b1", "b3")]
    n2 = spark.createDataFrame([(i % 4, x) for i, x in enumerate(["a1", "a2", "a3", "b1", "b2", "b3"])], "doc_id long, id string")
    e2 = spark.createDataFrame(pairs, "src string, dst string")
    labels = {r.id: r.community for r in graph.communities(n2, e2).collect()}
    assert labels["a1"] == labels["a2"] == labels["a3"] != labels["b1"] == labels["b2"] == labels["b3"]
    new_n, new_e = graph.upsert_document(nodes, edges, nodes.limit(0), edges.limit(0))
    assert (new_n.count(), new_e.count()) == (7, 4)


def test_kg(spark):
    docs = spark.createDataFrame([(1, "Alice Smith met Bob Jones in Paris on a day that was long enough for them. " * 2), (2, "too short"), (3, None)], "doc_id long, text string")
    nodes, edges, found = kg.cognify(docs)
    assert {r.id for r in nodes.collect()} == {"alice_smith", "bob_jones", "paris"} and edges.count() >= 2 and [r.doc_id for r in found.collect()] == [1]
    glyph = '```glyph\n@tab Node [id name type]\na "Ann A" Person\nb Bob Person\n@end\n@tab Edge [src dst rel]\na b KNOWS\na zz KNOWS\n@end\n@tab Event [id date entities]\ne1 2020-01-02 [a b]\n@end\n```'
    n, e, t = kg.from_glyph(spark.createDataFrame([(1, glyph)], "doc_id long, text string"))
    assert {(r.id, r.name) for r in n.collect()} == {("a", "Ann A"), ("b", "Bob")} and [r.dst for r in e.collect()] == ["b"] and t.first().entities == ["a", "b"]


def test_feedback_rules(spark):
    row = spark.range(1).select(
        fb.rating_sentiment(F.lit(5)).alias("a"), fb.rating_sentiment(F.lit(3)).alias("b"), fb.rating_sentiment(F.lit(1)).alias("c"), fb.rating_kind(F.lit(2)).alias("d"),
        fb.implicit_kind(F.lit("dwell"), F.lit(6000)).alias("e"), fb.implicit_kind(F.lit("dwell"), F.lit(10)).alias("f"), fb.fold(F.array(*[F.lit(1.5)] * 4, F.lit(-0.1))).alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (1.0, 0.0, -1.0, "thumbs_down", "dwell", "ignore") and row.g == pytest.approx(2.9)


def test_boost_stream(spark, tmp_path):
    schema = "target_id string, query_hash string, ts timestamp, feedback_id string, delta double"
    rows = spark.createDataFrame([("r1", "q", "f1", 0.1), ("r1", "q", "f2", 0.1), ("r2", "", "f3", -5.0)], "target_id string, query_hash string, feedback_id string, delta double").select("target_id", "query_hash", F.lit("2024-01-01").cast("timestamp").alias("ts"), "feedback_id", "delta")
    rows.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = ch.boost_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    got = {r.target_id: (round(r.boost, 6), r["count"]) for r in ch.run_available(stream, "boosts_test", "update", str(tmp_path / "cp")).collect()}
    assert got == {"r1": (1.2, 2), "r2": (0.1, 1)}


def test_event_time_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = ch.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")).withColumn("ts", F.col("ts").cast("timestamp")))
    got = ch.run_available(stream, "windows_test", "append", str(tmp_path / "cp")).count()
    assert 0 < got <= ch.tumbling(events).count()


def test_manager(spark, tmp_path):
    m = cl.Manager(spark, f"file://{tmp_path}/root")
    schema = cl.Schema("c1", [cl.VectorField("embedding", 2), cl.VectorField("keywords", 10, "sparse", "inverted")])
    m.create(schema)
    assert m.list() == ["c1"] and m.docs("c1").count() == 0
    rows = spark.createDataFrame([([1.0, 0.0], ([1], [2.0], 10), "{}"), ([0.0, 1.0], ([2], [1.0], 10), "{}")], "embedding array<float>, keywords struct<indices:array<int>,values:array<float>,dim:int>, metadata string")
    m.add("c1", rows, ["metadata"])
    assert sorted(r.id for r in m.docs("c1").collect()) == [1, 2]
    with pytest.raises(ValueError):
        m.add("c1", rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), ["metadata"])
    m.delete("c1", spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in m.docs("c1").collect()] == [2] and m.docs("c1", 1).count() == 2
    assert len(m.compact("c1")) == 2
    m.rename("c1", "c2")
    assert m.has("c2") and not m.has("c1") and m.stats().first().documents == 1
    for bad in (cl.Schema("x y", schema.fields), cl.Schema("a", []), cl.Schema("a", [cl.VectorField("v", 3, "dense", "inverted")]), cl.Schema("a", [cl.VectorField("v", 3, "binary")])):
        with pytest.raises(ValueError):
            bad.validate()
    m.drop_all()
    assert m.list() == []


def test_writers_append_and_conflicts_are_seen(spark, tmp_path):
    m = cl.Manager(spark, f"file://{tmp_path}/root")
    m.create(cl.Schema("c", [cl.VectorField("v", 1)]))
    rows = lambda *xs: spark.createDataFrame([(i, [float(x)], "{}") for i, x in xs], "id long, v array<float>, metadata string")
    m.add("c", rows((1, 1), (2, 2), (3, 3)))
    m.upsert("c", rows((2, 20), (4, 40)))
    m.delete("c", spark.createDataFrame([(3,), (3,), (9,)], "id long"))
    m.add("c", rows((5, 5)))
    m.upsert("c", rows((3, 30)))
    got = lambda v=None: {r.id: r.v[0] for r in m.docs("c", v).collect()}
    assert got() == {1: 1.0, 2: 20.0, 3: 30.0, 4: 40.0, 5: 5.0} and got(1) == {1: 1.0, 2: 2.0, 3: 3.0} and got(3) == {1: 1.0, 2: 20.0, 4: 40.0}
    written = [x for x in (tmp_path / "root" / "default" / "c").iterdir() if x.name.startswith("v5-")]
    assert spark.read.parquet(f"file://{written[0]}").count() == 1  # a change writes its own rows
    with pytest.raises(cl.Conflict):  # another writer was first
        m._commit("c", rows((7, 7)), 5, "add")
    assert m.compact("c", keep=2) == [] and got() == {1: 1.0, 2: 20.0, 3: 30.0, 4: 40.0, 5: 5.0} and got(4) == {1: 1.0, 2: 20.0, 4: 40.0, 5: 5.0}
    assert m.compact("c") == ["v0", "v1", "v2", "v3", "v4"] and got() == {1: 1.0, 2: 20.0, 3: 30.0, 4: 40.0, 5: 5.0}
    with pytest.raises(KeyError):
        m.docs("c", 2)


def test_search_entry(spark):
    rows = [(i, [float(i % 5), float(i % 3) + 1], "a" if i % 2 else "b") for i in range(1, 30)]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>, kind string")
    postings = spark.createDataFrame([(i, i % 4, 1.0 + i) for i in range(1, 30)], "id long, term int, tf double")
    ask = lambda **x: request.run(docs, request.Request(**x), postings).orderBy("rank").collect()
    both = ask(dense=[1.0, 1.0], sparse={1: 2.0, 2: 1.0}, top_k=6)
    near, found = ask(dense=[1.0, 1.0], top_k=12), ask(sparse={1: 2.0, 2: 1.0}, top_k=12)
    score = {}
    for ranked in (near, found):
        for r in ranked:
            score[r.id] = score.get(r.id, 0.0) + 1 / (60 + r["rank"] - 1)
    best = sorted(((-round(s, 9), i) for i, s in score.items()))[:6]
    assert [r.id for r in both] == [i for _, i in best] and "embedding" not in both[0]
    assert {r.kind for r in ask(dense=[1.0, 1.0], filter={"kind": "a"}, top_k=9)} == {"a"}
    assert ask(dense=[1.0, 1.0], filter={"kind": "none"}) == [] and len(ask(dense=[[1.0, 1.0], [2.0, 1.0]], top_k=3)) == 6
    for bad in ({}, {"dense": [[1.0]], "sparse": {1: 1.0}}, {"dense": [1.0], "top_k": 0}, {"dense": [1.0], "weights": {"dense": -1.0}}):
        with pytest.raises(ValueError):
            request.Request(**bad).validate()


def test_followed_table_is_appended(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    rows = lambda *xs: spark.createDataFrame(list(xs), "id string, seq long, op string, doc string")
    log = f"file://{tmp_path}/log"
    rows(("a", 1, "insert", "x"), ("b", 2, "insert", "y")).coalesce(1).write.json(log + "/1")
    full = spark.createDataFrame([], files.LOG_SCHEMA)
    for n, batch in enumerate([rows(("a", 1, "insert", "x"), ("b", 2, "insert", "y")), rows(("a", 3, "upsert", "z"), ("a", 4, "delete", None)), rows(("c", 5, "insert", "w"))]):
        cl.latest(full.unionByName(batch, allowMissingColumns=True)).write.parquet(f"{table}/v{n}")
    got = lambda: sorted((r.id, r.seq, r.op) for r in ch.state_of(spark, table).collect())
    want = [("a", 4, "delete"), ("b", 2, "insert"), ("c", 5, "insert")]
    assert got() == want
    ch.compact(spark, table)
    assert got() == want and [x.name for x in (tmp_path / "t").iterdir()] == ["base3"]


def test_csr_offsets(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "id string")
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("e", "a"), ("b", "a"), ("x", "a")], "src string, dst string")
    got = {r.id: (r.first, list(r.neighbours)) for r in graph.csr(nodes, edges).collect()}
    assert got == {"a": (0, []), "b": (0, ["a", "a", "c"]), "c": (3, []), "d": (3, []), "e": (3, ["a"]), "f": (4, [])}


def test_binary_sources(spark, tmp_path):
    rows = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "a.fvecs").write_bytes(files.fvecs_bytes(rows))
    got = files.read_fvecs(spark, f"file://{tmp_path}/a.fvecs", 3).orderBy("id").collect()
    assert [list(r.embedding) for r in got] == rows.tolist()
    (tmp_path / "bulk.bin").write_bytes(files.binary_import_bytes([5, 6, 7, 8], rows))
    got = files.read_binary_import(spark, f"file://{tmp_path}/bulk.bin").orderBy("id").collect()
    assert [r.id for r in got] == [5, 6, 7, 8] and list(got[1].embedding) == [3.0, 4.0, 5.0]


def test_jsonl_and_snapshots(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id":"1","doc":"a"}\nnot json\n{"id":"2","text":"b","meta":{"k":"v"}}\n{"id":"3","text":" "}\n')
    df = files.read_jsonl(spark, f"file://{tmp_path}/in.jsonl")
    assert sorted((r.id, r.text) for r in df.collect()) == [("1", "a"), ("2", "b")]
    docs = df.withColumns({"collection": F.lit("c"), "deleted": F.col("id") == "1"})
    mark = files.export_collection(docs, "c", f"file://{tmp_path}/out")
    back = files.import_collection(spark, f"file://{tmp_path}/out", docs.schema.simpleString().removeprefix("struct<")[:-1].replace(":", " "), mark)
    assert [r.id for r in back.collect()] == ["2"]
    files.save_snapshot(docs, f"file://{tmp_path}/snap", ("collection",))
    assert files.load_snapshot(spark, f"file://{tmp_path}/snap").count() == 2


def test_vault(spark, tmp_path):
    (tmp_path / ".trash").mkdir()
    (tmp_path / ".trash" / "x.md").write_text("gone")
    (tmp_path / "202401011200 a.md").write_text("---\ntags:\n  - One\n  - '#two'\n---\n# H\n[[b]] #one #x/y\n## not #h")
    (tmp_path / "b.md").write_text("plain")
    notes = files.backlinks(files.parse_notes(files.read_vault(spark, f"file://{tmp_path}")))
    rows = {r.name: r for r in notes.collect()}
    assert set(rows) == {"202401011200 a", "b"}
    assert rows["202401011200 a"].zettel_id == "202401011200" and rows["202401011200 a"].links == ["b"] and rows["b"].backlinks == ["202401011200 a"]
    assert files.orphans(notes, notes.filter("name = 'b'").select("path")).count() == 1


def test_fold_keeps_first_seq(spark):
    log = spark.createDataFrame([(1, "insert", "a", "x"), (2, "upsert", "a", "y"), (3, "delete", "a", None), (4, "insert", "a", "z"), (5, "upsert", "a", "w"), (6, "delete", "b", None)], "seq long, op string, id string, doc string")
    assert [tuple(r) for r in cl.fold_changes(log).select("id", "seq", "first_seq", "doc").collect()] == [("a", 5, 4, "w")]


def test_metric_registry(spark):
    v.register_distance("manhattan", lambda a, b: F.aggregate(F.zip_with(v.vec(a), v.vec(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    assert search.knn(df, [0.0, 0.0], 1, "manhattan").first().distance == 3.0


def test_feedback_sources(spark):
    ts = F.lit("2024-01-01").cast("timestamp")
    ratings = spark.createDataFrame([("a", "i", 5), ("b", "i", 3), ("c", "i", 1)], "id string, interaction_id string, rating int").withColumns({"clicked_ids": F.array(F.lit("x")), "rejected_ids": F.array(F.lit("y")), "ts": ts})
    assert {r.id: (r.type, r.sentiment) for r in fb.explicit(ratings).collect()} == {"a": ("thumbs_up", 1.0), "b": ("explicit", 0.0), "c": ("thumbs_down", -1.0)}
    signals = spark.createDataFrame([("a", "i", "dwell", 9000), ("b", "i", "dwell", 1), ("c", "i", "wave", 0)], "id string, interaction_id string, signal string, duration_ms int").withColumns({"target_ids": F.array(F.lit("x")), "ts": ts})
    assert {r.id: (r.type, r.sentiment > 0) for r in fb.implicit(signals).collect()} == {"a": ("dwell", True), "b": ("ignore", False)}
    texts = spark.createDataFrame([("a", "i", "great, thanks"), ("b", "i", None)], "id string, interaction_id string, text string").withColumn("ts", ts)
    assert {r.id: round(r.sentiment, 6) for r in fb.natural(texts).collect()} == {"a": 0.6, "b": 0.0}
    interactions = spark.createDataFrame([("i", "q", ["x", "y"])], "id string, query_hash string, result_ids array<string>")
    made = {(r.target_id, r.query_hash): r.boost for r in fb.boosts(fb.deltas(interactions, fb.explicit(ratings))).collect()}
    assert made == {("x", "q"): 1.1, ("x", ""): 1.05, ("y", "q"): 0.85, ("y", ""): 0.925}
    boosted, shown = fb.record_and_boost(spark.createDataFrame([("x", 1.0), ("y", 2.0)], "id string, score double"), fb.boosts(fb.deltas(interactions, fb.explicit(ratings))), "cats", ts)
    assert [r.id for r in boosted.orderBy("rank").collect()] == ["y", "x"] and shown.first().result_ids == ["y", "x"]


def test_parse_time(spark):
    texts = ["2024-02-03T04:05:06Z", "2024-02-03", "2024-02-03 04:05:06", "Sat, 03 Feb 2024 04:05:06 GMT", "soon", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fl.parse_time(F.col("t")).cast("string").alias("at"))
    assert {r.i: r.at for r in rows.collect()} == {0: "2024-02-03 04:05:06", 1: "2024-02-03 00:00:00", 2: "2024-02-03 04:05:06", 3: "2024-02-03 04:05:06", 4: None, 5: None}


def test_sync_plan_and_log(spark):
    day = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    had = spark.createDataFrame([("a",), ("b",), ("c",)], "path string").withColumn("modified", day(1))
    has = spark.createDataFrame([("a",), ("b",), ("d",)], "path string").withColumn("modified", F.when(F.col("path") == "a", day(1)).otherwise(day(2)))
    assert {r.path: r.action for r in files.sync_plan(had, has).collect()} == {"b": "update", "c": "delete", "d": "add"}
    log = spark.range(5, 9).select(F.col("id").alias("seq"))
    assert [r.seq for r in files.since(log, 6).collect()] == [7, 8]
    with pytest.raises(ValueError):
        files.since(log, 2)


def test_postings_are_added_once(spark):
    p = spark.createDataFrame([(1, 5, 1.0)], "doc_id long, term int, tf double")
    assert sparse.add(p, p.withColumn("doc_id", F.lit(2).cast("long"))).count() == 2
    with pytest.raises(ValueError):
        sparse.add(p, p)


def test_sparse_codecs(spark):
    df = spark.createDataFrame([([0.0, 2.0, 0.0, -1.0],)], "x array<double>").select(v.sparse_from_dense("x").alias("s"))
    row = df.select(files.parse_sparse_json(files.sparse_json(F.col("s"))).alias("j"), v.sparse_to_dense(F.col("s")).alias("d"), v.sparse_valid(F.col("s")).alias("ok"), v.sparse_scale(F.col("s"), 2.0).alias("t"), v.sparse_normalize(F.col("s")).alias("n")).first()
    assert (row.j.indices, row.j["values"], row.j.dim) == ([1, 3], [2.0, -1.0], 4) and row.d == [0.0, 2.0, 0.0, -1.0] and row.ok
    assert row.t["values"] == [4.0, -2.0] and math.hypot(*row.n["values"]) == pytest.approx(1.0)
    blob = spark.createDataFrame([([1.5, -2.0],)], "x array<float>").select(quantize.blob_decode(quantize.blob_encode("x")).alias("y")).first()
    assert blob.y == [1.5, -2.0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert search.knn(none, [1.0], 3).count() == 0 and search.knn_batch(none.selectExpr("id as query_id", "embedding as query"), none, 3).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert search.lexical(docs, "word", 3).count() == 0 and search.bm25_scores(docs.union(spark.createDataFrame([(1, "word")], docs.schema)), "").count() == 0
    assert cl.fold_changes(spark.createDataFrame([], "seq long, op string, id string, doc string")).count() == 0


@pytest.mark.parametrize("n", [3, 10, 200])
def test_nearest_keeps_ties_by_id(n):
    rng = np.random.default_rng(n)
    d = rng.integers(0, 6, (5, n)).astype(float)
    ids = rng.permutation(n)
    got_d, got_i = search._nearest(d, ids, 4)
    for q in range(5):
        true = sorted(zip(d[q].tolist(), ids.tolist(), strict=True))[:4]
        assert list(zip(got_d[q].tolist(), got_i[q].tolist(), strict=True)) == true


def test_strategies_agree(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(300, 12)).tolist())], "id long, embedding array<double>")
    q = rng.normal(size=12).tolist()
    for metric in ("cosine", "l2", "dot", "l2_squared", "cosine_normalized"):
        a, b = (sorted((r["rank"], r.id, r.distance) for r in search.knn(df, q, 7, metric, strategy=s).collect()) for s in ("columns", "matmul"))
        assert a == b
    from spindrift.operators import indexes

    exact = [r.id for r in indexes.create("flat", df)(q, 10).collect()]
    for name, params in (("ivf", {"nlist": 8, "nprobe": 8}), ("binary", {"rescore": 20}), ("ivf_binary", {"nlist": 8, "nprobe": 6, "rescore": 20}), ("pq", {"m": 6, "ksub": 64, "rounds": 4}), ("ivf_pq", {"nlist": 4, "nprobe": 4, "m": 6, "ksub": 32, "rounds": 2})):
        found = {r.id for r in indexes.create(name, df, **params)(q, 30 if "pq" in name else 10).collect()}
        assert len(found & set(exact)) >= 7, name
    with pytest.raises(ValueError):
        indexes.create("tree", df)


def test_term_hashes_agree(spark):
    words = ["ab", "", "é", "日本", "x" * 50, None, "ab"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", tx.term_hash(F.col("w")).alias("a"), tx.term_hashes("w").alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len({r.a for r in rows}) == 6


def test_numbered_over_many_ranges(spark, tmp_path):
    spark.range(300_000).selectExpr("id", "pmod(xxhash64(id), 1000) as ts", "repeat('x', 40) as more").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = cl.assign_ids(rows, 1000, ["ts", "id"]).select("ts", "id", "more").toPandas()
        kept = cl.numbered(rows, ["ts", "id"]).select("ts", F.col("id").alias("key"), "n").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got["id"]) == list(range(1000, 301_000))
    assert kept.sort_values(["ts", "key"])["n"].tolist() == list(range(300_000))


def test_boost_input_is_not_one_task(spark, monkeypatch, tmp_path):
    from spindrift.plans import store_queries

    made = []
    monkeypatch.setattr(store_queries, "scratch_path", lambda s, tag: made.append(str(tmp_path / tag)) or made[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store_queries.QUERIES["stream_boosts"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "boosts" / "in").glob("*.parquet"))) > 1


def test_deltas_in_order_hold_few(monkeypatch):
    monkeypatch.setattr(ch, "HELD", 50)
    monkeypatch.setattr(ch, "READ", 7)
    monkeypatch.setattr(ch, "RUNS", 3)
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"ts": pd.to_datetime(rng.integers(0, 40, 1003), unit="s"), "feedback_id": [f"f{i}" for i in rng.integers(0, 30, 1003)], "delta": rng.normal(size=1003)})
    seen = [0]

    def frames():
        for at in range(0, len(f), 20):
            seen[0] += 1
            yield f[at : at + 20]

    assert list(ch.in_order(frames())) == f.sort_values(["ts", "feedback_id", "delta"])["delta"].tolist() and seen[0] == 51


def test_chunks_leave_in_pieces(spark, monkeypatch):
    long = "One two three. " * 40_000
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "Ab. Cd."), (None, "Ef.")], "doc_id long, text string").coalesce(1)
    chunks = tx.chunk(docs)
    assert "whole" not in plan_of(chunks)
    got = chunks.withColumn("t", F.when(F.col("doc_id") == 1, F.lit(long)).when(F.col("doc_id") == 4, F.lit("Ab. Cd.")).otherwise(F.lit("Ef."))).withColumn("own", tx.chunk_id(F.col("t"), F.col("index"))).drop("t").collect()
    assert all(r.own == r.chunk_id for r in got)
    assert sorted((r.doc_id or 0, r["index"], r.offset, r.chunk) for r in got) == sorted((k, *c) for k, t in ((1, long), (4, "Ab. Cd."), (0, "Ef.")) for c in tx.extraction_chunks(t))


def test_extractor_sees_few_chunks(spark):
    from spindrift.operators import kg

    def sizes(texts):
        return pd.DataFrame({"nodes": [[{"id": str(len(texts)), "name": "n", "type": "t", "description": ""}] for _ in texts], "edges": [[] for _ in texts]})

    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('Some words of a text. ', 10) as text").coalesce(1)
    found = kg.extract(docs, sizes).select(F.explode("graph.nodes").alias("n")).select(F.col("n.id").cast("int").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("all")).first()
    assert found.most <= 256 and found.all == 2000


def test_postings_without_shuffle(spark):
    from spindrift.operators import migration

    rows = [(1, "Der Hund und der Hund, été 日本語"), (2, None), (3, ""), (4, "the of"), (5, "hund katze maus " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = docs.select("doc_id", F.explode(tx.tokenize_terms(F.col("text"), tx.STOPWORDS)).alias("w"))
    for dim in (7, 1024):
        want = {(r.doc_id, r.t): r.n for r in words.groupBy("doc_id", (tx.term_hash(F.col("w")) % dim).cast("int").alias("t")).agg(F.count("*").cast("double").alias("n")).collect()}
        made = sparse.hashed_postings(docs, dim)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert {(r.doc_id, r.term): r.tf for r in made.collect()} == want
        twice = sparse.hashed_postings(docs.union(docs), dim).collect()
        assert {(r.doc_id, r.term): r.tf for r in twice} == {k: 2 * n for k, n in want.items()} and len(twice) == len(want)
        held = migration.sparse_vectors(docs, dim).collect()
        assert {r.doc_id: dict(zip(r.keywords.indices, r.keywords["values"], strict=True)) for r in held} == {k: {t: n for (i, t), n in want.items() if i == k} for k, _ in rows}
    both = docs.withColumns({"embedding": F.array(F.lit(1.0)), "meta": F.create_map(F.lit("a"), F.lit("b"))})
    made = migration.to_collection(both, 7)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 5
    assert sorted(map(str, made.select("keywords").collect())) == sorted(map(str, migration.sparse_vectors(docs.union(docs.limit(0)), 7).select("keywords").collect()))


@pytest.mark.parametrize("metric", ["l2", "l2_squared"])
def test_close_pairs_leave_the_nearest(metric):
    rng = np.random.default_rng(6)
    block, rows = rng.integers(0, 5, (40, 6)).astype(float), rng.integers(0, 5, (900, 6)).astype(float)
    ids = rng.permutation(900)
    best = search._nearest(search._distances(block, rows[:300], metric), ids[:300], 4)
    for at in range(300, 900, 300):
        tile = rows[at : at + 300]
        close = search._close(block, tile, best[0][:, -1], metric)
        assert close is not None and len(close[0]) < 40 * 300
        best = search._merged(*best, close, block, tile, ids[at : at + 300], metric)
    want = search._nearest(search._distances(block, rows, metric), ids, 4)
    assert (best[0] == want[0]).all() and (best[1] == want[1]).all()
