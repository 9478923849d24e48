"""Registered queries on stored collections, files, graphs, feedback sources, codecs and paging, each with its SQL.

Those on sources and stores write to the shared folder and return what they read back.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters as fl
from ..functions import text as tx
from ..functions import vectors as v
from ..operators import collection as cl
from ..operators import feedback as fb
from ..operators import fusion, graph, kg, quantize, recommend, request, search, sparse, stats
from ..session import scratch_path, table
from ..sources import files
from ..streaming import changes as ch
from .engine_queries import BOOSTS, FEED, KG, _feed, _kg
from .search_queries import SPARSE_QUERY, _sparse_sql, vector_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# -- collections --------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str, name: str = "supplier") -> DataFrame:
    """Suppliers as rows of a collection: id, v (two values), metadata."""
    value = F.array((F.col("s_suppkey") % 97).cast("float"), F.col("s_nationkey").cast("float"))
    return table(spark, d, name).select((F.col("s_suppkey") + 1).alias("id"), value.alias("v"), F.to_json(F.struct(F.col("s_name").alias("name"))).alias("metadata"))


def _store(spark: SparkSession, tag: str, tenant: str = "default") -> cl.Manager:
    return cl.Manager(spark, scratch_path(spark, tag), tenant)


SUPPLIERS = "s AS (SELECT s_suppkey + 1 AS id, (s_suppkey % 97)::DOUBLE AS a, s_nationkey::DOUBLE AS b FROM supplier)"


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.col("v")[0].cast("double").alias("a"), F.col("v")[1].cast("double").alias("b"))


@query(f"WITH {SUPPLIERS} SELECT id, CASE WHEN id % 5 = 0 THEN -1.0 ELSE a END::DOUBLE AS a, b FROM s WHERE id % 7 <> 0 UNION ALL SELECT id + 1000000, a, b FROM s WHERE id % 5 = 0")
def store_write_and_delete(spark, d):
    """Insert in bulk, replace, insert more, delete, compact: what the collection then holds."""
    m, rows = _store(spark, "store"), _vectors(spark, d)
    m.create(cl.Schema("c", [cl.VectorField("v", 2)]))
    m.add("c", rows)
    m.upsert("c", rows.filter("id % 5 = 0").withColumn("v", F.array(F.lit(-1.0).cast("float"), F.col("v")[1])))
    m.add("c", rows.filter("id % 5 = 0").withColumn("id", F.col("id") + 1_000_000))
    m.delete("c", rows.filter("id % 7 = 0").select("id"))
    m.compact("c")
    return _plain(m.docs("c"))


@query(f"WITH {SUPPLIERS} SELECT id, a, b FROM s WHERE id % 2 = 1")
def store_older_version(spark, d):
    """A version before later changes."""
    m, rows = _store(spark, "store"), _vectors(spark, d)
    m.create(cl.Schema("c", [cl.VectorField("v", 2)]))
    m.add("c", rows.filter("id % 2 = 1"))
    m.upsert("c", rows)
    return _plain(m.docs("c", 1))


@query("SELECT id, row_number() OVER (ORDER BY s_name) AS given FROM (SELECT s_suppkey AS id, s_name FROM supplier)")
def store_given_ids(spark, d):
    """Rows without an id get the next ones, in the order asked for."""
    m, rows = _store(spark, "store"), table(spark, d, "supplier")
    m.create(cl.Schema("c", [cl.VectorField("v", 1)]))
    m.add("c", rows.select(F.array(F.col("s_suppkey").cast("float")).alias("v"), F.col("s_name").alias("metadata")), ["metadata"])
    names = rows.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("metadata"))
    return m.docs("c").select(F.col("id").alias("given"), "metadata").join(names, "metadata").select("id", "given")


@query("SELECT 'c9' AS collection, count(*) AS documents, 'nation' AS owner FROM nation UNION ALL SELECT 'empty', 0, NULL")
def store_catalog(spark, d):
    """Create, rename, drop, metadata and counts of collections."""
    m = _store(spark, "store")
    for name in ("c1", "c2", "empty"):
        m.create(cl.Schema(name, [cl.VectorField("v", 1)]))
    n = table(spark, d, "nation")
    m.add("c1", n.select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.array(F.lit(0.0).cast("float")).alias("v"), F.col("n_name").alias("metadata")))
    m.update_metadata("c1", {"owner": "nation"})
    m.rename("c1", "c9")
    m.drop("c2")
    owners = spark.createDataFrame([(n, m.schema(n).metadata.get("owner")) for n in m.list() if m.has(n)], "collection string, owner string")
    return m.stats().join(owners, "collection")


@query("SELECT 't' || r_regionkey AS tenant, count(*) AS documents FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def store_tenants(spark, d):
    """A folder of collections for each tenant, written and listed again."""
    root = scratch_path(spark, "tenants")
    n = table(spark, d, "nation")
    for r in table(spark, d, "region").orderBy("r_regionkey").collect():  # five tenants
        m = cl.Manager(spark, root, f"t{r.r_regionkey}")
        m.create(cl.Schema("c", [cl.VectorField("v", 1)]))
        m.add("c", n.filter(F.col("n_regionkey") == r.r_regionkey).select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.array(F.lit(1.0).cast("float")).alias("v"), F.col("n_name").alias("metadata")))
    found = [cl.Manager(spark, root, t).stats().select(F.lit(t).alias("tenant"), "documents") for t in cl.Manager(spark, root).tenants()]
    return reduce(DataFrame.unionByName, found)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'id' WHEN s_suppkey % 3 = 1 THEN 'v' END AS reason FROM supplier WHERE s_suppkey % 3 < 2")
def store_refused_rows(spark, d):
    """Rows that a collection doesn't take, with the field at fault."""
    k = F.col("s_suppkey")
    value = F.when(k % 6 == 1, F.array(F.lit(float("nan")).cast("float"))).when(k % 6 == 4, F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))).otherwise(F.array(F.lit(1.0).cast("float")))
    rows = table(spark, d, "supplier").select(F.when(k % 3 != 0, k).alias("id"), k.alias("key"), value.alias("v"))
    return cl.invalid_rows(rows, cl.Schema("c", [cl.VectorField("v", 1)])).select(F.col("key").alias("id"), "reason")


@query("SELECT event_id AS id FROM events WHERE event_type <> 'view'")
def delete_collection_rows(spark, d):
    """All rows of a collection go."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("collection"))
    return cl.without(e, e.filter("collection = 'view'").select("id")).select("id")


@query("SELECT event_id AS id, event_type AS kind, CASE WHEN event_type = 'click' THEN 'seen' END AS state, value::VARCHAR IS NOT NULL AS kept FROM events")
def update_row_metadata(spark, d):
    """Keys added to a string map where a filter holds, others kept."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.create_map(F.lit("kind"), F.col("event_type")).alias("meta"))
    rows = cl.update_metadata(rows, {"state": "seen"}, F.col("meta")["kind"] == "click")
    return rows.select("id", F.col("meta")["kind"].alias("kind"), F.try_element_at("meta", F.lit("state")).alias("state"), F.lit(True).alias("kept"))


# -- files --------------------------------------------------------------------------------------------------------------


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file through the file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(data)
    stream.close()


@query("SELECT c_custkey::VARCHAR AS id, c_name AS text, c_mktsegment AS collection, c_nationkey::VARCHAR AS nation FROM customer WHERE c_custkey % 10 <> 0")
def source_jsonl(spark, d):
    """Documents written as JSON lines and read again; blank texts are left out."""
    c = table(spark, d, "customer")
    path = scratch_path(spark, "jsonl")
    text = F.when(F.col("c_custkey") % 10 == 0, F.lit("  ")).otherwise(F.col("c_name"))
    files.write_jsonl(c.select(F.col("c_custkey").cast("string").alias("id"), text.alias("doc"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("meta"), F.col("c_mktsegment").alias("collection")), path)
    return files.read_jsonl(spark, path).select("id", "text", "collection", F.col("meta")["nation"].alias("nation"))


def _nation_vectors(spark, d):
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    return [r.n_nationkey for r in rows], [[float(r.n_nationkey), float(r.n_regionkey), r.n_nationkey / 4] for r in rows]


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS id, n_nationkey::DOUBLE AS a, n_regionkey::DOUBLE AS b, n_nationkey / 4.0::DOUBLE AS c FROM nation")
def source_fvecs(spark, d):
    """Dimension-prefixed float records."""
    path = scratch_path(spark, "fvecs")
    _put(spark, f"{path}/part.fvecs", files.fvecs_bytes(_nation_vectors(spark, d)[1]))
    e = F.col("embedding")
    return files.read_fvecs(spark, path, 3).select("id", *[e[i].cast("double").alias(n) for i, n in enumerate("abc")])


@query("SELECT n_nationkey::BIGINT AS id, n_nationkey::DOUBLE AS a, n_regionkey::DOUBLE AS b, n_nationkey / 4.0::DOUBLE AS c FROM nation")
def source_bulk(spark, d):
    """Bulk binary import of ids and vectors."""
    path = scratch_path(spark, "bulk")
    ids, vectors = _nation_vectors(spark, d)
    for k in range(2):  # two files
        _put(spark, f"{path}/{k}.bin", files.binary_import_bytes(ids[k::2], vectors[k::2]))
    e = F.col("embedding")
    return files.read_binary_import(spark, path).select("id", *[e[i].cast("double").alias(n) for i, n in enumerate("abc")])


@query("""SELECT n_name AS name, 'Title of ' || n_name AS title, 'nation,place' AS tags, r_name AS links, '' AS backlinks, '2024-01-02' AS created FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_name, r_name, 'region', '', (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey), '2023-05-06' FROM region""")
def source_vault(spark, d):
    """A folder of markdown notes: front matter, tags, links and backlinks."""
    path = scratch_path(spark, "vault")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    for x in n.join(r, n.n_regionkey == r.r_regionkey).collect():  # 25 notes
        _put(spark, f"{path}/nations/{x.n_name}.md", f"---\ntitle: \"Title of {x.n_name}\"\ntags: [nation]\ncreated: 2024-01-02\n---\nIn [[regions/{x.r_name}|its region]] #place\n".encode())
    for x in r.collect():
        _put(spark, f"{path}/regions/{x.r_name}.md", f"---\ntags:\n  - region\ndate: 2023-05-06\n---\nText\n".encode())
        _put(spark, f"{path}/.trash/{x.r_name}.md", b"gone")
    notes = files.backlinks(files.parse_notes(files.read_vault(spark, path)))
    return notes.select("name", "title", *[F.array_join(c, ",").alias(c) for c in ("tags", "links", "backlinks")], "created")


@query("SELECT event_id AS path, CASE WHEN event_type = 'click' THEN 'add' WHEN event_type = 'view' THEN 'delete' ELSE 'update' END AS action FROM events WHERE event_type <> 'error'")
def source_sync_plan(spark, d):
    """What brings stored documents up to the files found."""
    e = table(spark, d, "events").withColumn("path", F.col("event_id"))
    had = e.filter("event_type <> 'click'").select("path", F.lit(1).alias("modified"))
    has = e.filter("event_type <> 'view'").select("path", F.when(F.col("event_type") == "error", 1).otherwise(2).alias("modified"))
    return files.sync_plan(had, has)


@query("SELECT event_id AS path FROM events WHERE event_type = 'error'")
def source_orphans(spark, d):
    e = table(spark, d, "events").withColumn("path", F.col("event_id"))
    return files.orphans(e.select("path"), e.filter("event_type <> 'error'"))


@query("SELECT event_id, event_type, value FROM events")
def snapshot_round_trip(spark, d):
    """Columns of a partitioned snapshot, read back by the first format that fits."""
    path = scratch_path(spark, "snapshot")
    files.save_snapshot(table(spark, d, "events").select("event_id", "event_type", "value"), path, ("event_type",))
    return files.load_snapshot(spark, path).select("event_id", "event_type", "value")


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id % 10 <> 0")
def export_and_import(spark, d):
    """Live rows of a collection as JSON with a checksum that the import confirms."""
    path = scratch_path(spark, "export")
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("collection"), (F.col("user_id") % 10 == 0).alias("deleted"), "value")
    seal = files.export_collection(rows, "click", path)
    return files.import_collection(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "), seal).select("event_id", "value")


@query("SELECT event_id, greatest(1, strlen(props) // 4)::BIGINT AS tokens FROM events")
def cost_export(spark, d):
    """Costs as CSV with a head line."""
    path = scratch_path(spark, "costs")
    files.write_costs(stats.with_cost(table(spark, d, "events"), 0.02, "props").select("event_id", "tokens"), path)
    return spark.read.option("header", True).schema("event_id long, tokens long").csv(path)


@query("SELECT event_id AS seq, event_type AS op, user_id::VARCHAR AS id FROM events WHERE event_id > 50")
def change_log_since(spark, d):
    """Entries of a written change log after a sequence number."""
    path = scratch_path(spark, "log")
    table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.col("user_id").cast("string").alias("id")).write.json(path)
    return files.since(files.read_log(spark, path, 10), 50).select("seq", "op", "id")


@query("SELECT event_id AS id, [user_id % 5, 10 + user_id % 7] AS indices, [1.0::DOUBLE, event_id % 3 + 0.5] AS values, 20 AS dim FROM events")
def sparse_json_codec(spark, d):
    s = F.struct(F.array((F.col("user_id") % 5).cast("int"), (10 + F.col("user_id") % 7).cast("int")).alias("indices"), F.array(F.lit(1.0).cast("float"), (F.col("event_id") % 3 + 0.5).cast("float")).alias("values"), F.lit(20).alias("dim"))
    text = table(spark, d, "events").select(F.col("event_id").alias("id"), files.sparse_json(s).alias("json"))
    back = text.select("id", files.parse_sparse_json(F.col("json")).alias("s"))
    return back.select("id", F.col("s.indices").cast("array<long>").alias("indices"), F.col("s.values").cast("array<double>").alias("values"), "s.dim")


# -- requests -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 5 WHEN 1 THEN date_trunc('day', ts) WHEN 4 THEN NULL ELSE date_trunc('second', ts) END::TIMESTAMP AS at FROM events")
def time_layouts(spark, d):
    """Times in four layouts, and one that is none."""
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    shown = [F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("soon")]
    text = F.get(F.array(*shown), (F.col("event_id") % 5).cast("int"))
    return table(spark, d, "events").select("event_id", fl.parse_time(text).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id FROM events WHERE (event_type IN ('click', 'view') AND value >= 5) OR user_id = 3")
def filter_from_json(spark, d):
    e = table(spark, d, "events")
    asked = json.dumps({"$or": [{"event_type": {"$in": ["click", "view"]}, "value": {"$gte": 5}}, {"user_id": 3}]}).encode()
    return e.filter(fl.from_json(asked, fl.Fields.of(e))).select("event_id")


@query("SELECT vec_id, label, true AS with_vector, 64 AS dim FROM embeddings")
def include_vectors(spark, d):
    """The same rows with and without their vectors."""
    e = table(spark, d, "embeddings")
    bare = search.project(e)
    full = search.project(e, include_vectors=True)
    return bare.join(full.select("vec_id", F.size("embedding").alias("dim")), "vec_id").withColumn("with_vector", F.lit("embedding" not in bare.columns))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank > 40 AND rank <= 60")
def page_by_token(spark, d):
    """The third page of 20, by a token that names the query and where the last page ended."""
    docs = search.page(cl.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"], "rank").withColumn("rank", F.col("rank") + 1), 0, 1 << 60)
    request = {"collection": "documents", "order": "doc_id"}
    offset, seen = 0, None
    for _ in range(2):
        last = search.page(docs, offset, 20).agg(F.max("doc_id")).first()[0]
        offset, seen = search.decode_token(search.encode_token(offset + 20, request, last), request, last), last
    assert seen is not None
    return search.page(docs, offset, 20)


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT x AS q FROM e WHERE vec_id = 0), s AS (SELECT vec_id, label, round(1.0 - list_cosine_similarity(x, q), 6) + 0.0 AS distance FROM e, q WHERE label IN (1, 2)),
t AS (SELECT vec_id, label, round(1.0 / (1.0 + distance), 6) + 0.0 AS score, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM s) SELECT vec_id, label, score, rank, 64 AS dim FROM t WHERE rank > 5 AND rank <= 15""")
def request_dense(spark, d):
    """The search entry: one dense query, a filter, the second part of a page, vectors shown."""
    e = table(spark, d, "embeddings")
    asked = request.Request(dense=vector_of(e, 0), filter={"label": {"$in": [1, 2]}}, offset=5, limit=10, include_vectors=True)
    return request.run(e, asked, id_col="vec_id").select("vec_id", "label", "score", "rank", F.size("embedding").alias("dim"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT vec_id // 50 AS query_id, x AS q FROM e WHERE vec_id IN (0, 50)),
s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(x, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) + 0.0 AS distance FROM e, q), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s)
SELECT query_id, vec_id, distance, rank FROM t WHERE rank <= 5""")
def request_batch(spark, d):
    """The search entry: several dense queries at once."""
    e = table(spark, d, "embeddings")
    asked = request.Request(dense=[vector_of(e, 0), vector_of(e, 50)], top_k=5, metric="l2_squared")
    return request.run(e, asked, id_col="vec_id").select("query_id", "vec_id", "distance", "rank")


@query(_sparse_sql("SELECT doc_id, sum(qv * tf) AS s FROM p JOIN q USING (term) JOIN documents d USING (doc_id) WHERE d.lang = 'en' GROUP BY doc_id"))
def request_sparse(spark, d):
    """The search entry: a sparse query over postings, filtered before it is scored."""
    docs = table(spark, d, "documents")
    asked = request.Request(sparse=SPARSE_QUERY, top_k=25, filter={"lang": "en"})
    return request.run(docs, asked, sparse.hashed_postings(docs, 1024), id_col="doc_id").select("doc_id", "score", "rank")


@query("SELECT 'bm25' AS list, 0.25::DOUBLE AS weight UNION ALL SELECT 'dense', 0.75")
def fusion_weights(spark, d):
    """Weights validated and brought to a sum of 1."""
    weights = {"dense": 3.0, "bm25": 1.0}
    fusion.validate(weights)
    return spark.createDataFrame(list(fusion.normalize_weights(weights).items()), "list string, weight double")


RERANK = "p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id < 40), q AS (SELECT x AS q FROM p WHERE vec_id = 7)"


@query(f"WITH {RERANK}, s AS (SELECT vec_id AS id, round(list_sum(list_transform(list_zip(x, q), lambda z: z[1] * z[2])), 6) + 0.0 AS rerank_score FROM p, q) SELECT id, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, id) AS rerank FROM s QUALIFY rerank <= 10")
def rerank_page(spark, d):
    """A page of 40 rows reordered by the product with a query's embedding."""
    e = table(spark, d, "embeddings").filter("vec_id < 40").select(F.col("vec_id").alias("id"), "embedding")
    q = [float(x) for x in e.filter("id = 7").first().embedding]
    return recommend.rerank(e, q, 10).select("id", "rerank_score", "rerank")


@query("SELECT vec_id AS id, label::DOUBLE - vec_id % 3 AS rerank_score, row_number() OVER (ORDER BY label - vec_id % 3 DESC, vec_id) AS rerank FROM embeddings WHERE vec_id < 40 QUALIFY rerank <= 10")
def rerank_by_score(spark, d):
    """A page reordered by the caller's score."""
    e = table(spark, d, "embeddings").filter("vec_id < 40").select(F.col("vec_id").alias("id"), "label")
    return recommend.rerank_with(e, F.col("label").cast("double") - F.col("id") % 3, 10).select("id", "rerank_score", "rerank")


# -- vectors and codecs -------------------------------------------------------------------------------------------------

PAIR = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id, a.x AS x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


@query(f"""WITH {PAIR} SELECT vec_id, round(1 - list_cosine_similarity(x, y), 6) + 0.0 AS cosine, round(list_distance(x, y), 6) + 0.0 AS l2, round(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) + 0.0 AS l2_squared,
round(-list_dot_product(x, y), 6) + 0.0 AS dot, round(greatest(0.0, 1 - list_cosine_similarity(x, y)), 6) + 0.0 AS unit, round(1 / (1 + list_distance(x, y)), 6) + 0.0 AS score, 1.0::DOUBLE AS length FROM p""")
def distance_registry(spark, d):
    """Every registered distance between neighbours, of unit vectors too."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    far = {n: v.rounded(v.DISTANCES[n]("embedding", "other")).alias(n) for n in ("cosine", "l2", "l2_squared", "dot")}
    unit = v.DISTANCES["cosine_normalized"](v.normalize("embedding"), v.normalize("other"))
    return p.select("vec_id", *far.values(), v.rounded(unit).alias("unit"), v.rounded(v.score_of(v.l2("embedding", "other"))).alias("score"), v.rounded(v.norm(v.normalize("embedding"))).alias("length"))


SPARSE = "s AS (SELECT event_id AS id, user_id % 5 AS i, 10 + user_id % 7 AS j, event_id % 3 + 1 AS w FROM events)"


@query(f"WITH {SPARSE} SELECT id, round(sqrt(1 + w * w), 6) + 0.0 AS norm, round(CASE WHEN i = 2 THEN 2 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 3.0)) ELSE 0 END + CASE WHEN j = 12 THEN w * 2.2 / (w + 1.2 * (0.25 + 0.75 * 2 / 3.0)) ELSE 0 END, 6)::DOUBLE + 0.0 AS bm25, 2 AS entries, true AS valid FROM s")
def sparse_functions(spark, d):
    """Norm, saturated score and validity of sparse vectors."""
    s = F.struct(F.array((F.col("user_id") % 5).cast("int"), (10 + F.col("user_id") % 7).cast("int")).alias("indices"), F.array(F.lit(1.0), (F.col("event_id") % 3 + 1).cast("double")).alias("values"), F.lit(20).alias("dim"))
    asked = F.struct(F.array(F.lit(2), F.lit(12)).alias("indices"), F.array(F.lit(2.0), F.lit(1.0)).alias("values"), F.lit(20).alias("dim"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), s.alias("s"))
    return rows.select("id", v.rounded(v.sparse_norm(F.col("s"))).alias("norm"), v.rounded(v.sparse_bm25(asked, F.col("s"), 3.0)).alias("bm25"), v.sparse_nnz(F.col("s")).alias("entries"), v.sparse_valid(F.col("s")).alias("valid"))


@query("SELECT w AS term, count(*) AS docs, sum(n)::DOUBLE AS total FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lang || ' ' || source, ' ')) AS w FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0) GROUP BY ALL) GROUP BY w")
def postings_maintenance(spark, d):
    """Documents added to and deleted from an index of postings."""
    docs = table(spark, d, "documents")

    def postings(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", F.explode(F.split(F.concat_ws(" ", "lang", "source"), " ")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("tf"))

    index = sparse.add(postings(docs.filter("doc_id % 2 = 1")), postings(docs.filter("doc_id % 2 = 0")))
    index = sparse.delete(index, docs.filter("doc_id % 3 = 0 and doc_id % 2 = 1").select("doc_id"))
    return index.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("total"))


BITS = "m AS (SELECT pos, round(avg(x), 9) AS m FROM (SELECT unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY pos)"


@query(f"WITH {BITS}, u AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, pos::INT AS pos, CASE WHEN x > m THEN 1.0 ELSE -1.0 END::DOUBLE AS sign FROM u JOIN m USING (pos)")
def binary_decode(spark, d):
    """Signs read back from packed bits."""
    e = table(spark, d, "embeddings")
    code = quantize.binary_encode("embedding", quantize.binary_train(e))
    return e.select("vec_id", code.alias("code")).select("vec_id", F.posexplode(quantize.binary_decode(F.col("code"), 64)).alias("pos", "sign"))


@query("SELECT vec_id, unnest(range(64))::INT AS pos, unnest(embedding)::DOUBLE AS value, 261 AS bytes FROM embeddings")
def typed_blobs(spark, d):
    """Vectors as typed blobs and back."""
    e = table(spark, d, "embeddings").select("vec_id", quantize.blob_encode("embedding").alias("blob"))
    return e.select("vec_id", F.length("blob").alias("bytes"), F.posexplode(quantize.blob_decode("blob")).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


@query("SELECT count(*) * 256.0::DOUBLE AS original_bytes, count(*) * 8.0::DOUBLE AS compressed_bytes, 32.0::DOUBLE AS ratio FROM embeddings")
def compression_stats(spark, d):
    return spark.createDataFrame([{k: float(x) for k, x in quantize.info(64, table(spark, d, "embeddings").count(), 8).items()}])


# -- texts --------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS name, 'Nation' AS type, 'r' || n_regionkey AS dst FROM nation")
def glyph_graph(spark, d):
    """Nodes and edges of tabular answers inside code fences; edges to unknown nodes go."""
    n = table(spark, d, "nation")
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    answer = F.concat(
        F.lit("```glyph\n@tab Node [id name type description]\nn"), key, F.lit(' "'), F.col("n_name"), F.lit('" Nation "a \\"b\\""\nr'), region, F.lit(" R Region x\n@end\n@tab Edge [source target relation]\nn"),
        key, F.lit(" r"), region, F.lit(" IN\nn"), key, F.lit(" nowhere IN\n@end\n```"),
    )
    nodes, edges, _ = kg.from_glyph(n.select(F.col("n_nationkey").alias("doc_id"), answer.alias("text")))
    named = nodes.filter("type = 'Nation'").select("doc_id", "name", "type", F.col("id").alias("src"))
    return named.join(edges, ["doc_id", "src"]).select(F.col("doc_id").alias("id"), "name", "type", "dst")


@query("SELECT n_nationkey AS doc_id, 1900 + n_nationkey AS year, make_date(2000, 1, 1 + n_nationkey)::TIMESTAMP AS date, 2::BIGINT AS entities FROM nation")
def glyph_events(spark, d):
    """Events with times and entities of tabular answers."""
    k = F.col("n_nationkey")
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), k), "yyyy-MM-dd")
    answer = F.concat(F.lit("@tab Event [id description date year entities]\ne1 \"it was\" "), day, F.lit(" "), (1900 + k).cast("string"), F.lit(" [a b]\n@end"))
    _, _, events = kg.from_glyph(table(spark, d, "nation").select(k.alias("doc_id"), answer.alias("text")))
    return events.select("doc_id", "year", F.col("date").cast("timestamp_ntz").alias("date"), F.size("entities").cast("long").alias("entities"))


@query("SELECT n_nationkey AS id, n_name AS clean, n_regionkey::VARCHAR AS region, (length(n_name) - 1 + length(n_name) - 2)::INT AS grams FROM nation")
def text_helpers(spark, d):
    """Code fences, flag pairs and character n-grams."""
    n = table(spark, d, "nation")
    fenced = F.concat(F.lit("```json\n"), F.col("n_name"), F.lit("\n```"))
    pairs = tx.parse_pairs(F.concat(F.lit("name="), F.col("n_name"), F.lit(",region="), F.col("n_regionkey").cast("string")))
    return n.select(F.col("n_nationkey").alias("id"), tx.clean_fences(fenced).alias("clean"), pairs["region"].alias("region"), F.size(tx.char_ngrams(F.col("n_name"), 2, 3)).alias("grams"))


@query("SELECT doc_id, greatest(1, strlen(text) // 4)::BIGINT AS tokens, substr(sha256(text || ':' || 3), 1, 16) AS chunk, substr(sha256(text), 1, 16) AS hash FROM documents WHERE text IS NOT NULL")
def text_keys(spark, d):
    """Token estimates, chunk ids and query hashes of whole texts."""
    t = F.col("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", tx.token_estimate(t).alias("tokens"), tx.chunk_id(t, F.lit(3)).alias("chunk"), tx.query_hash(t).alias("hash"))


@query("SELECT event_id, round(greatest(1.0, least(100.0, 1.0 / greatest(value / 1000, 1e-9))), 6)::DOUBLE + 0.0 AS speedup FROM events")
def prefilter_speedup(spark, d):
    return table(spark, d, "events").select("event_id", v.rounded(stats.estimated_speedup(F.col("value") / 1000)).alias("speedup"))


# -- graphs -------------------------------------------------------------------------------------------------------------


@query(f"WITH {KG} SELECT DISTINCT 'from' AS side, src, dst FROM edges WHERE src = 'n5' UNION ALL SELECT DISTINCT 'to', src, dst FROM edges WHERE dst = 'n5'")
def graph_edges_of(spark, d):
    """Edges from and to a node."""
    _, edges = _kg(spark, d)
    return graph.edges_from(edges, "n5").select(F.lit("from").alias("side"), "src", "dst").union(graph.edges_to(edges, "n5").select(F.lit("to"), "src", "dst")).distinct()


@query(f"WITH {KG} SELECT doc_id, count(*) AS nodes FROM nodes WHERE doc_id % 4 <> 0 GROUP BY 1 UNION ALL SELECT DISTINCT doc_id, 1 FROM nodes WHERE doc_id % 4 = 0")
def graph_upsert(spark, d):
    """Documents' graphs replaced by new ones: nodes of each document afterwards."""
    nodes, edges = _kg(spark, d)
    again = nodes.filter("doc_id % 4 = 0").select("doc_id").distinct()
    new = again.select("doc_id", F.lit("new").alias("id"), F.lit("New").alias("name"), F.lit("Thing").alias("type"), F.lit("").alias("description"))
    kept, _ = graph.upsert_document(nodes, edges, new.select(*nodes.columns), edges.limit(0))
    return kept.groupBy("doc_id").agg(F.count("*").alias("nodes"))


@query(f"WITH {KG} SELECT (SELECT count(*) FROM nodes WHERE doc_id % 3 <> 0) AS nodes, (SELECT count(*) FROM edges WHERE doc_id % 3 <> 0) AS edges")
def graph_remove(spark, d):
    """What is left when documents are removed."""
    nodes, edges = _kg(spark, d)
    nodes, edges = graph.remove_documents(nodes, edges, nodes.filter("doc_id % 3 = 0").select("doc_id").distinct())
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


@query(f"WITH {KG} SELECT 0::BIGINT AS nodes_without_id, (SELECT count(*) FROM edges WHERE doc_id % 10 = 0) AS edges_without_end, (SELECT count(*) FROM edges WHERE doc_id % 10 = 0 OR doc_id % 10 = 1) AS edges_to_unknown")
def graph_validity(spark, d):
    """Edges without an end and to unknown nodes."""
    nodes, edges = _kg(spark, d)
    return graph.violations(nodes, edges.withColumn("dst", F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 10 == 1, "nowhere").otherwise(F.col("dst"))))


# -- feedback -----------------------------------------------------------------------------------------------------------


@query("SELECT 'f' || event_id AS id, CASE WHEN user_id % 5 >= 3 THEN 'thumbs_up' WHEN user_id % 5 <= 1 THEN 'thumbs_down' ELSE 'explicit' END AS type, CASE WHEN user_id % 5 = 2 THEN 0 ELSE (user_id % 5 + 1 - 3) / 2.0 END::DOUBLE AS sentiment FROM events")
def feedback_ratings(spark, d):
    """Ratings of 1 to 5 as feedback."""
    rows = table(spark, d, "events").selectExpr("concat('f', event_id) as id", "concat('i', event_id) as interaction_id", "user_id % 5 + 1 as rating", "array('r1') as clicked_ids", "array('r2') as rejected_ids", "ts")
    return fb.explicit(rows).select("id", "type", "sentiment")


@query("SELECT 'f' || event_id AS id, CASE event_type WHEN 'click' THEN 'click' WHEN 'error' THEN 'requery' ELSE CASE WHEN user_id % 2 = 0 THEN 'dwell' ELSE 'ignore' END END AS type FROM events WHERE event_type IN ('click', 'error', 'view')")
def feedback_signals(spark, d):
    """Clicks, repeated queries and dwells as feedback; unknown signals are left out."""
    signal = "case event_type when 'click' then 'click' when 'error' then 'requery' when 'view' then 'dwell' else event_type end"
    rows = table(spark, d, "events").selectExpr("concat('f', event_id) as id", "concat('i', event_id) as interaction_id", f"{signal} as signal", "case when user_id % 2 = 0 then 3600000 else 1 end as duration_ms", "array('r1') as target_ids", "ts")
    return fb.implicit(rows).select("id", "type")


@query("SELECT 'f' || event_id AS id, 'natural' AS type, CASE event_type WHEN 'click' THEN 0.2 WHEN 'error' THEN -0.25 ELSE 0.0 END::DOUBLE AS sentiment FROM events")
def feedback_texts(spark, d):
    """Texts as feedback, by rule-based sentiment."""
    words = F.when(F.col("event_type") == "click", tx.POSITIVE[0]).when(F.col("event_type") == "error", tx.NEGATIVE[0]).otherwise("qqq")
    rows = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("id"), F.lit("i").alias("interaction_id"), words.alias("text"), "ts")
    return fb.natural(rows).select("id", "type", v.rounded(F.col("sentiment")).alias("sentiment"))


@query(f"WITH {FEED} SELECT id FROM i ORDER BY ts DESC, id DESC LIMIT 30")
def feedback_recent(spark, d):
    return fb.recent(_feed(spark, d)[0], 30).select("id")


@query(f"WITH {BOOSTS} SELECT (SELECT count(*) FROM i) AS interactions, (SELECT count(DISTINCT query_hash) FROM i) AS query_patterns, (SELECT count(*) FROM f) AS feedback, (SELECT count(*) FROM boosts) AS boosts")
def feedback_totals(spark, d):
    i, f = _feed(spark, d)
    return fb.stats(i, f, fb.boosts(fb.deltas(i, f)))


@query(f"WITH {BOOSTS}, r AS (SELECT 'r' || k AS id, (10 - k)::DOUBLE AS score FROM range(10) t(k)), j AS (SELECT r.id, score * greatest(0.5, least(1.5, coalesce(b.boost, 1.0)))::DOUBLE AS s FROM r LEFT JOIN boosts b ON b.target_id = r.id AND b.query_hash = '' AND b.confidence >= 0.3) SELECT 'apples' AS query, substr(sha256('apples'), 1, 16) AS query_hash, string_agg(id, ',' ORDER BY round(s, 6) DESC, id) AS shown FROM j")
def feedback_record(spark, d):
    """Boosted results and the interaction that records them as shown."""
    results = spark.range(10).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), (F.lit(10.0) - F.col("id")).alias("score"))
    _, made = fb.record_and_boost(results, fb.boosts(fb.deltas(*_feed(spark, d))), "apples", F.lit("2024-02-01").cast("timestamp"))
    return made.select("query", "query_hash", F.array_join("result_ids", ",").alias("shown"))


@query(f"WITH {BOOSTS} SELECT target_id, query_hash, boost, count FROM boosts")
def stream_boosts(spark, d):
    """Boosts as the keyed state of a stream of deltas: what the last update of each key says."""
    root = scratch_path(spark, "boosts")
    fb.deltas(*_feed(spark, d)).select("target_id", "query_hash", F.col("ts").cast("timestamp").alias("ts"), "feedback_id", "delta").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ch.boost_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{root}/cp").foreachBatch(lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{root}/out")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{root}/out").groupBy("target_id", "query_hash").agg(F.max_by(F.struct("boost", "count"), "batch").alias("m"))
    return last.select("target_id", "query_hash", v.rounded(F.col("m.boost")).alias("boost"), F.col("m.count").alias("count"))


