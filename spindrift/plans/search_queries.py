"""Registered queries on search, filters, text, fusion and recommendation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters as fl
from ..functions import text as tx
from ..functions import vectors as v
from ..operators import fusion, recommend, search, sparse
from ..session import scratch_path, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def vector_of(df: DataFrame, vec_id: int) -> list[float]:
    return [float(x) for x in df.filter(F.col("vec_id") == vec_id).first().embedding]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


Q0 = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
DIST = {
    "cosine": "1.0 - list_cosine_similarity(x, q)",
    "l2": "list_distance(x, q)",
    "dot": "-list_inner_product(x, q)",
    "l2_squared": "list_sum(list_transform(list_zip(x, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
}


def _knn_sql(metric: str, k: int = 10, where: str = "TRUE") -> str:
    score = "-distance" if metric == "dot" else "1.0 / (1.0 + distance)"
    return f"""WITH {Q0}, d AS (SELECT vec_id, round({DIST[metric]}, 6) + 0.0 AS distance FROM e, q WHERE {where}),
    t AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM d)
    SELECT vec_id, distance, round({score}, 6) + 0.0 AS score, rank FROM t WHERE rank <= {k}"""


def _knn(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = _embeddings(spark, d)
        return search.knn(e, vector_of(e, 0), 10, metric, id_col="vec_id")

    return run


for _m in ("cosine", "l2", "dot", "l2_squared"):
    query(_knn_sql(_m), f"knn_{_m}")(_knn(_m))


@query(_knn_sql("cosine", 10, "label = 4"))
def knn_matmul(spark, d):
    e = _embeddings(spark, d)
    return search.knn(e, vector_of(e, 0), 10, "cosine", where=F.col("label") == 4, id_col="vec_id", strategy="matmul")


@query(_knn_sql("cosine", 10, "label IN (1, 2, 3)"))
def knn_filtered(spark, d):
    e = _embeddings(spark, d)
    return search.knn(e, vector_of(e, 0), 10, "cosine", where=fl.compile_filter({"label": {"$in": [1, 2, 3]}}, fl.Fields.of(e)), id_col="vec_id")


BATCH = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id, round(1.0 - list_cosine_similarity(a.x, b.x), 6) + 0.0 AS distance FROM e a, e b WHERE a.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, vec_id, distance, rank FROM t WHERE rank <= 10"""


@query(BATCH)
def knn_batch(spark, d):
    e = _embeddings(spark, d)
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.knn_batch(asked, e, 10, id_col="vec_id")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(a.x, b.x), 6) + 0.0 AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, vec_id, distance, rank FROM t WHERE rank <= 3""")
def knn_graph(spark, d):
    return search.knn_graph(_embeddings(spark, d), 3, "l2", id_col="vec_id")


@query(f"""WITH {Q0}, d AS (SELECT vec_id, label, vec_id AS seq, round(list_inner_product(x, q), 6) + 0.0 AS score FROM e, q),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS r FROM d) SELECT vec_id, label, seq, score FROM t WHERE r <= 20 AND label < 5""")
def v1_query_post_filter(spark, d):
    e = _embeddings(spark, d)
    return search.vector_query(e.withColumn("seq", F.col("vec_id")), vector_of(e, 0), 20, F.col("label") < 5, "post")


@query(f"""WITH {Q0}, d AS (SELECT vec_id, label, vec_id AS seq, round(list_inner_product(x, q), 6) + 0.0 AS score FROM e, q WHERE label < 5),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS r FROM d) SELECT vec_id, label, seq, score FROM t WHERE r <= 20""")
def v1_query_pre_filter(spark, d):
    e = _embeddings(spark, d)
    return search.vector_query(e.withColumn("seq", F.col("vec_id")), vector_of(e, 0), 20, F.col("label") < 5, "pre")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
q AS (SELECT list_transform(range(64), lambda i: CASE i WHEN 1 THEN 1.0 WHEN 5 THEN 0.5 WHEN 60 THEN -0.25 ELSE 0.0 END::DOUBLE) AS q),
d AS (SELECT vec_id, round(1.0 - list_cosine_similarity(x, q), 6) + 0.0 AS distance FROM e, q), t AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM d)
SELECT vec_id, distance, round(1.0 / (1.0 + distance), 6) + 0.0 AS score, rank FROM t WHERE rank <= 10""")
def v1_query_sparse(spark, d):
    return search.sparse_query(_embeddings(spark, d), [1, 5, 60], [1.0, 0.5, -0.25], 64, 10, id_col="vec_id")


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'view' ORDER BY event_id LIMIT 50 OFFSET 100")
def scroll_page(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return search.scroll(e, 50, 100, F.col("event_type") == "view", "event_id")[0]


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 5, 7, -1)")
def multi_get(spark, d):
    return search.multi_get(_embeddings(spark, d).select("vec_id", "label"), [3, 5, 7, -1], "vec_id")


@query(f"""WITH {Q0}, d AS (SELECT vec_id, label, round(1.0 - list_cosine_similarity(x, q), 6) + 0.0 AS distance FROM e, q),
t AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM d) SELECT vec_id, label, distance, rank FROM t WHERE rank > 5 AND rank <= 15""")
def page_of_results(spark, d):
    e = _embeddings(spark, d)
    found = search.knn(e, vector_of(e, 0), 15, id_col="vec_id").drop("score")
    return search.hydrate(search.page(found, 5, 10), e.select("vec_id", "label"), "vec_id")


# -- filters ------------------------------------------------------------------------------------------------------------

LAT, LON = "((event_id * 7) % 180 - 90)", "((event_id * 13) % 360 - 180)"


def with_metadata(events: DataFrame) -> DataFrame:
    """event_id with a variant of nested metadata; `extra` is there for every third user only, and null for user 0."""
    one = """parse_json(concat('{"type":"', event_type, '","user":', user_id, ',"amount":"', cast(value as string), '","spec":{"k":', get_json_object(props, '$.k'),
      ',"brand":"b', user_id % 4, '"},"tags":["', event_type, '","', user_id % 5, '"],"flag":', if(user_id % 2 = 0, 'true', 'false'),
      if(user_id % 3 = 0, concat(',"extra":', if(user_id = 0, 'null', cast(user_id as string))), ''),
      ',"loc":[', cast(((event_id * 7) % 180 - 90) as string), ',', cast(((event_id * 13) % 360 - 180) as string), ']}'))"""
    # the one-element explode stands for a stored column: filters on it are not copied into the parser
    return events.select("event_id", F.expr(f"explode(array({one}))").alias("m"))


FILTERS: dict[str, tuple[dict, str]] = {
    "eq": ({"type": "click"}, "event_type = 'click'"),
    "eq_number_as_text": ({"user": "46"}, "user_id = 46"),
    "ne": ({"type": {"$ne": "click"}}, "event_type <> 'click'"),
    "ne_missing": ({"extra": {"$ne": 9}}, "NOT (user_id % 3 = 0 AND user_id = 9)"),
    "gt": ({"spec.k": {"$gt": 50}}, "CAST(props->>'$.k' AS INT) > 50"),
    "gte": ({"spec.k": {"$gte": 50}}, "CAST(props->>'$.k' AS INT) >= 50"),
    "lt": ({"amount": {"$lt": 5.5}}, "value < 5.5"),
    "lte": ({"amount": {"$lte": "5.5"}}, "value <= 5.5"),
    "gt_text": ({"type": {"$gt": "purchase"}}, "event_type > 'purchase'"),
    "range": ({"spec.k": {"$gte": 10, "$lte": 20}}, "CAST(props->>'$.k' AS INT) BETWEEN 10 AND 20"),
    "in": ({"type": {"$in": ["view", "error", 3]}}, "event_type IN ('view', 'error')"),
    "nin": ({"type": {"$nin": ["view", "error"]}}, "event_type NOT IN ('view', 'error')"),
    "contains_text": ({"type": {"$contains": "ch"}}, "contains(event_type, 'ch')"),
    "contains_element": ({"tags": {"$contains": "3"}}, "user_id % 5 = 3"),
    "startswith": ({"type": {"$startswith": "si"}}, "starts_with(event_type, 'si')"),
    "endswith": ({"type": {"$endswith": "w"}}, "ends_with(event_type, 'w')"),
    "regex": ({"type": {"$regex": "^(view|click)$"}}, "regexp_matches(event_type, '^(view|click)$')"),
    "exists": ({"extra": {"$exists": True}}, "user_id % 3 = 0"),
    "not_exists": ({"extra": {"$exists": False}}, "user_id % 3 <> 0"),
    "null": ({"extra": None}, "user_id = 0"),
    "boolean": ({"flag": True}, "user_id % 2 = 0"),
    "nested": ({"spec.brand": "b2"}, "user_id % 4 = 2"),
    "and": ({"$and": [{"type": "click"}, {"spec.k": {"$lt": 30}}]}, "event_type = 'click' AND CAST(props->>'$.k' AS INT) < 30"),
    "or": ({"$or": [{"type": "click"}, {"spec.k": {"$lt": 3}}]}, "event_type = 'click' OR CAST(props->>'$.k' AS INT) < 3"),
    "or_empty": ({"$or": []}, "FALSE"),
    "and_empty": ({"$and": []}, "TRUE"),
    "not": ({"$not": {"extra": 9}}, "NOT (user_id % 3 = 0 AND user_id = 9)"),
    "implicit_and": ({"type": "view", "flag": False}, "event_type = 'view' AND user_id % 2 = 1"),
    "geo_radius": ({"loc": {"$geo_radius": {"center": [40.0, -70.0], "radius_km": 2000}}}, f"2 * 6371.0 * atan2(sqrt(pow(sin(radians(40.0 - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians(40.0)) * pow(sin(radians(-70.0 - {LON}) / 2), 2)), sqrt(1.0 - (pow(sin(radians(40.0 - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians(40.0)) * pow(sin(radians(-70.0 - {LON}) / 2), 2)))) <= 2000"),
    "geo_bbox": ({"loc": {"$geo_bbox": {"top_left": {"lat": 50, "lon": -20}, "bottom_right": {"lat": 10, "lon": 45}}}}, f"{LAT} BETWEEN 10 AND 50 AND {LON} BETWEEN -20 AND 45"),
}


def _filter(document: dict):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = with_metadata(spread(table(spark, d, "events")))
        return rows.filter(fl.compile_filter(document, fl.Fields(variant="m"))).select("event_id")

    return run


for _n, (_doc, _where) in FILTERS.items():
    query(f"SELECT event_id FROM events WHERE {_where}", f"filter_{_n}")(_filter(_doc))


def with_map(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string"), F.lit("amount"), F.col("value").cast("string"), F.lit("at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("meta"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7")
def v1_meta(spark, d):
    return with_map(table(spark, d, "events")).filter(fl.meta_all(F.col("meta"), {"type": "click", "user": "7"})).select("event_id")


@query("SELECT event_id FROM events WHERE ((event_type = 'click' AND user_id = 7) OR user_id = 8) AND NOT (event_type = 'view' AND user_id = 8)")
def v1_meta_any_not(spark, d):
    rows, m = with_map(table(spark, d, "events")), F.col("meta")
    return rows.filter(fl.meta_any(m, [{"type": "click", "user": "7"}, {"user": "8"}]) & fl.meta_not(m, {"type": "view", "user": "8"})).select("event_id")


@query("SELECT event_id FROM events WHERE value BETWEEN 2.5 AND 9 AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-05 12:00:00'")
def v1_meta_ranges(spark, d):
    ranges = [{"key": "amount", "min": 2.5, "max": 9}, {"key": "at", "time_min": "2024-01-03T00:00:00Z", "time_max": "2024-01-05T12:00:00Z"}]
    return with_map(table(spark, d, "events")).filter(fl.meta_ranges(F.col("meta"), ranges)).select("event_id")


# -- text and lexical search --------------------------------------------------------------------------------------------

STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + ")"
TOKENS = f"tok AS (SELECT doc_id, unnest(string_split(lower(regexp_replace(coalesce(text, ''), '[\\p{{P}}\\p{{S}}\\s]+', ' ', 'g')), ' ')) AS term FROM documents), toks AS (SELECT * FROM tok WHERE term <> '' AND term NOT IN {STOP})"


@query(f"WITH {TOKENS} SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM toks GROUP BY term")
def tokenize(spark, d):
    return search.postings(_documents(spark, d)).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))


WORDS = "onthe thtion edshhe than"
BM25 = f"""{TOKENS}, lens AS (SELECT d.doc_id, count(t.term) AS len FROM documents d LEFT JOIN toks t ON t.doc_id = d.doc_id GROUP BY d.doc_id),
stats AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term IN ('onthe', 'thtion', 'edshhe', 'than') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT tf.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS s FROM tf JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY tf.doc_id)"""


@query(f"WITH {BM25} SELECT doc_id, round(s, 6) + 0.0 AS score FROM raw")
def bm25_text(spark, d):
    found = search.bm25_scores(_documents(spark, d), WORDS)
    return found.select("doc_id", v.rounded(F.col("score")).alias("score"))


LEX = f"""{BM25}, lex AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT d.doc_id, round(coalesce(s, 0.0), 6) + 0.0 AS score FROM documents d LEFT JOIN raw USING (doc_id)))"""


@query(f"WITH {LEX} SELECT doc_id, score, rank FROM lex WHERE rank <= 20")
def lexical_topk(spark, d):
    return search.lexical(_documents(spark, d), WORDS, 20)


@query(f"""WITH {BM25}, {Q0}, h AS (SELECT vec_id AS doc_id, round(0.5 * list_inner_product(x, q) + 0.5 * coalesce(s, 0.0), 6) + 0.0 AS score FROM e CROSS JOIN q LEFT JOIN raw ON raw.doc_id = e.vec_id),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h) SELECT doc_id, score, rank FROM t WHERE rank <= 15""")
def hybrid_alpha(spark, d):
    e = _embeddings(spark, d)
    return search.hybrid_alpha(e.withColumnRenamed("vec_id", "doc_id"), _documents(spark, d), vector_of(e, 0), WORDS, 15)


SENTIMENT = " + ".join([f"(CASE WHEN contains(t, '{w}') THEN 4 ELSE 0 END)" for w in tx.POSITIVE] + [f"(CASE WHEN contains(t, '{w.replace(chr(39), chr(39) * 2)}') THEN -5 ELSE 0 END)" for w in tx.NEGATIVE])


@query(f"SELECT conv_id, turn, greatest(-1.0, least(1.0, ({SENTIMENT}) / 20.0))::DOUBLE AS sentiment FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)")
def sentiment(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.sentiment(F.col("text")).alias("sentiment"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS query_hash, substr(sha256(text || ':3'), 1, 16) AS chunk_id, greatest(1, strlen(text) // 4)::BIGINT AS tokens FROM documents")
def text_hashes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.query_hash(t).alias("query_hash"), tx.chunk_id(t, F.lit(3)).alias("chunk_id"), tx.token_estimate(t).alias("tokens"))


@query()
def chunk_documents(spark, d):
    return tx.chunk(_documents(spark, d))


@query()
def chunk_for_embedding(spark, d):
    return tx.chunk_for_embedding(_documents(spark, d))


HASHED = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents),
words AS (SELECT doc_id, word, count(*) AS n FROM w WHERE strlen(word) > 2 AND word NOT IN {STOP} GROUP BY ALL),
codes AS (SELECT word, list_reduce(list_transform(string_split(word, ''), lambda c: unicode(c)::BIGINT), lambda h, c: ((h * 33 + c) & 4294967295), 5381::BIGINT) % 1024 AS term FROM (SELECT DISTINCT word FROM words)),
p AS (SELECT doc_id, term, sum(n)::DOUBLE AS tf FROM words JOIN codes USING (word) GROUP BY ALL)"""


@query(f"WITH {HASHED} SELECT doc_id, term::INT AS term, tf FROM p")
def hashed_postings(spark, d):
    return sparse.hashed_postings(_documents(spark, d), 1024)


SPARSE_QUERY = {3: 1.0, 77: 2.0, 500: 0.5}
SQ = "q AS (SELECT * FROM (VALUES (3, 1.0::DOUBLE), (77, 2.0), (500, 0.5)) AS q(term, qv))"


def _sparse_sql(body: str) -> str:
    return f"WITH {HASHED}, {SQ}, s AS ({body}), t AS (SELECT doc_id, round(s, 6) + 0.0 AS score FROM s), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM t) SELECT doc_id, score, rank FROM r WHERE rank <= 25"


def _posted(spark, d) -> DataFrame:
    """The postings as a stored index holds them; each query builds its own, so that none is timed on another's."""
    return sparse.store(sparse.hashed_postings(_documents(spark, d), 1024), scratch_path(spark, "postings"))


@query(_sparse_sql("SELECT doc_id, sum(qv * tf) AS s FROM p JOIN q USING (term) GROUP BY doc_id"))
def sparse_dot(spark, d):
    return sparse.search_dot(_posted(spark, d), SPARSE_QUERY, 25)


@query(_sparse_sql("SELECT a.doc_id, a.s / (sqrt(1.0 + 4.0 + 0.25) * b.norm) AS s FROM (SELECT doc_id, sum(qv * tf) AS s FROM p JOIN q USING (term) GROUP BY doc_id) a JOIN (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM p GROUP BY doc_id) b USING (doc_id)"))
def sparse_cosine(spark, d):
    return sparse.search_cosine(_posted(spark, d), SPARSE_QUERY, 25)


@query(_sparse_sql("SELECT a.doc_id, a.n / (b.n + 3 - a.n) AS s FROM (SELECT doc_id, count(*) AS n FROM p JOIN q USING (term) GROUP BY doc_id) a JOIN (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id) b USING (doc_id)"))
def sparse_jaccard(spark, d):
    return sparse.search_jaccard(_posted(spark, d), SPARSE_QUERY, 25)


@query(_sparse_sql("SELECT p.doc_id, sum(qv * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS s FROM p JOIN q USING (term) JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) USING (term) JOIN (SELECT doc_id, sum(tf) AS len FROM p GROUP BY doc_id) l ON l.doc_id = p.doc_id, (SELECT count(*) AS n, avg(len) AS avgdl FROM (SELECT doc_id, sum(tf) AS len FROM p GROUP BY doc_id)) GROUP BY p.doc_id"))
def sparse_bm25(spark, d):
    return sparse.search_bm25(_posted(spark, d), SPARSE_QUERY, 25)


@query(f"WITH {HASHED}, l AS (SELECT doc_id, sum(tf) AS len, count(*) AS n FROM p GROUP BY doc_id) SELECT count(*) AS documents, sum(n)::BIGINT AS postings, round(avg(len), 6) + 0.0 AS avgdl, (SELECT count(DISTINCT term) FROM p) AS terms FROM l")
def sparse_stats(spark, d):
    return sparse.corpus_stats(_posted(spark, d))


# -- vector functions ---------------------------------------------------------------------------------------------------

PAIRS = "p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, d) -> DataFrame:
    e = _embeddings(spark, d)
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query(f"""WITH {PAIRS} SELECT vec_id, round(list_inner_product(a, b), 6) + 0.0 AS dot, round(list_distance(a, b), 6) + 0.0 AS l2, round(1 - list_cosine_similarity(a, b), 6) + 0.0 AS cosine,
round(greatest(0.0, 1 - list_inner_product(a, b)), 6) + 0.0 AS normalized, round(sqrt(list_inner_product(a, a)), 6) + 0.0 AS norm FROM p""")
def vector_distances(spark, d):
    a, b = "a", "b"
    found = {"dot": v.dot(a, b), "l2": v.l2(a, b), "cosine": v.cosine_distance(a, b), "normalized": v.normalized_cosine_distance(a, b), "norm": v.norm(a)}
    return _pairs(spark, d).select("vec_id", *[v.rounded(c).alias(n) for n, c in found.items()])


CUT = "s AS (SELECT vec_id, list_transform(a, lambda x: CASE WHEN abs(x) > 0.1 THEN x ELSE 0.0 END) AS a, list_transform(b, lambda x: CASE WHEN abs(x) > 0.1 THEN x ELSE 0.0 END) AS b FROM p)"


@query(f"""WITH {PAIRS}, {CUT}, n AS (SELECT *, len(list_filter(a, lambda x: x <> 0)) AS na, len(list_filter(list_zip(a, b), lambda z: z[1] <> 0 AND z[2] <> 0)) AS nb, len(list_filter(list_zip(a, b), lambda z: z[1] <> 0 OR z[2] <> 0)) AS nu FROM s)
SELECT vec_id, na::BIGINT AS nnz, round(list_inner_product(a, b), 6) + 0.0 AS dot, round(list_cosine_similarity(a, b), 6) + 0.0 AS cosine, round(list_distance(a, b), 5) + 0.0 AS l2, round(nb / nu, 6) + 0.0 AS jaccard, round(1 - na / 64, 6) + 0.0 AS sparsity FROM n""")
def sparse_functions(spark, d):
    p = _pairs(spark, d).select("vec_id", v.sparse_from_dense("a", 0.1).alias("a"), v.sparse_from_dense("b", 0.1).alias("b"))
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", v.sparse_nnz(a).cast("long").alias("nnz"), v.rounded(v.sparse_dot(a, b)).alias("dot"), v.rounded(v.sparse_cosine(a, b)).alias("cosine"), v.rounded(v.sparse_l2(a, b), 5).alias("l2"), v.rounded(v.sparse_jaccard(a, b)).alias("jaccard"), v.rounded(v.sparsity(a)).alias("sparsity"))


@query(f"""WITH {PAIRS}, {CUT} SELECT vec_id, unnest(range(64))::INT AS pos, unnest(list_transform(list_zip(a, b), lambda z: round(z[1] + z[2], 6) + 0.0)) AS value FROM s""")
def sparse_sum(spark, d):
    p = _pairs(spark, d).select("vec_id", v.sparse_add(v.sparse_from_dense("a", 0.1), v.sparse_from_dense("b", 0.1)).alias("s"))
    return p.select("vec_id", F.posexplode(v.sparse_to_dense(F.col("s"))).alias("pos", "x")).select("vec_id", "pos", v.rounded(F.col("x")).alias("value"))


# -- fusion -------------------------------------------------------------------------------------------------------------

LISTS = f"""{LEX}, {Q0}, dd AS (SELECT vec_id AS doc_id, round(1.0 - list_cosine_similarity(x, q), 6) + 0.0 AS distance FROM e, q),
dense AS (SELECT doc_id, round(1.0 / (1.0 + distance), 6) + 0.0 AS score, row_number() OVER (ORDER BY distance, doc_id) AS rank FROM dd),
lists AS (SELECT 'dense' AS list, doc_id, rank, score FROM dense WHERE rank <= 40 UNION ALL SELECT 'sparse', doc_id, rank, score FROM lex WHERE rank <= 40)"""


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    e = _embeddings(spark, d)
    dense = search.knn(e, vector_of(e, 0), 40, id_col="vec_id").withColumnRenamed("vec_id", "doc_id")
    return dense, search.lexical(_documents(spark, d), WORDS, 40)


def _fused_sql(body: str, more: str = "") -> str:
    return f"WITH {LISTS}{more}, f AS (SELECT doc_id, round(s, 9) + 0.0 AS score FROM ({body})), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f) SELECT doc_id, score, rank FROM r WHERE rank <= 20"


@query(_fused_sql("SELECT doc_id, sum(1.0 / (60.0 + rank - 1)) AS s FROM lists GROUP BY doc_id"))
def fuse_rrf(spark, d):
    return fusion.hybrid(*_lists(spark, d), 20)


@query(_fused_sql("SELECT doc_id, sum(w * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END) AS s FROM (SELECT *, CASE list WHEN 'dense' THEN 0.7 ELSE 0.3 END::DOUBLE AS w, first_value(score) OVER (PARTITION BY list ORDER BY rank) AS hi, last_value(score) OVER (PARTITION BY list ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lo FROM lists) GROUP BY doc_id"))
def fuse_weighted(spark, d):
    return fusion.hybrid(*_lists(spark, d), 20, "weighted")


@query(_fused_sql("SELECT doc_id, sum(CASE list WHEN 'dense' THEN 0.7 ELSE 0.3 END::DOUBLE * score) AS s FROM lists GROUP BY doc_id"))
def fuse_linear(spark, d):
    return fusion.hybrid(*_lists(spark, d), 20, "linear")


@query(_fused_sql("SELECT doc_id, sum(1.0 / (60.0 + rank - 1)) AS s FROM lists GROUP BY doc_id HAVING bool_or(list = 'dense')"))
def fuse_graph_boost(spark, d):
    return fusion.graph_boost(*_lists(spark, d), 20)


# -- recommend, discover, rerank ----------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(x) AS v FROM e WHERE vec_id IN (1, 2, 3, 10, 11)),
m AS (SELECT pos, avg(CASE WHEN vec_id IN (1, 2, 3) THEN v END) - 0.5 * avg(CASE WHEN vec_id IN (10, 11) THEN v END) AS v FROM u GROUP BY pos),
q AS (SELECT list(v ORDER BY pos) AS q FROM m),
d AS (SELECT vec_id, round(1.0 - list_cosine_similarity(x, q), 6) + 0.0 AS distance FROM e, q), t AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM d)
SELECT vec_id, distance, round(1.0 / (1.0 + distance), 6) + 0.0 AS score, rank FROM t WHERE rank <= 12 AND vec_id NOT IN (1, 2, 3, 10, 11)""")
def recommend_similar(spark, d):
    return recommend.recommend(_embeddings(spark, d), [1, 2, 3], [10, 11], 12, id_col="vec_id")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), t AS (SELECT x AS t FROM e WHERE vec_id = 5),
near AS (SELECT vec_id, x, t FROM (SELECT *, row_number() OVER (ORDER BY round(1.0 - list_cosine_similarity(x, t), 6) + 0.0, vec_id) AS r FROM e, t) WHERE r <= 32),
s AS (SELECT vec_id, round(list_cosine_similarity(x, t) * product(1.0 / (1.0 + exp(-(list_cosine_similarity(x, p.x) - list_cosine_similarity(x, n.x))))), 6) + 0.0 AS score
  FROM (SELECT n.vec_id, n.x, n.t, unnest([1, 2]) AS a, unnest([10, 11]) AS b FROM near n) c JOIN (SELECT vec_id AS pv, x FROM e) p ON p.pv = c.a JOIN (SELECT vec_id AS nv, x FROM e) n ON n.nv = c.b GROUP BY vec_id, c.x, t),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s) SELECT vec_id, score, rank FROM r WHERE rank <= 8""".replace("list_cosine_similarity(x, t) * product", "list_cosine_similarity(c.x, t) * product").replace("list_cosine_similarity(x, p.x)", "list_cosine_similarity(c.x, p.x)").replace("list_cosine_similarity(x, n.x)", "list_cosine_similarity(c.x, n.x)"))
def discover(spark, d):
    return recommend.discover(_embeddings(spark, d), [(1, 10), (2, 11)], 5, 8, id_col="vec_id")


@query("""WITH u AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT pos::INT AS pos, round(sum((1 + vec_id % 3) * v) / sum(1 + vec_id % 3), 6) + 0.0 AS value FROM u GROUP BY pos""")
def weighted_mean_vector(spark, d):
    mean = recommend.mean_vector(_embeddings(spark, d), weight=F.lit(1) + F.col("vec_id") % 3)
    return mean.select(F.posexplode("mean").alias("pos", "x")).select("pos", v.rounded(F.col("x")).alias("value"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT x AS q FROM e WHERE vec_id = 0), z AS (SELECT x AS z FROM e WHERE vec_id = 9),
near AS (SELECT vec_id, x, rank FROM (SELECT *, row_number() OVER (ORDER BY round(1.0 - list_cosine_similarity(x, q), 6) + 0.0, vec_id) AS rank FROM e, q) WHERE rank <= 20),
s AS (SELECT vec_id, rank, round(list_inner_product(x, z), 6) + 0.0 AS rerank_score FROM near, z), r AS (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, vec_id) AS rerank FROM s)
SELECT vec_id, rank, rerank_score, rerank FROM r WHERE rerank <= 10""")
def rerank(spark, d):
    e = _embeddings(spark, d)
    page = search.knn(e, vector_of(e, 0), 20, id_col="vec_id", keep=("embedding",)).select("vec_id", "rank", "embedding")
    return recommend.rerank(page, vector_of(e, 9), 10, "vec_id").drop("embedding")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT x AS q FROM e WHERE vec_id = 0),
d AS (SELECT vec_id, round(1.0 / (1.0 + (round(1.0 - list_cosine_similarity(x, q), 6) + 0.0)), 6) + 0.0 AS score, row_number() OVER (ORDER BY round(1.0 - list_cosine_similarity(x, q), 6) + 0.0, vec_id) AS rank FROM e, q)
SELECT '@tab SearchResult [id score metadata]' || chr(10) || string_agg(vec_id || ' ' || printf('%.4f', score) || ' {}', chr(10) ORDER BY rank) || chr(10) || '@end' AS glyph FROM d WHERE rank <= 5""")
def glyph_encode(spark, d):
    e = _embeddings(spark, d)
    return tx.glyph_rows(search.knn(e, vector_of(e, 0), 5, id_col="vec_id"), "vec_id")
