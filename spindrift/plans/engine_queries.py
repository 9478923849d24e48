"""Registered queries on compression, clustering, statistics, changes, feedback, graphs, notes and streams, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import collection as cl
from ..operators import feedback as fb
from ..operators import distribution, graph, indexes, ivf, kg, migration, quantize, search, stats
from ..session import scratch_path, table
from ..sources import files
from ..streaming import changes as ch
from .search_queries import Q0, vector_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


# -- compression --------------------------------------------------------------------------------------------------------

BOUNDS = "u AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT pos, min(x) AS low, max(x) AS high, round(avg(x), 9) AS mean FROM u GROUP BY pos)"


@query(f"WITH {BOUNDS} SELECT pos::INT AS pos, low, high FROM b")
def quant_u8_train(spark, d):
    return quantize.u8_train(_embeddings(spark, d))


@query(f"""WITH {BOUNDS}, c AS (SELECT vec_id, u.pos, low, high, CASE WHEN high > low THEN greatest(0, least(255, floor((x - low) / (high - low) * 255)))::INT ELSE 0 END AS code FROM u JOIN b USING (pos))
SELECT vec_id, pos::INT AS pos, code, round(code / 255.0::DOUBLE * (high - low) + low, 6) + 0.0 AS value FROM c""")
def quant_u8(spark, d):
    e = _embeddings(spark, d)
    low, high = quantize.bounds(quantize.u8_train(e))
    coded = e.select("vec_id", quantize.u8_encode("embedding", low, high).alias("codes"))
    both = F.arrays_zip(F.col("codes").alias("code"), quantize.u8_decode("codes", low, high).alias("value"))
    return coded.select("vec_id", F.posexplode(both).alias("pos", "x")).select("vec_id", "pos", "x.code", v.rounded(F.col("x.value")).alias("value"))


HAMMING = f"""{BOUNDS}, bits AS (SELECT vec_id, u.pos, x > mean AS bit FROM u JOIN b USING (pos)),
h AS (SELECT a.vec_id, sum((a.bit <> z.bit)::INT)::BIGINT AS hamming FROM bits a JOIN (SELECT pos, bit FROM bits WHERE vec_id = 0) z USING (pos) GROUP BY a.vec_id)"""


@query(f"WITH {HAMMING}, t AS (SELECT *, row_number() OVER (ORDER BY hamming, vec_id) AS rank FROM h) SELECT vec_id, hamming, round(1.0 - 2.0 * hamming / 64.0, 6)::DOUBLE + 0.0 AS score, rank FROM t WHERE rank <= 20")
def quant_binary_hamming(spark, d):
    e = _embeddings(spark, d)
    return quantize.binary_search(e, vector_of(e, 0), quantize.binary_train(e), 20, id_col="vec_id")


@query(f"""WITH {HAMMING}, {Q0}, c AS (SELECT vec_id, hamming FROM (SELECT *, row_number() OVER (ORDER BY hamming, vec_id) AS r FROM h) WHERE r <= 100),
s AS (SELECT vec_id, hamming, round(1.0 - list_cosine_similarity(x, q), 6) + 0.0 AS distance FROM c JOIN e USING (vec_id), q), t AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM s)
SELECT vec_id, hamming, distance, rank FROM t WHERE rank <= 10""")
def rescore(spark, d):
    e = _embeddings(spark, d)
    return quantize.binary_search(e, vector_of(e, 0), quantize.binary_train(e), 10, rescore=100, id_col="vec_id")


@query("""SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x - (CASE WHEN abs(x) < pow(2.0, -14) THEN 0.0
  ELSE sign(x) * floor(abs(x::DOUBLE) / pow(2.0, floor(log2(abs(x::DOUBLE))) - 10)) * pow(2.0, floor(log2(abs(x::DOUBLE))) - 10) END)::FLOAT)::FLOAT)) AS worst FROM embeddings""")
def quant_fp16(spark, d):
    e = _embeddings(spark, d).select("vec_id", "embedding", quantize.fp16_encode("embedding").alias("code"))
    return e.select("vec_id", F.transform(F.arrays_zip(F.col("embedding").alias("a"), quantize.fp16_decode("code").alias("b")), lambda p: F.abs(p["a"] - p["b"])).alias("e")).select("vec_id", F.array_max("e").alias("worst"))


#: Rounds of the fits below, few enough for SQL to follow.
FIT_ROUNDS = 3


def _fit_sql(m: int, k: int, rounds: int = FIT_ROUNDS) -> str:
    """k-means of each of m subspaces over all rows, round by round: parts (vec_id, j, part), book (j, c, centre) and codes (vec_id, j, code)."""
    w = 64 // m
    steps = [
        "n AS (SELECT count(*) AS n FROM embeddings)",
        "r AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings)",
        f"parts AS MATERIALIZED (SELECT vec_id, r, j, x[(j * {w} + 1):(j * {w} + {w})] AS part FROM (SELECT *, unnest(range({m})) AS j FROM r))",
        f"b0 AS MATERIALIZED (SELECT j, r // (n // {k}) AS c, part AS centre FROM parts, n WHERE r % (n // {k}) = 0 AND r < {k} * (n // {k}))",
    ]
    near = "(SELECT vec_id, j, arg_min(c, struct_pack(d := d, c := c)) AS code FROM (SELECT p.vec_id, p.j, b.c, round(list_sum(list_transform(list_zip(part, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d FROM parts p JOIN {book} b USING (j)) GROUP BY vec_id, j)"
    for t in range(rounds):
        steps.append(f"a{t} AS MATERIALIZED {near.format(book=f'b{t}')}")
        steps.append(f"u{t} AS (SELECT j, code AS c, unnest(range({w})) AS pos, unnest(part) AS v FROM parts JOIN a{t} USING (vec_id, j))")
        steps.append(f"m{t} AS (SELECT j, c, list(mean ORDER BY pos) AS centre FROM (SELECT j, c, pos, round(avg(v), 9) + 0.0 AS mean FROM u{t} GROUP BY ALL) GROUP BY j, c)")
        steps.append(f"b{t + 1} AS MATERIALIZED (SELECT b.j, b.c, coalesce(m.centre, list_transform(range({w}), lambda i: 0.0::DOUBLE)) AS centre FROM b{t} b LEFT JOIN m{t} m USING (j, c))")
    return ", ".join([*steps, f"book AS MATERIALIZED (SELECT * FROM b{rounds})", f"codes AS MATERIALIZED {near.format(book='book')}"])


def _pq_sql(m: int, k: int) -> str:
    return _fit_sql(m, k) + ", s AS (SELECT vec_id, j, x FROM parts JOIN r USING (vec_id))"


def _book(e: DataFrame, m: int, k: int) -> quantize.Codebook:
    return ivf.fit_pq(e, m, k, FIT_ROUNDS, "vec_id")


@query(f"WITH {_pq_sql(8, 32)} SELECT vec_id, j::INT AS pos, code::INT AS code FROM codes")
def pq_encode(spark, d):
    e = _embeddings(spark, d)
    return e.select("vec_id", F.posexplode(_book(e, 8, 32).encode("embedding")).alias("pos", "code"))


ADC = "adc AS (SELECT c.vec_id, round(sum(list_sum(list_transform(list_zip(q.part, b.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) + 0.0 AS distance FROM codes c JOIN book b ON b.j = c.j AND b.c = c.code JOIN (SELECT j, part FROM parts WHERE vec_id = 40) q ON q.j = c.j GROUP BY c.vec_id)"


@query(f"WITH {_pq_sql(8, 32)}, {ADC}, t AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM adc) SELECT vec_id, distance, rank FROM t WHERE rank <= 20")
def pq_adc(spark, d):
    e = _embeddings(spark, d)
    book = _book(e, 8, 32)
    return quantize.pq_search(e.select("vec_id", book.encode("embedding").alias("codes")), book, vector_of(e, 40), 20, "vec_id")


@query(f"WITH {_pq_sql(16, 16)}, nib AS (SELECT vec_id, j // 2 AS pos, sum(code * CASE j % 2 WHEN 0 THEN 1 ELSE 16 END) AS code FROM codes GROUP BY ALL) SELECT vec_id, pos::INT AS pos, code::INT AS code FROM nib")
def pq4_encode(spark, d):
    e = _embeddings(spark, d)
    book = _book(e, 16, 16)
    packed = e.select("vec_id", quantize.pack_nibbles(book.encode("embedding"), 16).alias("packed"))
    back = packed.select("vec_id", "packed", quantize.unpack_nibbles(F.col("packed"), 16).alias("codes"))
    again = back.select("vec_id", quantize.pack_nibbles(F.col("codes"), 16).alias("packed"))
    return again.select("vec_id", F.posexplode("packed").alias("pos", "code"))


@query(f"WITH {_pq_sql(16, 16)}, {ADC}, t AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM adc) SELECT vec_id, distance, rank FROM t WHERE rank <= 20")
def pq4_adc(spark, d):
    e = _embeddings(spark, d)
    book = _book(e, 16, 16)
    return quantize.pq_search(e.select("vec_id", book.encode("embedding").alias("codes")), book, vector_of(e, 40), 20, "vec_id")


@query(f"""WITH {_pq_sql(16, 16)}, {ADC}, t AS (SELECT b.j, b.c, list_sum(list_transform(list_zip(q.part, b.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM book b JOIN parts q ON q.j = b.j WHERE q.vec_id = 40),
lows AS (SELECT j, min(d) AS low, max(d) - min(d) AS wide FROM t GROUP BY j), scale AS (SELECT greatest(max(wide), 1e-30) / 255.0::DOUBLE AS scale, sum(low) AS base FROM lows),
small AS (SELECT t.j, t.c, floor((d - low) / scale + 0.5) AS q FROM t JOIN lows USING (j), scale)
SELECT a.vec_id, a.distance AS exact, round(s.q * scale + base, 6) + 0.0 AS quantised FROM adc a JOIN (SELECT vec_id, sum(q) AS q FROM codes k JOIN small ON small.j = k.j AND small.c = k.code GROUP BY vec_id) s USING (vec_id), scale""")
def pq4_fast_scan(spark, d):
    e = _embeddings(spark, d)
    book = _book(e, 16, 16)
    coded = e.select("vec_id", book.encode("embedding").alias("codes"))
    q = vector_of(e, 40)
    return coded.select("vec_id", v.rounded(book.adc("codes", q)).alias("exact"), v.rounded(book.fast_scan("codes", q)).alias("quantised"))


# -- clustering ---------------------------------------------------------------------------------------------------------

CENTRES = f"{_fit_sql(1, 8)}, c AS (SELECT c AS cluster_id, centre FROM book), a AS (SELECT vec_id, code AS cluster_id FROM codes)"


def _index(spark, d) -> tuple[DataFrame, list[list[float]], DataFrame]:
    e = _embeddings(spark, d)
    centres = ivf.kmeans(e, 8, FIT_ROUNDS, "vec_id")
    return e, centres, ivf.assign(e, centres)


@query(f"WITH {CENTRES} SELECT vec_id, cluster_id::BIGINT AS cluster_id FROM a")
def ivf_assign(spark, d):
    return _index(spark, d)[2].select("vec_id", "cluster_id")


@query(f"WITH {CENTRES} SELECT cluster_id::BIGINT AS cluster_id, count(*) AS rows FROM a GROUP BY cluster_id")
def ivf_cluster_sizes(spark, d):
    return ivf.cluster_sizes(_index(spark, d)[2])


@query(f"WITH {CENTRES}, u AS (SELECT cluster_id, unnest(range(64)) AS pos, unnest(x) AS v FROM a JOIN r USING (vec_id)) SELECT cluster_id::BIGINT AS cluster_id, pos::INT AS pos, round(avg(v), 9) + 0.0 AS mean FROM u GROUP BY cluster_id, pos")
def kmeans_step(spark, d):
    e, centres, _ = _index(spark, d)
    return ivf.lloyd_step(e, centres)


@query(f"""WITH {CENTRES}, q AS (SELECT x AS q FROM r WHERE vec_id = 40),
p AS (SELECT cluster_id FROM (SELECT cluster_id, row_number() OVER (ORDER BY round(1 - list_cosine_similarity(centre, q), 9), cluster_id) AS k FROM c, q) WHERE k <= 3),
s AS (SELECT vec_id, cluster_id, round(1.0 - list_cosine_similarity(x, q), 6) + 0.0 AS distance FROM a JOIN r USING (vec_id), q WHERE cluster_id IN (SELECT cluster_id FROM p)), t AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM s)
SELECT vec_id, cluster_id::BIGINT AS cluster_id, distance, rank FROM t WHERE rank <= 10""")
def ivf_search(spark, d):
    e, centres, index = _index(spark, d)
    return ivf.search(index, centres, vector_of(e, 40), 10, 3, id_col="vec_id")


@query(f"""WITH {CENTRES}, q AS (SELECT vec_id AS query_id, x AS q FROM r WHERE vec_id % 20 = 0),
p AS (SELECT query_id, q, cluster_id FROM (SELECT query_id, q, cluster_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_sum(list_transform(list_zip(centre, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), cluster_id) AS k FROM c, q) WHERE k <= 3),
s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(x, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) + 0.0 AS distance FROM a JOIN r USING (vec_id) JOIN p USING (cluster_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) SELECT query_id, vec_id, distance, rank FROM t WHERE rank <= 5""")
def ivf_search_batch(spark, d):
    e, centres, index = _index(spark, d)
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return ivf.search_batch(index, centres, asked, 5, 3, id_col="vec_id")


@query()
def ivf_binary_search(spark, d):
    e, centres, index = _index(spark, d)
    return ivf.binary_search(index, centres, ivf.binary_thresholds(index), vector_of(e, 40), 10, 4, rescore=50, id_col="vec_id")


@query()
def ivf_pq_search(spark, d):
    e, centres, index = _index(spark, d)
    rest = ivf.residuals(index, centres)
    book = ivf.fit_pq(rest.select("vec_id", "residual"), 8, 16, 2, "vec_id", "residual")
    coded = rest.select("vec_id", "cluster_id", book.encode("residual").alias("codes"))
    return ivf.pq_search(coded, centres, book, vector_of(e, 40), 10, 4, "vec_id")


@query()
def recall_at_k(spark, d):
    """Recall of probing 4 of 8 clusters against the exact answer, for every row whose id 20 divides."""
    e, centres, index = _index(spark, d)
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = search.knn_batch(asked, e, 10, "l2_squared", id_col="vec_id")
    return search.recall_at_k(exact, ivf.search_batch(index, centres, asked, 10, 4, id_col="vec_id"), 10, id_col="vec_id")


# -- statistics ---------------------------------------------------------------------------------------------------------

DOCS = "docs AS (SELECT event_id, event_type AS collection, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 't' || user_id % 3 END AS tenant_id, user_id % 10 = 0 AS deleted FROM events)"


def _docs(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    tenant = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")))
    meta = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return e.select("event_id", F.col("event_type").alias("collection"), tenant.alias("tenant_id"), (F.col("user_id") % 10 == 0).alias("deleted"), meta.alias("meta"), F.col("ts"), "value")


@query(f"WITH {DOCS} SELECT collection, count(*) AS total, count(*) FILTER (deleted) AS deleted, count(*) FILTER (NOT deleted) AS active, round(100.0::DOUBLE * count(*) FILTER (deleted) / count(*), 6) + 0.0 AS fragmentation, (100.0 * count(*) FILTER (deleted) / count(*) >= 10 OR count(*) FILTER (deleted) >= 1000) AS compact FROM docs GROUP BY collection")
def collection_stats(spark, d):
    return stats.needs_compaction(stats.collection_stats(_docs(spark, d)), 10.0)


@query(f"WITH {DOCS} SELECT coalesce(tenant_id, 'default') AS tenant_id, collection, count(*) AS active FROM docs WHERE NOT deleted GROUP BY ALL")
def tenant_stats(spark, d):
    return stats.tenant_stats(_docs(spark, d))


@query(f"WITH {DOCS} SELECT event_id FROM docs WHERE coalesce(tenant_id, 'default') = 'default' AND collection IN ('view', 'click')")
def tenant_access(spark, d):
    from ..functions import filters as fl

    return _docs(spark, d).filter(fl.access("default", ["view", "click"])).select("event_id")


@query("SELECT DISTINCT props->>'$.k' AS value FROM events")
def metadata_values(spark, d):
    return stats.metadata_values(_docs(spark, d), "k")


@query("SELECT unnest(['type', 'k']) AS key")
def metadata_keys(spark, d):
    return stats.metadata_keys(_docs(spark, d))


@query("WITH s AS (SELECT count(*) FILTER (CAST(props->>'$.k' AS INT) = 7) AS matched, count(*) AS total FROM events) SELECT matched, total, round(matched / total, 6) + 0.0 AS selectivity, CASE WHEN matched / total <= 0.001 THEN 'highly_selective' WHEN matched / total <= 0.01 THEN 'very_selective' WHEN matched / total <= 0.1 THEN 'selective' WHEN matched / total <= 0.5 THEN 'moderate' ELSE 'broad' END AS recommendation FROM s")
def filter_selectivity(spark, d):
    return stats.analyze_filter(_docs(spark, d), F.try_element_at("meta", F.lit("k")) == "7")


COST = "ops AS (SELECT event_id, ts, greatest(1, strlen(props) // 4)::BIGINT AS tokens, greatest(1, strlen(props) // 4) / 1000.0::DOUBLE * 0.02 AS cost FROM events)"


def _ops(spark, d) -> DataFrame:
    return stats.with_cost(table(spark, d, "events"), 0.02, "props").select("event_id", "ts", "tokens", "cost")


@query(f"WITH {COST} SELECT CAST(ts AS DATE) AS day, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) + 0.0 AS cost, count(*) AS operations FROM ops GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def cost_daily(spark, d):
    return stats.cost_daily(_ops(spark, d), 7)


@query(f"WITH {COST} SELECT sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) + 0.0 AS cost, count(*) AS operations FROM ops")
def cost_totals(spark, d):
    return stats.cost_totals(_ops(spark, d))


@query(f"WITH {COST} SELECT event_id, tokens FROM ops ORDER BY ts DESC, event_id LIMIT 25")
def cost_recent(spark, d):
    return _ops(spark, d).orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "tokens")


@query("SELECT event_id AS id, event_type AS type, user_id % 5 AS severity FROM events WHERE event_type IN ('error', 'signup') AND user_id % 5 >= 3 AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10")
def audit_query(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("type"), (F.col("user_id") % 5).alias("severity"))
    rows, _ = stats.audit(e, start=F.lit("2024-01-10").cast("timestamp"), kinds=["error", "signup"], min_severity=3, limit=50, offset=10)
    return rows.select("id", "type", "severity")


def _sets(spark, d) -> list[DataFrame]:
    e = table(spark, d, "events")
    return [e.filter(F.col("event_type") == t).select("user_id") for t in ("click", "error", "view")]


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'")
def set_and(spark, d):
    return stats.set_and(_sets(spark, d))


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'error', 'view')")
def set_or(spark, d):
    return stats.set_or(_sets(spark, d))


@query("SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0")
def set_difference(spark, d):
    e = table(spark, d, "events")
    return stats.set_difference(e.filter("event_type = 'click'").select("user_id"), e.filter("event_type = 'error' and user_id % 3 = 0").select("user_id"))


# -- changes ------------------------------------------------------------------------------------------------------------

LOG = "log AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'upsert' ELSE 'insert' END AS op, 'd' || user_id AS id, value FROM events)"


def _log(spark, d) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "upsert").otherwise("insert")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("id"), "value")


@query(f"""WITH {LOG}, l AS (SELECT id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value, coalesce(max(seq) FILTER (op = 'delete'), -1) AS gone FROM log GROUP BY id)
SELECT l.id, l.seq, (SELECT min(g.seq) FROM log g WHERE g.id = l.id AND g.op <> 'delete' AND g.seq > l.gone) AS first_seq, l.value FROM l WHERE l.op <> 'delete'""")
def changelog_fold(spark, d):
    return cl.fold_changes(_log(spark, d))


@query(f"WITH {LOG} SELECT id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM log GROUP BY id")
def upsert_latest(spark, d):
    return cl.latest(_log(spark, d))


@query("SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def tombstone_antijoin(spark, d):
    e = table(spark, d, "events")
    return cl.without(e.select(F.col("event_id").alias("id")), e.filter("event_type = 'error'").select(F.col("event_id").alias("id")))


@query(f"WITH {LOG} SELECT min(seq) AS first, max(seq) AS last, count(*) AS entries, count(*) FILTER (op = 'insert') AS \"insert\", count(*) FILTER (op = 'upsert') AS upsert, count(*) FILTER (op = 'delete') AS \"delete\" FROM log WHERE seq >= 500")
def log_stats(spark, d):
    return files.log_stats(files.truncate_log(_log(spark, d), 500))


@query("SELECT user_id, event_type, row_number() OVER (ORDER BY ts, event_id) + 999 AS id FROM events")
def assign_ids(spark, d):
    return cl.assign_ids(table(spark, d, "events"), 1000, ["ts", "event_id"]).select("user_id", "event_type", "id")


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' AND user_id < 10 THEN 'moved' ELSE event_type END AS collection FROM events")
def move_collection(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("collection"))
    return cl.move(rows, e.filter("user_id < 10").select(F.col("event_id").alias("id")), "moved", "view")


@query()
def stream_changelog(spark, d):
    """The change log applied as a stream of files, version by version."""
    root = scratch_path(spark, "changes")
    rows = _log(spark, d).selectExpr("seq", "op", "id", "cast(value as string) as doc", "cast(null as map<string,string>) as meta", "cast(null as array<float>) as vec", "'c' as coll", "'t' as tenant", "seq as time")
    rows.repartition(4, F.col("seq") % 4).write.json(f"{root}/log")
    ch.follow(ch.read_changes(spark, f"{root}/log", 2), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    ch.compact(spark, f"{root}/table")
    return ch.state_of(spark, f"{root}/table").filter("op <> 'delete'").select("id", "seq", F.col("doc").cast("double").alias("value"))


SQL["stream_changelog"] = f"WITH {LOG}, l AS (SELECT id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM log GROUP BY id) SELECT id, seq, value FROM l WHERE op <> 'delete'"


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return ch.tumbling(table(spark, d, "events"))


@query("SELECT w AS window_start, event_type, count(*) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2")
def events_sliding(spark, d):
    return ch.sliding(table(spark, d, "events"))


@query("""WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
SELECT min(ts) AS session_start, user_id, count(*) AS events FROM s GROUP BY user_id, g""")
def events_sessions(spark, d):
    return ch.sessions(table(spark, d, "events"))


# -- feedback -----------------------------------------------------------------------------------------------------------

FEED = """i AS (SELECT 'i' || event_id AS id, 'q' || user_id % 10 AS query_hash, ['r' || event_id % 7, 'r' || event_id % 5, 'r9'] AS result_ids, ts FROM events WHERE event_type <> 'signup'),
f AS (SELECT 'f' || event_id AS id, 'i' || event_id AS interaction_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'error' THEN 'requery' WHEN 'view' THEN 'dwell' ELSE 'explicit' END AS type,
  CASE event_type WHEN 'purchase' THEN (event_id % 5 - 2) / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS sentiment, ['r' || event_id % 7, 'r' || event_id % 5] AS clicked_ids, ['r9'] AS rejected_ids, ts FROM events WHERE event_type <> 'signup')"""


def _feed(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").filter("event_type <> 'signup'")
    i = e.selectExpr("concat('i', event_id) as id", "concat('q', user_id % 10) as query_hash", "array(concat('r', event_id % 7), concat('r', event_id % 5), 'r9') as result_ids", "ts")
    f = e.selectExpr("concat('f', event_id) as id", "concat('i', event_id) as interaction_id", "case event_type when 'click' then 'click' when 'error' then 'requery' when 'view' then 'dwell' else 'explicit' end as type", "case event_type when 'purchase' then (event_id % 5 - 2) / 2.0D else 0.0D end as sentiment", "array(concat('r', event_id % 7), concat('r', event_id % 5)) as clicked_ids", "array('r9') as rejected_ids", "ts")
    return i, f


DELTA = f"""{FEED}, d AS (SELECT f.*, query_hash, CASE type WHEN 'click' THEN 0.1 WHEN 'requery' THEN -0.15 WHEN 'dwell' THEN 0.03 ELSE sentiment * CASE WHEN sentiment > 0 THEN 0.1 ELSE 0.15 END END::DOUBLE AS delta FROM f JOIN i ON i.id = f.interaction_id),
x AS (SELECT unnest(CASE WHEN delta > 0 THEN clicked_ids ELSE rejected_ids END) AS target_id, query_hash, ts, id AS feedback_id, delta FROM d WHERE delta <> 0),
deltas AS (SELECT * FROM x UNION ALL SELECT target_id, '', ts, feedback_id, delta / 2 FROM x)"""
BOOSTS = f"{DELTA}, boosts AS (SELECT target_id, query_hash, round(list_reduce(list(delta ORDER BY ts, feedback_id, delta), lambda b, s: greatest(0.1::DOUBLE, least(3.0::DOUBLE, b + s)), 1.0::DOUBLE), 6) + 0.0 AS boost, count(*) AS count, round(count(*) / (count(*) + 5), 6) + 0.0 AS confidence FROM deltas GROUP BY ALL)"


@query(f"WITH {DELTA} SELECT target_id, query_hash, feedback_id, round(delta, 6) + 0.0 AS delta FROM deltas")
def feedback_deltas(spark, d):
    return fb.deltas(*_feed(spark, d)).select("target_id", "query_hash", "feedback_id", v.rounded(F.col("delta")).alias("delta"))


@query(f"WITH {BOOSTS} SELECT target_id, query_hash, boost, count, confidence FROM boosts")
def feedback_boosts(spark, d):
    return fb.boosts(fb.deltas(*_feed(spark, d))).drop("last_update")


@query(f"""WITH {BOOSTS}, r AS (SELECT 'r' || k AS id, (10 - k)::DOUBLE AS score FROM range(10) t(k)), own AS (SELECT * FROM boosts WHERE query_hash = 'q3' AND confidence >= 0.3), every AS (SELECT * FROM boosts WHERE query_hash = '' AND confidence >= 0.3),
j AS (SELECT r.id, score, greatest(0.5, least(1.5, coalesce(own.boost, every.boost, 1.0)))::DOUBLE AS boost, CASE WHEN own.boost IS NOT NULL THEN 'query' WHEN every.boost IS NOT NULL THEN 'global' ELSE 'none' END AS boost_source FROM r LEFT JOIN own ON own.target_id = r.id LEFT JOIN every ON every.target_id = r.id)
SELECT id, score, boost, boost_source, round(score * boost, 6) + 0.0 AS boosted_score, row_number() OVER (ORDER BY round(score * boost, 6) DESC, id) AS rank FROM j""")
def boost_apply(spark, d):
    results = spark.range(10).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), (F.lit(10.0) - F.col("id")).alias("score"))
    return fb.apply(results, fb.boosts(fb.deltas(*_feed(spark, d))), "q3")


@query(f"WITH {BOOSTS} SELECT target_id, boost, confidence FROM boosts WHERE query_hash = 'q3' AND boost > 1 AND confidence >= 0.2 ORDER BY boost DESC, target_id LIMIT 5")
def boost_top(spark, d):
    return fb.top_for_query(fb.boosts(fb.deltas(*_feed(spark, d))), "q3", 5)


@query(f"WITH {BOOSTS} SELECT target_id, round(boost * confidence, 6) + 0.0 AS score FROM boosts WHERE query_hash = '' AND boost > 1 ORDER BY score DESC, target_id LIMIT 5")
def boost_recommended(spark, d):
    return fb.recommended(fb.boosts(fb.deltas(*_feed(spark, d))), 5)


@query("SELECT event_id, round(1 + (1.5 - 1) * greatest(0.0, 1 - 0.05 * (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 86400000000.0), 6)::DOUBLE + 0.0 AS boost FROM events WHERE ts < TIMESTAMP '2024-01-20'")
def boost_decay(spark, d):
    now = F.lit("2024-01-20").cast("timestamp")
    rows = table(spark, d, "events").filter(F.col("ts") < now)
    return rows.select("event_id", v.rounded(fb.decayed(F.lit(1.5), F.lit(0.05), F.col("ts").cast("timestamp"), now)).alias("boost"))


@query(f"WITH {FEED}, p AS (SELECT least(clicked_ids[1], clicked_ids[2]) AS source_id, greatest(clicked_ids[1], clicked_ids[2]) AS target_id FROM f) SELECT source_id, target_id, count(*) AS n, least(2.0, round(1.0::DOUBLE + 0.1::DOUBLE * count(*), 6) + 0.0)::DOUBLE AS boost FROM p GROUP BY ALL HAVING count(*) >= 2")
def coclick_edges(spark, d):
    return fb.coclicks(_feed(spark, d)[1])


@query(f"WITH {FEED} SELECT i.query_hash, count(*) AS searches, count(*) FILTER (sentiment > 0) AS positive, count(*) FILTER (sentiment < 0) AS negative FROM i LEFT JOIN f ON f.interaction_id = i.id GROUP BY i.query_hash")
def query_stats(spark, d):
    return fb.query_stats(*_feed(spark, d)).drop("clicked_ids")


@query(f"WITH {FEED} SELECT id FROM i WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 10 DAY ORDER BY ts DESC, id DESC LIMIT 500")
def prune_oldest(spark, d):
    i, f = _feed(spark, d)
    return fb.prune(i, f, fb.boosts(fb.deltas(i, f)), F.lit("2024-01-25").cast("timestamp"), 10, 500)[0].select("id")


# -- knowledge graphs ---------------------------------------------------------------------------------------------------

KG = """nodes AS (SELECT s_suppkey AS doc_id, 's' || s_suppkey AS id, s_name AS name, 'Supplier' AS type, repeat('x', (s_suppkey % 3)::INT) AS description FROM supplier
  UNION ALL SELECT s_suppkey, 'n' || n_nationkey, n_name, 'Nation', repeat('y', (s_suppkey % 5)::INT) FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT s_suppkey, 'r' || r_regionkey, r_name, 'Region', repeat('z', (s_suppkey % 7)::INT) FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
edges AS (SELECT s_suppkey AS doc_id, 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'IN' AS rel FROM supplier
  UNION ALL SELECT s_suppkey, 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF' FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def _kg(spark, d) -> tuple[DataFrame, DataFrame]:
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    a = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    nodes = a.selectExpr("s_suppkey as doc_id", "explode(array(struct(concat('s', s_suppkey) as id, s_name as name, 'Supplier' as type, repeat('x', cast(s_suppkey % 3 as int)) as description), struct(concat('n', n_nationkey) as id, n_name as name, 'Nation' as type, repeat('y', cast(s_suppkey % 5 as int)) as description), struct(concat('r', r_regionkey) as id, r_name as name, 'Region' as type, repeat('z', cast(s_suppkey % 7 as int)) as description))) as x").select("doc_id", "x.*")
    edges = a.selectExpr("s_suppkey as doc_id", "explode(array(struct(concat('s', s_suppkey) as src, concat('n', n_nationkey) as dst, 'IN' as rel), struct(concat('n', n_nationkey) as src, concat('r', n_regionkey) as dst, 'PART_OF' as rel))) as x").select("doc_id", "x.*").withColumn("weight", F.lit(1.0))
    return nodes, edges


@query(f"WITH {KG} SELECT id, arg_min(name, doc_id) AS name, arg_min(type, doc_id) AS type, arg_min(description, struct_pack(a := -length(description), b := doc_id)) AS description, count(DISTINCT doc_id) AS documents FROM nodes GROUP BY id")
def kg_merge_nodes(spark, d):
    return graph.merge_nodes(_kg(spark, d)[0])


@query(f"WITH {KG} SELECT src, dst, rel, 1.0::DOUBLE AS weight, count(*) AS times FROM edges GROUP BY src, dst, rel")
def kg_merge_edges(spark, d):
    return graph.merge_edges(_kg(spark, d)[1])


@query(f"WITH {KG} SELECT doc_id, src, dst, rel FROM edges WHERE src IN (SELECT id FROM nodes WHERE type <> 'Region') AND dst IN (SELECT id FROM nodes WHERE type <> 'Region')")
def kg_valid_edges(spark, d):
    nodes, edges = _kg(spark, d)
    return graph.valid_edges(edges, nodes.filter("type <> 'Region'")).select("doc_id", "src", "dst", "rel")


def _rank_sql(rounds: int, seed: str | None) -> str:
    base = "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS t FROM ids" if seed is None else f"SELECT id, CASE WHEN {seed} THEN 1.0::DOUBLE / (SELECT count(*) FROM ids WHERE {seed}) ELSE 0.0::DOUBLE END AS t FROM (SELECT id, any_value(name) AS name FROM nodes GROUP BY id)"
    if seed is not None:
        base = base.replace("FROM ids WHERE", "FROM (SELECT id, any_value(name) AS name FROM nodes GROUP BY id) WHERE")
    steps = ["r0 AS (SELECT id, t AS rank FROM base)"]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT b.id, 0.15::DOUBLE * t + 0.85::DOUBLE * (coalesce(g.got, 0.0) + t * (SELECT coalesce(sum(rank), 0.0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM outs))) AS rank
          FROM base b LEFT JOIN (SELECT dst AS id, sum(rank * times / n) AS got FROM links JOIN outs USING (src) JOIN r{i - 1} ON r{i - 1}.id = src GROUP BY dst) g ON g.id = b.id)""")
    return f"{KG}, ids AS (SELECT DISTINCT id FROM nodes), base AS ({base}), links AS (SELECT src, dst, count(*) AS times FROM edges GROUP BY ALL), outs AS (SELECT src, sum(times) AS n FROM links GROUP BY src), {', '.join(steps)}"


@query(f"WITH {_rank_sql(10, None)} SELECT id, round(rank, 6) + 0.0 AS rank FROM r10")
def pagerank(spark, d):
    nodes, edges = _kg(spark, d)
    return graph.pagerank(nodes, edges, 10, tolerance=0.0).select("id", v.rounded(F.col("rank")).alias("rank"))


_SEED = "(contains(lower(name), 'supplier#000000001') OR contains(lower(id), 'supplier#000000001') OR contains(lower(name), 'n1') OR contains(lower(id), 'n1'))"


@query(f"WITH {_rank_sql(10, _SEED)}, s AS (SELECT doc_id, round(sum(rank), 6) + 0.0 AS score FROM (SELECT DISTINCT doc_id, id FROM nodes) JOIN r10 USING (id) GROUP BY doc_id), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s) SELECT doc_id, score, rank FROM t WHERE rank <= 15")
def graph_search(spark, d):
    nodes, edges = _kg(spark, d)
    found = graph.seeds(nodes, ["Supplier#000000001", "N1", "x"])
    return graph.document_scores(nodes, graph.pagerank(nodes, edges, 10, seeds=found, tolerance=0.0), 15)


@query(f"WITH {KG} SELECT (SELECT count(DISTINCT doc_id) FROM nodes) AS documents, (SELECT count(DISTINCT id) FROM nodes) AS nodes, count(*) AS edges, count(DISTINCT rel) AS relations FROM edges")
def graph_stats(spark, d):
    return graph.stats(*_kg(spark, d))


@query()
def communities(spark, d):
    nodes, edges = _kg(spark, d)
    return graph.document_communities(nodes, graph.communities(nodes, edges))


@query(f"WITH {KG}, f AS (SELECT 's' || k AS source_id, 'n' || k AS target_id, 1.0 + k AS boost FROM range(1, 4) t(k)), more AS (SELECT source_id AS src, target_id AS dst, unnest(range(greatest(1, floor(boost)::INT))) FROM f) SELECT src, dst, count(*) AS times FROM (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM more) GROUP BY ALL")
def graph_edge_boosts(spark, d):
    boosts = spark.range(1, 4).selectExpr("concat('s', id) as source_id", "concat('n', id) as target_id", "cast(1 + id as double) as boost")
    return graph.boost_edges(_kg(spark, d)[1], boosts).groupBy("src", "dst").agg(F.count("*").alias("times"))


@query(f"WITH {KG}, g AS (SELECT id, coalesce(n, 0) AS n FROM (SELECT DISTINCT id FROM nodes) LEFT JOIN (SELECT src AS id, count(*) AS n FROM edges GROUP BY src) USING (id)) SELECT id, n AS degree, (sum(n) OVER (ORDER BY id) - n)::BIGINT AS first FROM g")
def graph_csr(spark, d):
    return graph.csr(*_kg(spark, d)).select("id", F.size("neighbours").cast("long").alias("degree"), "first")


@query()
def kg_extract(spark, d):
    nodes, edges, found = kg.cognify(table(spark, d, "documents"))
    return found


# -- notes --------------------------------------------------------------------------------------------------------------

NOTES = "notes AS (SELECT 'n' || doc_id AS name, 'v/' || source || '/n' || doc_id || '.md' AS path, ['n' || (doc_id * 7) % 50, 'n' || (doc_id * 3) % 20] AS linked FROM documents)"


def _notes(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr(
        "concat('v/', source, '/n', doc_id, '.md') as path",
        "concat('---\\ntitle: \"Note ', doc_id, '\"\\ntags: [A, #b', doc_id % 3, ']\\n---\\n# Head\\nsee [[x/n', (doc_id * 7) % 50, '|it]] and [[n', (doc_id * 3) % 20, '#part]] #a #c', doc_id % 2) as content",
        "timestamp '2024-03-01 10:00:00' as modified",
    )
    return files.parse_notes(rows)


@query(f"WITH {NOTES} SELECT name, path, 'Note ' || substr(name, 2) AS title, '2024-03-01' AS created, array_to_string(['A', 'b' || substr(name, 2)::BIGINT % 3, 'c' || substr(name, 2)::BIGINT % 2], ',') AS tags, array_to_string(CASE WHEN linked[1] = linked[2] THEN linked[1:1] ELSE linked END, ',') AS links FROM notes")
def note_parse(spark, d):
    return _notes(spark, d).select("name", "path", "title", "created", F.array_join("tags", ",").alias("tags"), F.array_join("links", ",").alias("links"))


@query(f"WITH {NOTES}, l AS (SELECT DISTINCT name AS source, unnest(linked) AS target FROM notes), b AS (SELECT target AS name, string_agg(source, ',' ORDER BY source) AS backlinks FROM l GROUP BY target) SELECT name, coalesce(backlinks, '') AS backlinks FROM notes LEFT JOIN b USING (name)")
def note_backlinks(spark, d):
    return files.backlinks(_notes(spark, d)).select("name", F.array_join("backlinks", ",").alias("backlinks"))


# -- distribution, strategies, migration --------------------------------------------------------------------------------

FNV = "list_reduce(list_transform(string_split(k, ''), lambda c: unicode(c)::UHUGEINT), lambda h, c: ((xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT), 14695981039346656037::UHUGEINT)"


@query(f"SELECT k AS collection, CAST({FNV} % 7 AS INT) AS shard FROM (SELECT DISTINCT event_type AS k FROM events)")
def shard_routing(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("collection"))
    return distribution.route(rows, 7).distinct()


def _sharded(spark, d) -> DataFrame:
    e = _embeddings(spark, d).withColumn("collection", F.concat(F.lit("c"), F.col("label").cast("string")))
    return distribution.route(e, 4)


@query(f"""WITH {Q0}, s AS (SELECT 'c' || k AS collection, CAST({FNV.replace("string_split(k,", "string_split('c' || k,")} % 4 AS INT) AS shard FROM (SELECT DISTINCT label::VARCHAR AS k FROM embeddings)),
r AS (SELECT vec_id, shard, round(list_inner_product(x, q), 6) + 0.0 AS score FROM e JOIN s ON s.collection = 'c' || e.label, q WHERE s.collection IN ('c1', 'c4', 'c7'))
SELECT vec_id, shard, score FROM r ORDER BY score DESC, vec_id LIMIT 12""")
def scatter_gather(spark, d):
    e = _sharded(spark, d)
    return distribution.scatter_gather(e, vector_of(_embeddings(spark, d), 0), 12, ["c1", "c4", "c7"], 4, "vec_id")


@query("SELECT 'c' || k AS collection, k % 4 AS source, k % 5 AS target FROM range(40) t(k) WHERE k % 4 <> k % 5")
def rebalance_plan(spark, d):
    m = lambda n: spark.range(40).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("collection"), (F.col("id") % n).alias("shard"))
    return distribution.plan_moves(m(4), m(5))


@query("SELECT count(*) AS rows, 0::BIGINT AS deleted, count(*) AS live, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings")
def index_sizes(spark, d):
    return indexes.sizes(_embeddings(spark, d))


@query("SELECT count(*) AS nodes, count(*) * 3 AS edges, 3::BIGINT AS least, 3.0::DOUBLE AS mean, 3::BIGINT AS most FROM embeddings")
def knn_graph_degrees(spark, d):
    return indexes.degrees(search.knn_graph(_embeddings(spark, d), 3, "l2", id_col="vec_id"))


@query(f"WITH {Q0}, t AS (SELECT vec_id, row_number() OVER (ORDER BY round(1.0 - list_cosine_similarity(x, q), 6) + 0.0, vec_id) AS rank FROM e, q WHERE label <> 3) SELECT i AS index_type, vec_id, rank FROM t, (VALUES ('flat'), ('hnsw'), ('diskann')) v(i) WHERE rank <= 5")
def index_strategies(spark, d):
    e = _embeddings(spark, d)
    parts = [indexes.create(n, e, "vec_id")(vector_of(e, 0), 5, F.col("label") != 3).select(F.lit(n).alias("index_type"), "vec_id", "rank") for n in ("flat", "hnsw", "diskann")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT x AS q FROM e WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_cosine_similarity(x, q), 6) + 0.0 AS score FROM e, q), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s) SELECT vec_id, score, rank FROM t WHERE rank <= 10""")
def index_sparse(spark, d):
    e = _embeddings(spark, d)
    return indexes.create("sparse", e, "vec_id")(vector_of(e, 0), 10)


@query()
def migrate_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", migration.hash_embedding(F.col("text"), 16).alias("embedding"), F.create_map(F.lit("lang"), "lang").alias("meta"))
    return migration.to_collection(docs).select("id", F.size("embedding").alias("dim"), F.size("keywords.indices").alias("terms"), "metadata")
