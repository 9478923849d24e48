"""Feedback learning: signals to deltas, boosts as ordered folds, boosted results, co-click edges, retention.

Interactions and feedback are tables (see README for their columns); boosts are keyed by target and query hash, the
empty hash being the global key. A fold clamps at every step, so a key's deltas are applied in time order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v

# The weight of each signal.
DELTAS = {"thumbs_up": 0.1, "click": 0.1, "thumbs_down": -0.15, "requery": -0.15, "dwell": 0.03, "ignore": -0.015}
POSITIVE, NEGATIVE = 0.1, 0.15
IMPLICIT = {"click": 0.5, "dwell": 0.3, "ignore": -0.1, "requery": -0.5}
DWELL_MS = 5000
LOW, HIGH = 0.1, 3.0
CONFIDENT, LIMIT = 0.3, 0.5


def delta(kind: Column, sentiment: Column) -> Column:
    """The boost change of a signal; natural and explicit ones go by sentiment."""
    known = F.create_map(*[F.lit(x) for pair in DELTAS.items() for x in pair])
    by_sentiment = F.when(sentiment > 0, sentiment * F.lit(POSITIVE)).otherwise(sentiment * F.lit(NEGATIVE))
    return F.coalesce(F.try_element_at(known, kind), F.when(kind.isin("natural", "explicit"), by_sentiment), F.lit(0.0)).cast("double")


def targets(d: Column, clicked: Column, rejected: Column, results: Column) -> Column:
    """Clicked ids of a gain, rejected ids of a loss, all results where there are none of those."""
    none = F.array().cast("array<string>")
    chosen = F.when(d > 0, F.coalesce(clicked, none)).when(d < 0, F.coalesce(rejected, none)).otherwise(none)
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.coalesce(results, none))


def rating_sentiment(rating: Column) -> Column:
    """(rating - 3) / 2 of 4 and more or 2 and less; 0 between."""
    return F.when((rating >= 4) | (rating <= 2), (rating - 3) / F.lit(2.0)).otherwise(F.lit(0.0))


def rating_kind(rating: Column) -> Column:
    return F.when(rating >= 4, "thumbs_up").when(rating <= 2, "thumbs_down").otherwise("explicit")


def implicit_kind(signal: Column, duration_ms: Column) -> Column:
    """click, ignore and requery as they are; a dwell is one from DWELL_MS, else an ignore; others are null."""
    return F.when(signal == "dwell", F.when(duration_ms >= DWELL_MS, "dwell").otherwise("ignore")).when(signal.isin("click", "ignore", "requery"), signal)


def explicit(ratings: DataFrame) -> DataFrame:
    """Feedback of ratings (id, interaction_id, rating, clicked_ids, rejected_ids, ts): its type and sentiment by the rating."""
    r = F.col("rating")
    return ratings.select("id", "interaction_id", rating_kind(r).alias("type"), rating_sentiment(r).cast("double").alias("sentiment"), "clicked_ids", "rejected_ids", "ts")


def implicit(signals: DataFrame) -> DataFrame:
    """Feedback of signals (id, interaction_id, signal, duration_ms, target_ids, ts); unknown signals are left out."""
    kind = implicit_kind(F.col("signal"), F.col("duration_ms"))
    known = F.create_map(*[F.lit(x) for pair in IMPLICIT.items() for x in pair])
    rows = signals.withColumn("type", kind).filter("type is not null")
    return rows.select("id", "interaction_id", "type", F.try_element_at(known, F.col("type")).cast("double").alias("sentiment"), F.col("target_ids").alias("clicked_ids"), F.array().cast("array<string>").alias("rejected_ids"), "ts")


def natural(texts: DataFrame, score: Column | None = None) -> DataFrame:
    """Feedback of texts (id, interaction_id, text, ts) by rule-based sentiment, or by a score of the caller's (a model)."""
    none = F.array().cast("array<string>")
    return texts.select("id", "interaction_id", F.lit("natural").alias("type"), (score if score is not None else tx.sentiment(F.col("text"))).cast("double").alias("sentiment"), none.alias("clicked_ids"), none.alias("rejected_ids"), "ts")


def record_and_boost(results: DataFrame, all_boosts: DataFrame, query: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Boosted results and the interaction (one row) that records them as they were shown."""
    h = F.substring(F.sha2(F.lit(query).cast("binary"), 256), 1, 16)
    key = results.sparkSession.range(1).select(h).first()[0]
    boosted = apply(results, all_boosts, key)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    made = boosted.agg(shown.alias("result_ids")).select(F.substring(F.sha2(F.concat(F.lit(query), now.cast("string")).cast("binary"), 256), 1, 12).alias("id"), F.lit(query).alias("query"), F.lit(key).alias("query_hash"), "result_ids", now.alias("ts"))
    return boosted, made


def deltas(interactions: DataFrame, feedback: DataFrame) -> DataFrame:
    """target_id, query_hash, ts, feedback_id and delta of every change; the global key gets half. Feedback on no interaction is left out."""
    rows = feedback.join(interactions.select(F.col("id").alias("interaction_id"), "query_hash", "result_ids"), "interaction_id")
    rows = rows.withColumn("d", delta(F.col("type"), F.col("sentiment"))).filter("d <> 0")
    rows = rows.select(F.explode(targets(F.col("d"), F.col("clicked_ids"), F.col("rejected_ids"), F.col("result_ids"))).alias("target_id"), "query_hash", "ts", F.col("id").alias("feedback_id"), "d")
    half = rows.select("target_id", F.lit("").alias("query_hash"), "ts", "feedback_id", (F.col("d") / 2).alias("d"))
    return rows.unionByName(half).select("target_id", "query_hash", "ts", "feedback_id", F.col("d").alias("delta"))


def fold(steps: Column) -> Column:
    """The boost after deltas in order, from 1, clamped at each step."""
    return F.aggregate(steps, F.lit(1.0), lambda b, d: F.greatest(F.lit(LOW), F.least(F.lit(HIGH), b + d)))


def boosts(changes: DataFrame) -> DataFrame:
    """target_id, query_hash, boost, count, confidence and last_update of every key, folded in time order (ties by feedback id)."""
    keyed = changes.groupBy("target_id", "query_hash").agg(F.sort_array(F.collect_list(F.struct("ts", "feedback_id", "delta"))).alias("steps"))
    n = F.size("steps").cast("long")
    return keyed.select("target_id", "query_hash", v.rounded(fold(F.transform("steps", lambda s: s["delta"]))).alias("boost"), n.alias("count"), v.rounded(n / (n + 5)).alias("confidence"), F.element_at("steps", -1)["ts"].alias("last_update"))


def decayed(boost: Column, rate: Column, since: Column, now: Column) -> Column:
    """1 + (boost - 1) * max(0, 1 - rate * days)."""
    days = (F.unix_micros(now) - F.unix_micros(since)) / F.lit(86_400_000_000.0)
    return F.lit(1.0) + (boost - 1.0) * F.greatest(F.lit(0.0), F.lit(1.0) - rate * days)


def lookup(ids: DataFrame, all_boosts: DataFrame, query_hash: str) -> DataFrame:
    """ids with `boost` and `boost_source`: the query's where confident enough, else the global one, else 1."""
    sure = all_boosts.filter(F.col("confidence") >= CONFIDENT)
    own = sure.filter(F.col("query_hash") == query_hash).select(F.col("target_id").alias("id"), F.col("boost").alias("own"))
    every = sure.filter("query_hash = ''").select(F.col("target_id").alias("id"), F.col("boost").alias("every"))
    rows = ids.join(own, "id", "left").join(every, "id", "left")
    return rows.withColumns({"boost": F.coalesce("own", "every", F.lit(1.0)), "boost_source": F.when(F.col("own").isNotNull(), "query").when(F.col("every").isNotNull(), "global").otherwise("none")}).drop("own", "every")


def apply(results: DataFrame, all_boosts: DataFrame, query_hash: str) -> DataFrame:
    """Results (id, score) by boosted score: the boost is held within 1 +- LIMIT."""
    rows = lookup(results, all_boosts, query_hash)
    held = F.greatest(F.lit(1 - LIMIT), F.least(F.lit(1 + LIMIT), F.col("boost")))
    rows = rows.withColumns({"boost": held, "boosted_score": v.rounded(F.col("score") * held)})
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("boosted_score"), "id")).cast("long"))  # a page of results


def top_for_query(all_boosts: DataFrame, query_hash: str, limit: int) -> DataFrame:
    rows = all_boosts.filter((F.col("query_hash") == query_hash) & (F.col("boost") > 1) & (F.col("confidence") >= 0.2))
    return rows.select("target_id", "boost", "confidence").orderBy(F.desc("boost"), "target_id").limit(limit)


def recommended(all_boosts: DataFrame, limit: int) -> DataFrame:
    """Global keys above 1 by boost times confidence."""
    rows = all_boosts.filter("query_hash = '' and boost > 1").withColumn("score", v.rounded(F.col("boost") * F.col("confidence")))
    return rows.select("target_id", "score").orderBy(F.desc("score"), "target_id").limit(limit)


def coclicks(feedback: DataFrame, least: int = 2) -> DataFrame:
    """source_id < target_id clicked together in at least `least` pieces of feedback, count, and boost min(2, 1 + count / 10).

    Pairs are made within one feedback, whose clicks are few, and counted on the map side first.
    """
    clicks = F.array_sort(F.coalesce("clicked_ids", F.array().cast("array<string>")))
    pairs = F.flatten(F.transform(clicks, lambda x, i: F.transform(F.slice(clicks, i + 2, F.greatest(F.lit(0), F.size(clicks) - i - 1)), lambda y: F.struct(x.alias("source_id"), y.alias("target_id")))))
    rows = feedback.filter(F.size("clicked_ids") >= 2).select(F.explode(pairs).alias("p")).groupBy("p.source_id", "p.target_id").agg(F.count("*").alias("n"))
    return rows.filter(F.col("n") >= least).withColumn("boost", F.least(F.lit(2.0), v.rounded(1.0 + F.lit(0.1) * F.col("n"))))


def query_stats(interactions: DataFrame, feedback: DataFrame, cap: int = 100) -> DataFrame:
    """query_hash, searches, positive, negative and clicked ids (first seen first, at most `cap`, which is the feature)."""
    searches = interactions.groupBy("query_hash").agg(F.count("*").alias("searches"))
    rows = feedback.join(interactions.select(F.col("id").alias("interaction_id"), "query_hash"), "interaction_id")
    sides = rows.groupBy("query_hash").agg(F.count_if(F.col("sentiment") > 0).alias("positive"), F.count_if(F.col("sentiment") < 0).alias("negative"))
    clicked = rows.select("query_hash", "ts", "id", F.posexplode("clicked_ids").alias("pos", "target")).groupBy("query_hash", "target").agg(F.min(F.struct("ts", "id", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_hash").orderBy("first", "target"))
    clicked = clicked.withColumn("r", rank).filter(F.col("r") <= cap).groupBy("query_hash").agg(F.sort_array(F.collect_list(F.struct("r", "target"))).alias("c"))
    joined = searches.join(sides, "query_hash", "left").join(clicked, "query_hash", "left")
    return joined.select("query_hash", "searches", F.coalesce("positive", F.lit(0)).alias("positive"), F.coalesce("negative", F.lit(0)).alias("negative"), F.coalesce(F.transform("c", lambda x: x["target"]), F.array().cast("array<string>")).alias("clicked_ids"))


def prune(interactions: DataFrame, feedback: DataFrame, all_boosts: DataFrame, now: Column, days: int = 90, most: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is kept of each table: interactions of the last days, of those the newest `most`; what hangs on them; global boosts."""
    live = interactions.filter(F.col("ts") >= now - F.make_interval(days=F.lit(days)))
    live = live.orderBy(F.desc("ts"), F.desc("id")).limit(most)
    kept = feedback.join(live.select(F.col("id").alias("interaction_id")), "interaction_id", "left_semi")
    hashes = live.select("query_hash").union(interactions.sparkSession.createDataFrame([("",)], "query_hash string")).distinct()
    return live, kept, all_boosts.join(hashes, "query_hash", "left_semi")


def recent(interactions: DataFrame, n: int) -> DataFrame:
    return interactions.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def stats(interactions: DataFrame, feedback: DataFrame, all_boosts: DataFrame) -> DataFrame:
    """One row of totals."""
    a = interactions.agg(F.count("*").alias("interactions"), F.countDistinct("query_hash").alias("query_patterns"))
    return a.crossJoin(feedback.agg(F.count("*").alias("feedback"))).crossJoin(all_boosts.agg(F.count("*").alias("boosts")))  # one row each
