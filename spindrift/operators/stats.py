"""Collection, tenant, metadata, filter and cost statistics; audit and ranking helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v


def collection_stats(docs: DataFrame) -> DataFrame:
    """collection, total, deleted, active and fragmentation (per cent deleted)."""
    rows = docs.groupBy("collection").agg(F.count("*").alias("total"), F.count_if("deleted").alias("deleted"))
    return rows.select("collection", "total", "deleted", (F.col("total") - F.col("deleted")).alias("active"), v.rounded(F.lit(100.0) * F.col("deleted") / F.col("total")).alias("fragmentation"))


def needs_compaction(stats: DataFrame, percent: float = 20.0, deleted: int = 1000) -> DataFrame:
    return stats.withColumn("compact", (F.col("fragmentation") >= percent) | (F.col("deleted") >= deleted))


def tenant_stats(docs: DataFrame) -> DataFrame:
    """tenant_id, collection and live rows."""
    return docs.filter("not deleted").groupBy(F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"), "collection").agg(F.count("*").alias("active"))


def metadata_keys(docs: DataFrame, meta: str = "meta") -> DataFrame:
    return docs.select(F.explode(F.map_keys(meta)).alias("key")).distinct()


def metadata_values(docs: DataFrame, key: str, meta: str = "meta") -> DataFrame:
    return docs.select(F.try_element_at(meta, F.lit(key)).alias("value")).filter("value is not null").distinct()


def selectivity_band(share: Column) -> Column:
    return F.when(share <= 0.001, "highly_selective").when(share <= 0.01, "very_selective").when(share <= 0.1, "selective").when(share <= 0.5, "moderate").otherwise("broad")


def analyze_filter(docs: DataFrame, predicate: Column) -> DataFrame:
    """One row: matched, total, selectivity and its band."""
    rows = docs.agg(F.count_if(predicate).alias("matched"), F.count("*").alias("total"))
    share = F.coalesce(F.col("matched") / F.nullif("total", F.lit(0)), F.lit(0.0))
    return rows.select("matched", "total", v.rounded(share).alias("selectivity"), selectivity_band(share).alias("recommendation"))


def estimated_speedup(share: Column) -> Column:
    """How much a prefilter saves: the inverse of its share, held within 1 and 100."""
    return F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.lit(1.0) / F.greatest(share, F.lit(1e-9))))


def cost_totals(ops: DataFrame, day: Column | None = None) -> DataFrame:
    """One row: tokens, cost and operations, of one day or of all time; zero where there are none."""
    rows = ops.filter(F.to_date("ts") == day) if day is not None else ops
    return rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), v.rounded(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("cost"), F.count("*").alias("operations"))


def cost_daily(ops: DataFrame, days: int | None = None) -> DataFrame:
    """day, tokens, cost and operations, newest first; the last `days` if given."""
    rows = ops.groupBy(F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens"), v.rounded(F.sum("cost")).alias("cost"), F.count("*").alias("operations"))
    rows = rows.orderBy(F.desc("day"))
    return rows.limit(days) if days else rows


def with_cost(docs: DataFrame, per_thousand: float, text: str = "text") -> DataFrame:
    tokens = tx.token_estimate(F.col(text))
    return docs.withColumns({"tokens": tokens, "cost": tokens / F.lit(1000.0) * F.lit(per_thousand)})


def audit(events: DataFrame, start: Column | None = None, end: Column | None = None, subject: str | None = None, kinds: list[str] | None = None, min_severity: int | None = None, outcome: str | None = None, ip: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
    """Matching events, newest first, a page of them; and how many match."""
    rows = events
    for use, test in ((start, lambda: F.col("ts") >= start), (end, lambda: F.col("ts") <= end), (subject, lambda: F.col("subject") == subject), (kinds, lambda: F.col("type").isin(kinds)), (min_severity, lambda: F.col("severity") >= min_severity), (outcome, lambda: F.col("outcome") == outcome), (ip, lambda: F.col("ip") == ip)):
        rows = rows.filter(test()) if use is not None else rows
    return rows.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit), rows.count()


# -- id sets ------------------------------------------------------------------------------------------------------------


def set_and(sets: list[DataFrame]) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.intersect(s)
    return out


def set_or(sets: list[DataFrame]) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
