"""A training corpus in four stages: language ID, near-duplicates, benchmark decontamination, packing.

Each stage takes all rows that the one before kept, as written and read again; all but the last return the columns of
documents. The stages call the operators of spindrift.llm with their production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontam, jaccard, langid, packing
from spindrift.llm.common import Scratch, few_files, table
from spindrift.llm.tokens import default_tokenizer


#: Ids that are broadcast at most (8 bytes each, some 100 MB as a hash table on an executor).
BROADCAST_IDS = 2_000_000


def unused(docs: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: those without a letter, or unlike every language, go.

    Unlike is a best cosine below langid.REJECT_BELOW. Texts of fewer than langid.CERTAIN letters are too short to tell
    and stay. Where no row has a lang, nothing is known of languages and only documents without a letter go. Null and
    empty texts have no letter and go; null ids, ties and repeated rows go by their text as any other.
    """
    prototypes = langid.train(docs)
    if prototypes.isEmpty():
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    pred, score = unused(docs, "_lang_pred"), unused(docs, "_score")
    found = langid.identify(docs, prototypes, (pred, score))
    short = F.length(F.regexp_replace("text", r"\P{L}+", "")) < langid.CERTAIN
    known = (F.col(score) >= langid.REJECT_BELOW) | short
    return few_files(found.filter((F.col(pred) != "und") & known).select(*docs.columns), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one of the smallest doc_id.

    Of rows that repeat a doc_id one stays (any of them), rows without a doc_id all do, and so do documents without a
    word, as they are near-duplicates of nothing.
    """
    found = jaccard.jaccard_components(docs)
    ids = found.filter("doc_id = component_id").select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:  # texts are not shuffled
        first, given = unused(docs, "_first"), F.col(unused(docs, "_id"))
        ids = F.broadcast(ids.select(F.col("doc_id").alias(unused(docs, "_id")), F.lit(True).alias(first)))
        kept = docs.join(ids, docs["doc_id"] == given, "left").filter(docs["doc_id"].isNull() | F.col(first)).select(*[docs[c] for c in docs.columns])
    else:
        kept = docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))
    if not found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
    return few_files(kept, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other values; each row goes by its text alone (nulls and empty texts stay)."""
    return few_files(decontam.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, in sequences of at most 2048 ids (null and empty texts as the end id alone, repeated rows each)."""
    return few_files(packing.pack_documents(docs, default_tokenizer(), capacity=2048, end_id=1), docs)


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]
#: Prototypes of random vectors and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        after = scratch.table(stage(spark, docs, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"), "pipeline")
        scratch.drop(docs)
        docs = after
    return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
