"""Registered queries of the training-data operators, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, htmltext, jaccard, langid, licenses, media, packing, sharding, tokenfile
from .common import table
from .tokens import default_tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, stated or inherited from the nearest directory above it."""
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a reply tree, its best branch formatted and read back."""
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def chat_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as branching trees (turn t answers turn (t - 1) / 2): the two best branches of each by the length of their texts."""
    turns = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    messages = turns.select(F.col("conv_id").alias("tree"), F.col("turn").alias("node"), parent.alias("parent"), "role", "text")
    found = chat.format_trees(messages, F.length("text"), 2)
    return found.select(F.col("tree").alias("conv_id"), "leaf", F.col("rank").cast("long").alias("rank"), "score", "n_turns", F.sha2(F.col("formatted").cast("binary"), 256).alias("formatted_sha256"))


BRANCHES_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id AS tree, turn AS node, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, coalesce(length(text), 0)::DOUBLE AS s,
    '<s>[INST]' || regexp_replace(coalesce(role, ''), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') || '[/INST]' || regexp_replace(coalesce(text, ''), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') || '</s>' AS piece
  FROM conversations),
p(tree, node, score, n, path) AS (
  SELECT tree, node, s, 1, piece FROM m WHERE parent IS NULL
  UNION ALL SELECT m.tree, m.node, p.score + m.s, p.n + 1, p.path || m.piece FROM m JOIN p ON m.tree = p.tree AND m.parent = p.node)
SELECT tree AS conv_id, node AS leaf, row_number() OVER (PARTITION BY tree ORDER BY score DESC, n DESC, node) AS rank, score, n::BIGINT AS n_turns, sha256(path) AS formatted_sha256
FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tree = p.tree AND m.parent = p.node) QUALIFY rank <= 2
"""


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document: five-word shingles, similarity of 0.8 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 ids by multiway differencing."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), capacity=2048, end_id=1)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files with Elias-Fano boundaries and read back from them."""
    return tokenfile.token_files(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, as it is or with other numbers, names and units."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 2, F.lit(False))
    prototypes = langid.train(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.place_documents(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as 8-bit media, read back, sniffed and measured."""
    return media.store_and_read(table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
items AS (SELECT rep, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
undirected AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT rep, rep FROM classes UNION SELECT e.b, r.root FROM reach r JOIN undirected e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, CAST(coalesce(r.root, d.doc_id) AS BIGINT) AS component_id
FROM sets d LEFT JOIN classes c ON c.s = list_sort(d.s) LEFT JOIN roots r ON r.node = c.rep
"""


def queries() -> dict[str, Query]:
    found = (op1_licenses, op2_chat, op3_jaccard, op4_packing, op5_token_files, op6_html, op7_decontamination, op8_language_id, op9_sharding, op10_media)
    return {f.__name__: f for f in (*found, chat_branches)}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.ORACLE_SQL, "op2_chat": chat.ORACLE_SQL, "chat_branches": BRANCHES_SQL, "op3_jaccard": JACCARD_SQL, "op9_sharding": sharding.ORACLE_SQL}
