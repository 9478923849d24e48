r"""Chat formatting of reply trees.

Messages form trees by their parent. Pointer-doubling self-joins give every message its root, depth and the sum of the
scores above it in as many rounds as the logarithm of the depth; a tree's branches (leaves) are ranked by that sum. Only
the chosen leaves' paths are then enumerated, by joins with the pointers of each round, so that no message ever holds a
path and what is made grows with n log n. The texts take part in one join and one grouping. Each chosen path is
formatted as one conversation:

    <s>[INST]role[/INST]text</s> for each turn, one turn after another

Control strings in roles and texts get one more backslash behind their first character (`</s>` is `<\/s>`, `<\/s>` is
`<\\/s>`), which is undone by taking one away, so that no text can open or close a turn and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

_TAIL = r"(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """Text (null: empty) without control strings."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def threads(messages: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees (tree, node, parent, role, text): each row answers the one before.

    Rows go by turn, null first, ties by role and text. Rows with a null conv_id make up one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return messages.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text").select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def key_of(tree: Column) -> Column:
    """The tree's name as text, one to one and never null, so that joins on it are plain equalities."""
    return F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit(""))


def _climb(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(t, node, score, depth) of every message under a root, sums over its path, and the pointers (t, node, top) of 1, 2, 4, ... steps up.

    nodes has t, node, parent and value, one row each. Messages that never reach a root lie on or below a cycle; they
    are told by the steps, which outnumber the messages of the largest tree, and are left out.
    """
    known = nodes.select(F.col("t").alias("t_"), F.col("node").alias("n_"))
    start = nodes.join(known, (F.col("t") == F.col("t_")) & (F.col("parent") == F.col("n_")), "left")
    now = scratch.table(start.select("t", "node", F.col("n_").alias("top"), F.col("value").alias("score"), F.lit(1).cast("long").alias("depth")), "op2-pointers")
    largest = now.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    jumps, steps = [], 1
    while steps <= largest and not now.filter("top is not null").isEmpty():
        jumps.append(now.filter("top is not null").select("t", "node", "top"))
        above = now.select(F.col("t").alias("t_"), F.col("node").alias("n_"), F.col("top").alias("next"), F.col("score").alias("more"), F.col("depth").alias("far"))
        far = now.filter("top is not null").join(above, (F.col("t") == F.col("t_")) & (F.col("top") == F.col("n_")))
        far = far.select("t", "node", F.col("next").alias("top"), (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("far")).alias("depth"))
        now = scratch.table(now.filter("top is null").unionByName(far), "op2-pointers")
        steps *= 2
    return now.filter("top is null").drop("top"), jumps


def branches_of(messages: DataFrame, score: Column | None, branches: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(t, leaf, rank, score, n_turns) of the chosen leaves, and (t, leaf, node, up) of the messages on their paths, up steps above the leaf.

    A parent that is null or not in the tree makes a root. Messages on a cycle have no root and no path; a node given
    twice counts once, with its least parent and score.
    """
    value = F.coalesce(score.cast("double"), F.lit(0.0)) if score is not None else F.lit(0.0)
    nodes = messages.select(key_of(F.col("tree")).alias("t"), "node", "parent", value.alias("value")).filter("node is not null")
    nodes = nodes.groupBy("t", "node").agg(F.min("parent").alias("parent"), F.min("value").alias("value"))
    nodes = scratch.table(nodes, "op2-nodes")
    found, jumps = _climb(nodes, scratch)
    inner = nodes.filter("parent is not null").select("t", F.col("parent").alias("node")).distinct()
    leaves = found.join(inner, ["t", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), F.desc("depth"), "node"))
    chosen = leaves.withColumn("rank", rank).filter(F.col("rank") <= branches)
    chosen = scratch.table(chosen.select("t", F.col("node").alias("leaf"), "rank", "score", F.col("depth").alias("n_turns")), "op2-chosen")
    steps = chosen.select("t", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        further = steps.join(jump, ["t", "node"]).select("t", "leaf", F.col("top").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        after = scratch.table(steps.unionByName(further), "op2-steps")
        if k:
            scratch.drop(steps)
        steps = after
    return chosen, steps


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf and path (nodes from the root) of every root-to-leaf path (see branches_of for roots, cycles and repeats)."""
    scratch = Scratch(messages.sparkSession)
    _, steps = branches_of(messages, None, 1 << 30, scratch)
    names = messages.select("tree", key_of(F.col("tree")).alias("t")).distinct()
    path = F.transform(F.sort_array(F.collect_list(F.struct(-F.col("up"), F.col("node").alias("node")))), lambda x: x["node"])
    return scratch.keep(steps.groupBy("t", "leaf").agg(path.alias("path")).join(names, "t").select("tree", "leaf", "path"), "op2-paths")


def format_trees(messages: DataFrame, score: Column | None = None, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, score, n_turns, formatted and loss_spans (start, from 1, and length of each assistant text in the UTF-8 bytes of `formatted`).

    messages needs tree, node, parent, role and text; other columns are ignored (but by `score`). A branch scores the
    sum of its messages' scores (none: 0, null: 0); ties go to the longer, then to the leaf of the smallest number.
    Null roles and texts are empty, a message without a node is none; of a node given twice the first role and text in
    order stand. A null tree is a tree. No message, no row. The result is a table in the shared folder.
    """
    scratch = Scratch(messages.sparkSession)
    chosen, steps = branches_of(messages, score, branches, scratch)
    turns = messages.select(key_of(F.col("tree")).alias("t"), "tree", "node", F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    turns = steps.join(turns, ["t", "node"]).groupBy("t", "leaf", "node", "up").agg(F.min(F.struct("m", "tree")).alias("x"))
    head = F.concat(F.lit("<s>[INST]"), escape(F.col("x.m.role")), F.lit("[/INST]"))
    turns = turns.select("t", "leaf", (-F.col("up")).alias("place"), "x.tree", head.alias("head"), escape(F.col("x.m.text")).alias("body"), (F.col("x.m.role") == "assistant").alias("loss"))
    before = Window.partitionBy("t", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    length = F.octet_length("head") + F.octet_length("body") + 4
    start = F.coalesce(F.sum(length.cast("long")).over(before), F.lit(0)) + F.octet_length("head") + 1
    piece = F.struct("place", F.concat("head", "body", F.lit("</s>")).alias("piece"), F.when(F.col("loss"), F.struct(F.col("start"), F.octet_length("body").alias("length"))).alias("span"))
    branch = turns.withColumn("start", start).groupBy("t", "leaf").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    spans = F.filter(F.transform("pieces", lambda x: x["span"]), lambda x: x.isNotNull())
    branch = branch.select("t", "leaf", "tree", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))
    return scratch.keep(branch.join(chosen, ["t", "leaf"]).select("tree", "leaf", "rank", "score", "n_turns", "formatted", "loss_spans"), "op2-formatted")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, taken from `formatted` and `loss_spans` alone."""
    pieces = F.filter(F.split("formatted", "</s>"), lambda x: x != "")
    part = lambda x, n: unescape(F.regexp_extract(x, r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$", n))
    turns = F.transform(pieces, lambda x: F.concat(part(x, 1), F.lit("\n"), part(x, 2), F.lit("\n")))
    # the bytes are bound once, so that each span is a slice
    part_of = lambda b: F.transform("loss_spans", lambda s: unescape(F.substring(b, s["start"].cast("int"), s["length"].cast("int")).cast("string")))
    loss = F.array_join(F.flatten(F.transform(F.array(F.col("formatted").cast("binary")), part_of)), "")
    return formatted.select(
        "tree",
        F.size(pieces).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The contract's digests of every conversation and of conversation -1, whose texts are control strings."""
    spark = conversations.sparkSession
    control = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return read_back(format_trees(threads(rows))).withColumnRenamed("tree", "conv_id")


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(20 + length(role) + length(text)
    + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
