"""Knowledge graphs as node and edge tables: merge, validity, seeds, PageRank, document scores, communities.

Nodes are (doc_id, id, name, type, description), edges (doc_id, src, dst, rel, weight). Iterations cut their lineage with
checkpoint() in the cluster's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..session import shared_dir
from .collection import numbered


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder (spark.checkpoint.dir; one of our own only where that is unset)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    held = df.persist()  # a checkpoint runs its plan twice
    done = held.checkpoint()
    held.unpersist()
    return done


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id: the longest description (of equals the first document's) and the first document's name and type."""
    first = F.min(F.struct("doc_id", "name", "type"))
    longest = F.min(F.struct((-F.length(F.coalesce("description", F.lit("")))).alias("less"), "doc_id", "description"))
    return nodes.groupBy("id").agg(first.alias("f"), longest.alias("d"), F.countDistinct("doc_id").alias("documents")).select("id", "f.name", "f.type", "d.description", "documents")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, rel): the first document's weight."""
    return edges.groupBy("src", "dst", "rel").agg(F.min(F.struct("doc_id", "weight")).alias("f"), F.count("*").alias("times")).select("src", "dst", "rel", F.col("f.weight").alias("weight"), "times")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    known = nodes.select("id").distinct()
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes without an id, edges without an end, edges to unknown nodes."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad = edges.agg(F.count_if(empty("src") | empty("dst")).alias("edges_without_end"))
    unknown = edges.exceptAll(valid_edges(edges, nodes).select(edges.columns)).agg(F.count("*").alias("edges_to_unknown"))
    return nodes.agg(F.count_if(empty("id")).alias("nodes_without_id")).crossJoin(bad).crossJoin(unknown)  # one row each


def upsert_document(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A document's graph replaces what it had; edges stay if both ends are known in any document."""
    docs = new_nodes.select("doc_id").distinct()
    kept_nodes = nodes.join(docs, "doc_id", "left_anti").unionByName(new_nodes)
    kept_edges = edges.join(docs, "doc_id", "left_anti").unionByName(new_edges)
    return kept_nodes, valid_edges(kept_edges, nodes.select("id").union(new_nodes.select("id")))


def remove_documents(nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' memberships and edges go; node ids that others hold stay."""
    return nodes.join(docs, "doc_id", "left_anti"), edges.join(docs, "doc_id", "left_anti")


def seeds(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """Ids of nodes whose name or id holds a term of two bytes or more, whatever the case."""
    wanted = [t.lower() for t in terms if len(t.encode()) >= 2]
    if not wanted:
        return nodes.select("id").limit(0)
    hit: Column = F.lit(False)
    for t in wanted:
        hit = hit | F.lower("name").contains(t) | F.lower("id").contains(t)
    return nodes.filter(hit).select("id").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, seeds: DataFrame | None = None, tolerance: float = 1e-6, cut_every: int = 3) -> DataFrame:
    """id, rank: (1 - d) t + d (what in-links bring + t * what dangling nodes hold), parallel edges counted.

    The teleport t is uniform, or over the seeds (personalised). Stops early once no rank moves by the tolerance.
    Ranks of one round are joined with out-links by id; sums are combined on the map side before the shuffle. A round
    names the one before twice, so plans double until they are cut.
    """
    ids = nodes.select("id").distinct().persist()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    marked = ids.join(seeds.select("id", F.lit(1.0).alias("s")), "id", "left") if seeds is not None else ids.withColumn("s", F.lit(1.0))
    total = marked.agg(F.sum("s")).first()[0]
    if not total:  # no seed: as if none were asked for
        marked, total = ids.withColumn("s", F.lit(1.0)), float(n)
    base = marked.select("id", (F.coalesce("s", F.lit(0.0)) / F.lit(float(total))).alias("t"))
    links = valid_edges(edges.select("src", "dst"), ids).groupBy("src", "dst").agg(F.count("*").alias("times"))
    out = links.groupBy("src").agg(F.sum("times").alias("out"))
    # links and ranks are kept dealt by the same key, so a round shuffles the partial sums of in-links and nothing else
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = cut(links.join(out, "src").select("src", "dst", (F.col("times") / F.col("out")).alias("share"))).repartition(parts, "src").persist()
    base = cut(base.join(out.select(F.col("src").alias("id"), "out"), "id", "left").select("id", "t", F.col("out").isNull().alias("dangling")))
    ranks = base.select("id", "t", "dangling", F.col("t").alias("rank"), F.lit(None).cast("double").alias("before")).repartition(parts, "id").persist()
    kept = [ranks]
    for i in range(rounds):
        lost = ranks.filter("dangling").agg(F.sum("rank")).first()[0] or 0.0
        sums = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        moved = F.lit(1 - damping) * F.col("t") + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("t") * F.lit(float(lost)))
        ranks = ranks.join(sums, "id", "left").select("id", "t", "dangling", moved.alias("rank"), F.col("rank").alias("before"))
        # rounds are kept in the executors; a lost part is computed anew from the last checkpoint
        solid = cut(ranks) if i % cut_every == cut_every - 1 or i == rounds - 1 else None
        ranks = (ranks if solid is None else solid.repartition(parts, "id")).persist()
        kept.append(ranks)
        if len(kept) > 2:
            kept.pop(0).unpersist()
        if i % cut_every == cut_every - 1 and (ranks.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0) < tolerance:
            break
    for held in (ids, links, *kept):
        held.unpersist()
    return (solid if rounds else base.withColumn("rank", F.col("t"))).select("id", "rank")


def document_scores(nodes: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """doc_id, score and rank: the sum of the ranks of a document's nodes, the best k."""
    scores = nodes.select("doc_id", "id").distinct().join(ranks.withColumnRenamed("rank", "r"), "id").groupBy("doc_id").agg(v.rounded(F.sum("r")).alias("score"))
    top = scores.orderBy(F.desc("score"), "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))


def graph_search(nodes: DataFrame, edges: DataFrame, terms: list[str], k: int, rounds: int = 20) -> DataFrame:
    """Documents by personalised PageRank from the nodes the terms match, by global PageRank where they match none."""
    return document_scores(nodes, pagerank(nodes, edges, rounds, seeds=seeds(nodes, terms)), k)


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community by label propagation: each node takes the label with the most weight among its neighbours and its own.

    Ties go to the smallest label; a node without neighbours is its own community. Deterministic, with a bounded number of rounds.
    """
    labels = nodes.select("id").distinct().withColumn("community", F.col("id"))
    both = edges.filter("src <> dst").select("src", "dst")
    both = cut(valid_edges(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), labels).groupBy("src", "dst").agg(F.count("*").alias("w")))
    state = None
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("src"), "community"), "src").select(F.col("dst").alias("id"), "community", "w")
        votes = votes.unionByName(labels.withColumn("w", F.lit(1).cast("long"))).groupBy("id", "community").agg(F.sum("w").alias("w"))
        labels = cut(votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("less"), "community")).alias("m")).select("id", "m.community"))
        now = labels.agg(F.sum(F.xxhash64("id", "community").cast("decimal(38,0)"))).first()[0]
        if now == state:
            break
        state = now
    return labels


def document_communities(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, community by majority of the document's nodes; ties go to the smallest."""
    votes = nodes.select("doc_id", "id").distinct().join(labels, "id").groupBy("doc_id", "community").agg(F.count("*").alias("n"))
    return votes.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "community")).alias("m")).select("doc_id", "m.community")


def boost_edges(edges: DataFrame, boosts: DataFrame) -> DataFrame:
    """Edges plus max(1, floor(boost)) more from source_id to target_id for each boost."""
    times = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor("boost").cast("int")))
    more = boosts.select(F.lit(None).cast("long").alias("doc_id"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.lit("FEEDBACK").alias("rel"), F.col("boost").cast("double").alias("weight"), F.explode(times).alias("_")).drop("_")
    return edges.select("doc_id", "src", "dst", "rel", F.col("weight").cast("double").alias("weight")).unionByName(more)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    a = nodes.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("id").alias("nodes"))
    return a.crossJoin(edges.agg(F.count("*").alias("edges"), F.countDistinct("rel").alias("relations")))  # one row each


def nodes_by_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("type") == kind)


def edges_from(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("src") == node)


def edges_to(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("dst") == node)


def csr(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, first (offset of its neighbours) and neighbours, in id order: compressed rows of the adjacency matrix.

    Offsets come from one edge list numbered in (src, dst) order, range by range, so no task holds the graph; a row's
    neighbours are one cell, as the form asks for.
    """
    known = nodes.select("id").distinct()
    rows = numbered(edges.select("src", "dst").join(known.withColumnRenamed("id", "src"), "src", "left_semi"), ["src", "dst"])
    near = rows.groupBy(F.col("src").alias("id")).agg(F.min("n").alias("first"), F.sort_array(F.collect_list("dst")).alias("neighbours"))
    # a node without edges starts where the next one with edges does: ids and edge ends are numbered together
    marks = known.withColumn("dst", F.lit(None).cast("string")).unionByName(rows.select(F.col("src").alias("id"), "dst"))
    places = numbered(marks, ["id", "dst"], "at").filter("dst is null")
    ranks = numbered(known, ["id"], "rank")
    starts = places.join(ranks, "id").select("id", (F.col("at") - F.col("rank")).alias("start"))
    out = starts.join(near, "id", "left")
    return out.select("id", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"), F.coalesce("first", "start").alias("first"))
