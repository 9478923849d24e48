"""Knowledge-graph extraction: chunk, extract, merge, count. Extractors are vectorised functions; none is built in but a rule for tests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph

#: Chunks of fewer bytes, trimmed, aren't worth a call.
LEAST_BYTES = 50
#: Chunks of a call of the extractor, whose graphs a worker holds at once.
CALL = 256
GRAPH = "struct<nodes:array<struct<id:string,name:string,type:string,description:string>>,edges:array<struct<src:string,dst:string,rel:string,weight:double>>>"


def capitalised(texts: pd.Series) -> pd.Series:
    """An offline extractor: runs of capitalised words are nodes, neighbours in a text are linked."""
    def one(t: str | None) -> dict:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z]\w+(?: [A-Z]\w+)*", t or "")))
        ids = [n.lower().replace(" ", "_") for n in names]
        return {"nodes": [{"id": i, "name": n, "type": "Entity", "description": ""} for i, n in zip(ids, names, strict=True)], "edges": [{"src": a, "dst": b, "rel": "NEAR", "weight": 1.0} for a, b in zip(ids, ids[1:], strict=False) if a != b]}

    return pd.DataFrame([one(t) for t in texts], columns=["nodes", "edges"])


def extract(docs: DataFrame, extractor: Callable[[pd.Series], pd.DataFrame] = capitalised, size: int = 2000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk number and graph of every chunk that is long enough."""
    chunks = tx.chunk(docs, size=size, overlap=overlap).filter(F.octet_length(F.trim("chunk")) >= LEAST_BYTES)
    nodes, edges = re.match(r"struct<nodes:(.*),edges:(.*)>$", GRAPH).groups()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), CALL):
                part = f[at : at + CALL].reset_index(drop=True)
                yield pd.concat([part[["doc_id", "index"]], extractor(part["chunk"])[["nodes", "edges"]]], axis=1)

    made = chunks.select("doc_id", "index", "chunk").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, index int, nodes {nodes}, edges {edges}")
    return made.select("doc_id", "index", F.struct("nodes", "edges").alias("graph"))


def tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of extracted chunks: within a document an id keeps its first chunk's name and its longest description, an edge occurs once."""
    nodes = extracted.select("doc_id", "index", F.explode("graph.nodes").alias("n")).select("doc_id", "index", "n.*")
    first = F.min(F.struct("index", "name", "type")).alias("f")
    longest = F.min(F.struct((-F.length(F.coalesce("description", F.lit("")))).alias("less"), "index", "description")).alias("d")
    nodes = nodes.groupBy("doc_id", "id").agg(first, longest).select("doc_id", "id", "f.name", "f.type", "d.description")
    edges = extracted.select("doc_id", "index", F.explode("graph.edges").alias("e")).select("doc_id", "index", "e.*")
    edges = edges.groupBy("doc_id", "src", "dst", "rel").agg(F.min(F.struct("index", "weight")).alias("f")).select("doc_id", "src", "dst", "rel", F.col("f.weight").alias("weight"))
    return nodes, graph.valid_edges(edges, nodes).select("doc_id", "src", "dst", "rel", "weight")


def stats(extracted: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id with its chunks, nodes and edges before and after the merge."""
    raw = extracted.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.size("graph.nodes")).alias("raw_nodes"), F.sum(F.size("graph.edges")).alias("raw_edges"))
    a = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"))
    b = edges.groupBy("doc_id").agg(F.count("*").alias("edges"))
    return raw.join(a, "doc_id", "left").join(b, "doc_id", "left").fillna(0, ["nodes", "edges"])


def cognify(docs: DataFrame, extractor: Callable[[pd.Series], pd.DataFrame] = capitalised, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and statistics of documents in one call."""
    found = extract(docs, extractor, **options)
    nodes, edges = tables(found)
    return nodes, edges, stats(found, nodes, edges)


def from_glyph(texts: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and events of tabular model answers; edges to unknown nodes are dropped."""
    rows = tx.parse_glyph(texts, key, text)
    cell = lambda n: F.try_element_at("cells", F.lit(n))
    nodes = rows.filter("section = 'Node'").select(key, cell("id").alias("id"), cell("name").alias("name"), cell("type").alias("type"), cell("description").alias("description"))
    edges = rows.filter("section = 'Edge'").select(key, F.coalesce(cell("src"), cell("source")).alias("src"), F.coalesce(cell("dst"), cell("target")).alias("dst"), F.coalesce(cell("rel"), cell("relation")).alias("rel"))
    known = nodes.select(key, F.col("id"))
    edges = edges.join(known.withColumnRenamed("id", "src"), [key, "src"], "left_semi").join(known.withColumnRenamed("id", "dst"), [key, "dst"], "left_semi")
    events = rows.filter("section = 'Event'").select(key, cell("id").alias("id"), cell("description").alias("description"), F.try_to_timestamp(cell("date")).alias("date"), cell("year").try_cast("int").alias("year"), F.filter(F.split(F.regexp_replace(F.coalesce(cell("entities"), F.lit("")), r"[\[\]]", ""), r"[\s,]+"), lambda x: x != "").alias("entities"))
    return nodes, edges, events
