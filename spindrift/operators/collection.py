"""Collections as Parquet tables: schema catalog, validation, inserts and upserts, tombstones, change-log folds, migration.

A collection is a folder of immutable files and numbered commits. A change writes its own rows alone (added, replaced or
deleted ones) and then the commit of the next number, which fails if another writer has made it; readers fold the changes
since the last compaction, so they always see a whole table. The catalog is a small JSON file for each collection.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

NAME = re.compile(r"^[A-Za-z0-9_-]{1,64}$")
MAX_DIM, MAX_BATCH, MAX_KEYS, MAX_VALUE = 65_536, 10_000, 100, 10_000


@dataclass
class VectorField:
    """A dense field has a dimension and any index but `inverted`; a sparse one is inverted."""

    name: str
    dim: int
    type: str = "dense"
    index: str = "hnsw"
    params: dict = field(default_factory=dict)

    def validate(self) -> None:
        if not self.name or not 0 < self.dim <= MAX_DIM:
            raise ValueError("a field needs a name and a dimension")
        if self.type not in ("dense", "sparse") or (self.type == "sparse") != (self.index == "inverted"):
            raise ValueError("dense fields can't be inverted, sparse ones have to be; no other type is supported")


@dataclass
class Schema:
    name: str
    fields: list[VectorField]
    metadata: dict = field(default_factory=dict)

    def validate(self) -> None:
        if not NAME.match(self.name) or not self.fields or len({f.name for f in self.fields}) != len(self.fields):
            raise ValueError("a collection needs a proper name and distinct fields")
        for f in self.fields:
            f.validate()

    def ddl(self) -> str:
        kinds = {"dense": "array<float>", "sparse": "struct<indices:array<int>,values:array<float>,dim:int>"}
        return ", ".join(["id bigint", *(f"`{f.name}` {kinds[f.type]}" for f in self.fields), "metadata string"])


def invalid_rows(docs: DataFrame, schema: Schema) -> DataFrame:
    """Rows a collection doesn't take, with the reason."""
    reason: Column = F.when(F.col("id").isNull() | (F.col("id") == 0), "id")
    for f in schema.fields:
        c = F.col(f.name)
        if f.type == "dense":
            values = c.cast("array<double>")
            bad = c.isNull() | (F.size(c) != f.dim) | F.exists(values, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
        else:
            from ..functions.vectors import sparse_valid

            bad = c.isNull() | (c["dim"] != f.dim) | ~sparse_valid(c)
        reason = reason.when(F.coalesce(bad, F.lit(True)), f.name)
    return docs.withColumn("reason", reason).filter("reason is not null")


def latest(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Last writer wins: one row per key, the one of the highest order."""
    columns = [c for c in log.columns if c not in (key, order)]
    best = log.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("m"))  # maps have no order, so by seq alone
    return best.select(key, *[F.col(f"m.{c}").alias(c) for c in (order, *columns)])


def fold_changes(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The rows that a log of insert, upsert and delete leaves; an upsert keeps the first seq of its key's life (as `first_seq`).

    One aggregation: the last operation by seq, the last delete, and the first write after it.
    """
    other = [c for c in log.columns if c not in (key, order, "op")]
    last = log.groupBy(key).agg(F.max_by(F.struct("op", *other), order).alias("m"), F.max(order).alias(order), F.max(F.when(F.col("op") == "delete", F.col(order))).alias("gone"), F.sort_array(F.collect_list(F.when(F.col("op") != "delete", F.col(order)))).alias("writes"))
    alive = last.filter(F.col("m.op") != "delete")
    first = F.element_at(F.filter("writes", lambda s: s > F.coalesce("gone", F.lit(-1).cast("long"))), 1)
    return alive.select(key, order, first.alias("first_seq"), *[F.col(f"m.{c}").alias(c) for c in other])


def without(docs: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    return docs.join(tombstones.select(key), key, "left_anti")


def upsert(docs: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """docs with new rows in place of those of the same keys."""
    return docs.join(new.select(key), key, "left_anti").unionByName(new)


def move(docs: DataFrame, ids: DataFrame, to: str, source: str | None = None, key: str = "id") -> DataFrame:
    """docs with the listed rows (of collection `source`) in collection `to`; ids that aren't there change nothing."""
    marked = docs.join(ids.select(key).distinct().withColumn("_move", F.lit(True)), key, "left")
    hit = F.coalesce("_move", F.lit(False)) & (F.col("collection") == source if source else F.lit(True))
    return marked.withColumn("collection", F.when(hit, to).otherwise(F.col("collection"))).drop("_move")


def update_metadata(docs: DataFrame, changes: dict[str, str], where: Column | None = None, meta: str = "meta") -> DataFrame:
    """Keys added or replaced in a string map."""
    added = F.create_map(*[F.lit(x) for pair in changes.items() for x in pair])
    kept = F.map_filter(meta, lambda k, _: ~k.isin(list(changes)))
    return docs.withColumn(meta, F.when(where if where is not None else F.lit(True), F.map_concat(kept, added)).otherwise(F.col(meta)))


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with each row's place (from 0) in the given order: ranges are sorted and numbered side by side, and moved by the sizes of those before.

    Ranges are written once, so that sizes are of the very ranges that are moved: in two plans, other samples cut them and adaptive
    execution joins up others.
    """
    path = scratch_path(df.sparkSession, "ranges")
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    parts.write.parquet(path)
    # the id holds the partition above bit 33 and the row in it below
    kept = df.sparkSession.read.schema(parts.schema).parquet(path)
    rows = kept.withColumns({"_p": F.shiftright("_at", 33), "_r": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    bases = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row per range
    return rows.join(F.broadcast(bases), "_p").withColumn(name, (F.col("_b") + F.col("_r")).cast("long")).drop("_p", "_r", "_b")


def assign_ids(new: DataFrame, next_id: int, order: list[str]) -> DataFrame:
    """Rows with consecutive ids from next_id in the given order."""
    return numbered(new, order, "id").withColumn("id", F.col("id") + F.lit(next_id))


class Conflict(ValueError):
    """Another writer has made the commit."""


class Manager:
    """Collections of tenants under one folder."""

    def __init__(self, spark: SparkSession, root: str, tenant: str = "default"):
        self.spark, self.root, self.tenant = spark, root.rstrip("/"), tenant

    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, self.tenant, *parts]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, *parts: str) -> str | None:
        p, fs = self._path(*parts)
        if not fs.exists(p):
            return None
        return self.spark.read.option("wholetext", True).text(p.toString()).first()[0]

    def _write(self, text: str, *parts: str) -> None:
        p, fs = self._path(*parts)
        stream = fs.create(p, True)
        stream.write(text.encode())
        stream.close()

    def list(self) -> list[str]:
        p, fs = self._path()
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def create(self, schema: Schema) -> None:
        schema.validate()
        if self._read(schema.name, "schema.json"):
            raise ValueError(f"collection {schema.name} exists")
        self._write(json.dumps(asdict(schema)), schema.name, "schema.json")
        self._commit(schema.name, self.spark.createDataFrame([], schema.ddl()), 0)

    def schema(self, name: str) -> Schema:
        held = json.loads(self._read(name, "schema.json") or "null")
        if held is None:
            raise KeyError(name)
        return Schema(held["name"], [VectorField(**f) for f in held["fields"]], held["metadata"])

    def has(self, name: str) -> bool:
        return self._read(name, "schema.json") is not None

    def drop(self, name: str) -> None:
        p, fs = self._path(name)
        fs.delete(p, True)

    def drop_all(self) -> None:
        for name in self.list():
            self.drop(name)

    def rename(self, old: str, new: str) -> None:
        if not NAME.match(new) or self.has(new):
            raise ValueError(new)
        schema = self.schema(old)
        schema.name = new
        (p, fs), (q, _) = self._path(old), self._path(new)
        fs.rename(p, q)
        self._write(json.dumps(asdict(schema)), new, "schema.json")

    def update_metadata(self, name: str, metadata: dict) -> None:
        schema = self.schema(name)
        schema.metadata |= metadata
        self._write(json.dumps(asdict(schema)), name, "schema.json")

    def _commits(self, name: str) -> list[int]:
        p, fs = self._path(name, "commits")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def version(self, name: str) -> int:
        return max(self._commits(name), default=0)

    def _commit(self, name: str, df: DataFrame, version: int, kind: str = "base") -> None:
        """Rows of a change (kind: base, add, change), then its commit, which only one writer can make."""
        folder = f"v{version}-{uuid.uuid4().hex[:12]}"
        deleted = F.lit(False) if "_deleted" not in df.columns else F.col("_deleted")
        df.withColumn("_deleted", deleted).write.parquet(self._path(name, folder)[0].toString())
        p, fs = self._path(name, "commits", str(version))
        fs.mkdirs(p.getParent())
        try:
            stream = fs.create(p, False)  # never over another one
        except Exception as e:  # noqa: BLE001  (file systems raise what they like)
            fs.delete(self._path(name, folder)[0], True)
            raise Conflict(f"version {version} of {name} exists") from e
        stream.write(json.dumps({"folder": folder, "kind": kind}).encode())
        stream.close()

    def _history(self, name: str, version: int | None) -> list[tuple[int, dict]]:
        """Commits from the last base up to a version."""
        kept = [n for n in self._commits(name) if version is None or n <= version]
        out: list[tuple[int, dict]] = []
        for n in reversed(kept):
            out.insert(0, (n, json.loads(self._read(name, "commits", str(n)))))
            if out[0][1]["kind"] == "base":
                return out
        raise KeyError(f"{name} has no version {version}")

    def docs(self, name: str, version: int | None = None) -> DataFrame:
        """The current (or an older) version of a collection: of an id that a change names, the rows of its last change."""
        history = self._history(name, version)
        ddl = self.schema(name).ddl()
        parts = [self.spark.read.schema(ddl + ", _deleted boolean").parquet(self._path(name, h["folder"])[0].toString()).withColumn("_v", F.lit(n)) for n, h in history]
        rows = reduce(DataFrame.unionByName, parts)
        changed = [p.select("id", "_v") for p, (_, h) in zip(parts, history, strict=True) if h["kind"] == "change"]
        if changed:  # additions alone need no join
            last = reduce(DataFrame.unionByName, changed).groupBy("id").agg(F.max("_v").alias("_last"))
            rows = rows.join(last, "id", "left").filter(F.col("_last").isNull() | (F.col("_v") >= F.col("_last"))).filter(~F.col("_deleted"))
        return rows.select([c for c in parts[0].columns if c not in ("_deleted", "_v")])

    def add(self, name: str, new: DataFrame, order: list[str] | None = None) -> None:
        """Append rows; without an id they get the next ones, in the given order. All rows are validated first, none is added otherwise."""
        schema, docs, version = self.schema(name), self.docs(name), self.version(name)
        if "id" not in new.columns:
            new = assign_ids(new, (docs.agg(F.max("id")).first()[0] or 0) + 1, order or new.columns[:1])
        bad = invalid_rows(new, schema).select("id", "reason").limit(1).collect()
        if bad:
            raise ValueError(f"row {bad[0].id}: {bad[0].reason}")
        self._commit(name, new.select(docs.columns), version + 1, "add")

    def upsert(self, name: str, new: DataFrame) -> None:
        """Rows replace those of the same id (bulk insert does so, too); only they are written."""
        version = self.version(name)
        self._commit(name, new.select(self.docs(name).columns), version + 1, "change")

    def delete(self, name: str, ids: DataFrame) -> None:
        """Tombstones for the ids; only they are written."""
        version, docs = self.version(name), self.docs(name)
        gone = ids.select(F.col("id").cast("long").alias("id")).distinct()
        blank = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c != "id"]
        self._commit(name, gone.select("id", *blank, F.lit(True).alias("_deleted")), version + 1, "change")

    def compact(self, name: str, keep: int = 1) -> list[str]:
        """Write the current version as a base of its own (same number, same rows) and drop all versions but the last `keep`; the names of what went."""
        commits = self._commits(name)
        number, held = self._history(name, None)[-1]
        if held["kind"] != "base":
            folder = f"v{number}-{uuid.uuid4().hex[:12]}"
            self.docs(name).withColumn("_deleted", F.lit(False)).write.parquet(self._path(name, folder)[0].toString())
            self._write(json.dumps({"folder": folder, "kind": "base"}), name, "commits", str(number))
        # an older version that is kept needs its own base and all from there on
        first = self._history(name, commits[-min(keep, len(commits))])[0][0]
        (p, fs), gone = self._path(name), []
        for n in [n for n in self._commits(name) if n < first]:
            fs.delete(self._path(name, json.loads(self._read(name, "commits", str(n)))["folder"])[0], True)
            fs.delete(self._path(name, "commits", str(n))[0], True)
            gone.append(f"v{n}")
        if held["kind"] != "base":
            fs.delete(self._path(name, held["folder"])[0], True)
        return gone

    def stats(self) -> DataFrame:
        parts = [self.docs(n).agg(F.lit(n).alias("collection"), F.count("*").alias("documents")) for n in self.list()]
        out = parts[0] if parts else self.spark.createDataFrame([], "collection string, documents bigint")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def tenants(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
