"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (an offset and a skip taken from hashes of
its name); shards take turns, each claiming the first free slot it prefers, until the table is full. A key's slot is its
hash modulo the table's size, so a broadcast of the table, whose size is a parameter, places any key in constant time,
shards differ by one slot at most, and adding or removing a shard moves little else.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 32
#: Prime number of slots, over a hundred for each shard.
SLOTS = 4093


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (by number) that owns each slot. slots is prime, or preference orders would not reach all slots."""
    if not shards or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("needs a shard and a prime number of slots")
    at = [_hash(f"offset:{s}") % slots for s in shards]
    step = [_hash(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, claimed = [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            claimed += 1
            if claimed == slots:
                return table


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard), from literals."""
    owners = ",".join(map(str, fill(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a text key; null for null."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(slots)).cast("long")


def place(rows: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """rows with slot and shard (columns of those names are replaced).

    Ties do not arise, repeated keys share a shard, a null key gives a null slot and shard, an empty table stays empty.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"slot": slot_of(key, slots)}).drop("shard")
    other = "_slot"
    while other.lower() in {c.lower() for c in rows.columns}:
        other = "_" + other
    table = lookup(spark, shards, slots).withColumnRenamed("slot", other)
    return rows.join(F.broadcast(table), F.col("slot") == F.col(other), "left").drop(other)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, null keys in one of their own; rows are dealt by shard and a salt, so no task holds a whole shard.

    Repeated rows are written as often as they occur; other columns, long texts and nulls are written as they are; an
    empty table makes a folder without shards.
    """
    placed.repartition("shard", F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(8))).write.partitionBy("shard").parquet(path)


def place_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, slot and shard of every document, by its doc_id; a null doc_id is placed by source and n_chars."""
    names = [f"shard-{i:03d}" for i in range(shards)]
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("/", F.lit("null"), "source", F.col("n_chars").cast("string")))
    return place(docs.select("doc_id", "source", "n_chars"), key, names, slots).select("doc_id", "slot", "shard")


ORACLE_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range({SHARDS}) t(i)),
prefs AS (
  SELECT i, name,
    CAST(CAST('0x' || substr(md5('offset:' || name), 1, 12) AS BIGINT) % {SLOTS} AS BIGINT) AS first_slot,
    CAST(CAST('0x' || substr(md5('skip:' || name), 1, 12) AS BIGINT) % ({SLOTS} - 1) + 1 AS BIGINT) AS skip
  FROM shards),
all_prefs AS (SELECT list(first_slot ORDER BY i) AS firsts, list(skip ORDER BY i) AS skips FROM prefs),
filled(step, claimed, slot) AS (
  SELECT CAST(0 AS BIGINT), list_value(firsts[1]), firsts[1] FROM all_prefs
  UNION ALL
  SELECT step + 1, list_append(claimed, next_slot), next_slot FROM (
    SELECT step, claimed,
      list_filter(list_transform(range({SLOTS}), lambda j: (firsts[((step + 1) % {SHARDS}) + 1] + j * skips[((step + 1) % {SHARDS}) + 1]) % {SLOTS}),
                  lambda s: NOT list_contains(claimed, s))[1] AS next_slot
    FROM filled, all_prefs WHERE step < {SLOTS} - 1)),
owners AS (SELECT slot, 'shard-' || lpad(CAST(step % {SHARDS} AS VARCHAR), 3, '0') AS shard FROM filled)
SELECT d.doc_id, d.slot, o.shard FROM (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), concat_ws('/', 'null', source, CAST(n_chars AS VARCHAR)))), 1, 12) AS BIGINT) % {SLOTS} AS BIGINT) AS slot
  FROM documents) d LEFT JOIN owners o ON o.slot = d.slot
"""
