"""Streams: change-log application, keyed feedback state, event-time windows.

The first two are the engine's own; windows on events are an addition to it.
"""

from __future__ import annotations

import contextlib
import heapq
import pickle
import re
import tempfile
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import collection as cl
from ..operators import feedback as fb
from ..sources.files import LOG_SCHEMA


def read_changes(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """The change log as a stream of files; what a follower has seen is in its checkpoint."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", per_batch).json(path)


def apply_batch(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State (id, seq, op, ...) after a batch of changes: the highest seq of each id wins, so a batch that comes twice changes nothing."""
    return cl.latest(state.unionByName(batch.select(state.columns)))


def follow(changes: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a stream of changes to a table: each batch writes the last change of its own ids alone; see state_of and compact."""

    def write(batch: DataFrame, number: int) -> None:
        cl.latest(batch).write.mode("overwrite").parquet(f"{table}/v{number}")  # the same batch again replaces itself

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def _parts(spark: SparkSession, table: str) -> list[str]:
    """Folders of a followed table: batches (v) and bases."""
    p = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().toString() for x in fs.listStatus(p) if re.match(r"(v|base)\d+$", x.getPath().getName()) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))


def state_of(spark: SparkSession, table: str) -> DataFrame:
    """The last change of every id (tombstones included, until compaction drops none of them: later changes go by seq)."""
    return cl.latest(spark.read.parquet(*_parts(spark, table)))


def compact(spark: SparkSession, table: str) -> None:
    """Fold what is there into one base. A base and its batches together say the same, so an interrupted run does no harm."""
    parts = _parts(spark, table)
    number = 1 + max(int(re.search(r"\d+$", x)[0]) for x in parts)
    state_of(spark, table).write.parquet(f"{table}/base{number}")
    for x in parts:
        p = spark._jvm.org.apache.hadoop.fs.Path(x)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Deltas of a key that a task holds at once, of a run on disk that it reads at once, and runs that it keeps.
HELD, READ, RUNS = 200_000, 1024, 64


def _read(run) -> Iterator[tuple]:
    run.seek(0)
    with contextlib.suppress(EOFError):
        while True:
            yield from pickle.load(run)


def _run(steps: Iterable[tuple]):
    """A temporary file of sorted steps, READ at a time."""
    run, part = tempfile.TemporaryFile(), []
    for step in steps:
        part.append(step)
        if len(part) == READ:
            pickle.dump(part, run, -1)
            part = []
    pickle.dump(part, run, -1)
    return run


def in_order(frames: Iterable[pd.DataFrame]) -> Iterator[float]:
    """Deltas by time, feedback id and size. At most HELD of them are held: more are sorted in runs on disk and merged."""
    runs, held = [], []
    for f in frames:
        held.extend(zip(f["ts"].to_numpy("datetime64[ns]").view("int64").tolist(), f["feedback_id"], f["delta"].tolist(), strict=True))
        if len(held) >= HELD:
            runs.append(_run(sorted(held)))
            held = []
        if len(runs) == RUNS:
            whole = _run(heapq.merge(*map(_read, runs)))
            for run in runs:
                run.close()
            runs = [whole]
    for _, _, d in heapq.merge(*map(_read, runs), sorted(held)):
        yield d
    for run in runs:
        run.close()


class BoostState(StatefulProcessor):
    """The boost of one (target, query) key: deltas in time order within a batch, clamped at each step."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("boost", "boost double, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        boost, n = self.state.get() if self.state.exists() else (1.0, 0)
        for d in in_order(rows):
            boost, n = max(fb.LOW, min(fb.HIGH, boost + d)), n + 1
        self.state.update((boost, n))
        yield pd.DataFrame({"target_id": [key[0]], "query_hash": [key[1]], "boost": [boost], "count": [n], "confidence": [n / (n + 5)]})

    def close(self) -> None:
        pass


def boost_stream(deltas: DataFrame) -> DataFrame:
    """Boosts as they change, from a stream of (target_id, query_hash, ts, feedback_id, delta)."""
    schema = "target_id string, query_hash string, boost double, count long, confidence double"
    return deltas.groupBy("target_id", "query_hash").transformWithStateInPandas(statefulProcessor=BoostState(), outputStructType=schema, outputMode="Update", timeMode="None")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type, as a stream or a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events", "value")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("events"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return out.select(F.col("session_window.start").alias("session_start"), "user_id", "events")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What a bounded stream leaves in a memory sink."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
