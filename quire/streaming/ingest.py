"""Streaming: files that arrive, pipelines that change state, and rolling views of the same log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.executors import ship
from ..operators.governance import TIMEOUTS, TRANSITIONS
from ..sources.store import Store


def detect_files(spark: SparkSession, folder: str, store: Store, checkpoint: str, table: str = "pipelines", per_batch: int = 100) -> StreamingQuery:
    """New .epub and .pdf files become pipelines in state detected, once for each content, however often they arrive.

    A batch appends its new rows; only hashes of the stored ones are read. `Store.compact` merges the parts.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{epub,pdf}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    hashed = files.select(F.col("path").alias("source_path"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("created_at"))

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["content_hash"]).withColumn("state", F.lit("detected"))
        if store.exists(table):
            fresh = fresh.join(store.read(table).select("content_hash"), "content_hash", "left_anti")
        if not fresh.isEmpty():
            store.append(table, fresh, run, number)

    return hashed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class StateMachine(StatefulProcessor):
    """One pipeline: legal transitions advance it, others are reported; silence for twice the timeout of its state, times
    pace, is reported, too. Each arrival ends the timer that ran before it."""

    def __init__(self, timers: bool = False, pace: float = 1.0):
        self.timers, self.pace = timers, pace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, since double, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        now, since, _ = self.state.get() if self.state.exists() else (None, None, None)
        out = []
        for e in events.itertuples():
            legal = now is None or e.to_state in TRANSITIONS.get(now, ())
            out.append((key[0], now, e.to_state, bool(legal), float(e.ts - since) if since is not None and legal else None))
            if legal:
                now, since = e.to_state, float(e.ts)
        due = None
        if self.timers:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if now in TIMEOUTS:
                due = int(timerValues.getCurrentProcessingTimeInMs()) + int(2000 * TIMEOUTS[now] * self.pace)
                self.handle.registerTimer(due)
        self.state.update((now, since, due))
        yield pd.DataFrame(out, columns=["pipeline_id", "from_state", "to_state", "legal", "seconds"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, _, due = self.state.get() if self.state.exists() else (None, None, None)
        stuck = [(key[0], now, "stuck", False, None)] if due is not None and expiredTimerInfo.getExpiryTimeInMs() >= due else []
        yield pd.DataFrame(stuck, columns=["pipeline_id", "from_state", "to_state", "legal", "seconds"])

    def close(self) -> None:
        pass


def track_states(events: DataFrame, timers: bool = False, pace: float = 1.0) -> DataFrame:
    """pipeline_id, from_state, to_state, legal, seconds. events: a stream of pipeline_id, event_id, ts (seconds), to_state.

    Keys are dealt by pipeline; the state of each is two values in the state store.
    """
    ship(events.sparkSession)
    schema = "pipeline_id long, from_state string, to_state string, legal boolean, seconds double"
    return events.groupBy("pipeline_id").transformWithStateInPandas(StateMachine(timers, pace), schema, "Append", "ProcessingTime" if timers else "None")


def failure_rate(events: DataFrame, late: str = "1 hour", size: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Share of failures in sliding windows. events: ts timestamp, to_state; batch or stream."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", size, slide))
        .agg(F.count_if(F.col("to_state").isin("failed", "needs_retry")).alias("failed"), F.count_if(F.col("to_state") == "complete").alias("complete"))
        .select(F.col("window.start").alias("starts"), "failed", "complete", F.round(F.col("failed") / F.greatest(F.lit(1), F.col("failed") + F.col("complete")), 4).alias("rate"))
    )


def daily_approvals(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Automatic approvals of each day, for the daily cap. events: ts timestamp, actor, action."""
    own = events.filter(F.col("actor").startswith("auto:") & (F.col("action") == "approved"))
    return own.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")


#: Size of a quantile sketch: with so many values or fewer it is exact, with more its ranks are off by about 1.5 / SKETCH.
SKETCH = 4096


def age_sketches(durations: DataFrame, k: int = SKETCH) -> DataFrame:
    """state, n, most, sketch of durations (state, seconds), batch or stream.

    Sketches merge, so that statistics of a stream need no history: as a streaming aggregation (complete or update mode) the
    state store holds one for each state.
    """
    own = durations.filter(F.col("seconds").isNotNull()).groupBy("state")
    return own.agg(F.count("*").alias("n"), F.max("seconds").alias("most"), F.kll_sketch_agg_double("seconds", k).alias("sketch"))


def merged_ages(sketches: DataFrame, k: int = SKETCH) -> DataFrame:
    """Sketches of the same states put together."""
    return sketches.groupBy("state").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def age_statistics(sketches: DataFrame) -> DataFrame:
    """state, n, median, p95, most: from one sketch a state."""
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return sketches.select("state", "n", at(0.5).alias("median"), at(0.95).alias("p95"), "most")


def keep_ages(tracked: DataFrame, store: Store, checkpoint: str, table: str = "state_ages", k: int = SKETCH) -> StreamingQuery:
    """Store a sketch for each state and batch of the stream that track_states makes; a repeated batch adds nothing, and
    `Store.update(table, ingest.merged_ages)` puts them together. age_statistics(merged_ages(store.read(table))) reads them."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    durations = tracked.filter("legal").select(F.col("from_state").alias("state"), "seconds")

    def add(batch: DataFrame, number: int) -> None:
        store.append(table, age_sketches(batch, k), run, number)

    return durations.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
