"""Pipeline state, health, approval policy and calibration. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The legal transitions of a pipeline.
TRANSITIONS = {
    "detected": ("hashing", "needs_retry"),
    "hashing": ("classifying", "duplicate", "needs_retry"),
    "duplicate": (),
    "classifying": ("selecting_strategy", "rejected", "needs_retry"),
    "selecting_strategy": ("processing", "needs_retry"),
    "processing": ("validating", "needs_retry", "rejected"),
    "validating": ("pending_approval", "needs_retry", "rejected"),
    "pending_approval": ("approved", "rejected", "needs_retry"),
    "needs_retry": ("hashing", "processing", "embedding", "rejected", "failed"),
    "approved": ("embedding", "needs_retry"),
    "embedding": ("complete", "rejected", "needs_retry"),
    "complete": ("archived",),
    "rejected": ("archived",),
    "archived": (),
    "failed": ("archived",),
}
TERMINAL = ("complete", "rejected", "archived", "duplicate", "failed")
# Seconds that a pipeline should at most stay in a state.
TIMEOUTS = {"detected": 300, "hashing": 60, "classifying": 120, "selecting_strategy": 30, "processing": 900, "validating": 60, "approved": 60, "embedding": 600}
# Confidence thresholds tried in calibration.
SWEEP = (0.95, 0.92, 0.90, 0.88, 0.85, 0.82, 0.80)


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_state string, to_state string")


def illegal_transitions(history: DataFrame) -> DataFrame:
    legal = edges(history.sparkSession)  # as many rows as TRANSITIONS has
    moved = history.filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col("to_state")))
    return moved.join(F.broadcast(legal), ["from_state", "to_state"], "left_anti").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def shortest_path(spark: SparkSession, start: str = "detected") -> DataFrame:
    """state, steps, path: shortest legal paths, the first in alphabetical order of equal ones."""
    edges(spark).createOrReplaceTempView("quire_edges")
    found = spark.sql(
        "WITH RECURSIVE walk(state, steps, path) AS (SELECT :start, 0, array(:start) UNION ALL "
        "SELECT e.to_state, w.steps + 1, concat(w.path, array(e.to_state)) FROM walk w JOIN quire_edges e ON e.from_state = w.state WHERE NOT array_contains(w.path, e.to_state)) "
        "SELECT state, min(struct(steps, array_join(path, '>') AS path)) AS best FROM walk GROUP BY state",
        args={"start": start},
    )
    return found.select("state", "best.steps", "best.path")


def stuck(pipelines: DataFrame, now: str, timeouts: dict[str, int] | None = None) -> DataFrame:
    """Pipelines older in their state than twice its timeout."""
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in (timeouts or TIMEOUTS).items() for x in kv)), F.col("state"))
    age = F.to_timestamp(F.lit(now)).cast("long") - F.col("updated_at").cast("timestamp").cast("long")
    return pipelines.withColumn("age_seconds", age).filter(F.col("age_seconds") > limit * 2).select("id", "state", "age_seconds")


def stale_reset(pipelines: DataFrame, now: str, seconds: int = 600) -> DataFrame:
    """All pipelines; those in processing untouched for too long go back to detected without retries."""
    old = (F.col("state") == "processing") & (F.to_timestamp(F.lit(now)).cast("long") - F.col("updated_at").cast("timestamp").cast("long") > seconds)
    return pipelines.select("id", F.when(old, "detected").otherwise(F.col("state")).alias("state"), F.when(old, 0).otherwise(F.col("retry_count")).cast("long").alias("retry_count"))


def state_durations(history: DataFrame) -> DataFrame:
    """pipeline_id, state, seconds: how long each state held before the next transition."""
    return history.filter(F.col("from_state").isNotNull()).select("pipeline_id", F.col("from_state").alias("state"), (F.col("created_at").cast("timestamp").cast("double") - F.col("since").cast("timestamp").cast("double")).alias("seconds"))


def duration_percentiles(history: DataFrame) -> DataFrame:
    d = state_durations(history)
    return d.groupBy("state").agg(F.count("*").alias("n"), F.round(F.percentile("seconds", 0.5), 3).alias("median"), F.round(F.percentile("seconds", 0.95), 3).alias("p95"), F.round(F.max("seconds"), 3).alias("most"))


def last_failed_stage(history: DataFrame) -> DataFrame:
    f = history.filter(F.col("to_state") == "needs_retry")
    return f.groupBy("pipeline_id").agg(F.max_by("from_state", F.struct("created_at", "id")).alias("stage"))


def retry_routing(pipelines: DataFrame, failed: DataFrame, most: int = 3) -> DataFrame:
    waiting = pipelines.filter(F.col("state") == "needs_retry").join(failed.withColumnRenamed("pipeline_id", "id"), "id", "left")
    route = F.when(F.col("retry_count") >= most, "failed").when(F.col("stage") == "embedding", "embed").otherwise("full")
    return waiting.select("id", "retry_count", "stage", route.alias("route"))


def worker_queue(pipelines: DataFrame, limit: int) -> DataFrame:
    """Approved before detected before retries, then by priority and age."""
    kind = F.when(F.col("state") == "approved", 0).when(F.col("state") == "detected", 1).when(F.col("state") == "needs_retry", 2)
    return pipelines.withColumn("kind", kind).filter("kind IS NOT NULL").orderBy("kind", "priority", "created_at", "id").limit(limit).select("id", "state", "kind", "priority")


def health(pipelines: DataFrame, now: str, queue_limit: int = 100, failure_limit: float = 0.2) -> DataFrame:
    """One row: counts, status and alerts, from a single pass."""
    s, day = F.col("state"), F.col("updated_at") >= F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 24 HOURS")
    one = pipelines.agg(
        F.count_if(~s.isin(*TERMINAL, "detected", "needs_retry")).alias("active"), F.count_if(s == "detected").alias("queued"), F.count_if(s.isin("failed", "needs_retry")).alias("failed"),
        F.count_if((s == "complete") & day).alias("complete_24h"), F.count_if(s.isin("failed", "needs_retry") & day).alias("failed_24h"),
    )
    rate = F.col("failed_24h") / F.greatest(F.lit(1), F.col("failed_24h") + F.col("complete_24h"))
    alerts = F.array_compact(F.array(F.when(F.col("queued") > queue_limit, "queue_backup"), F.when(rate > failure_limit, "failure_rate")))
    status = F.when(rate > failure_limit, "degraded").when(F.col("active") + F.col("queued") > 0, "processing").otherwise("idle")
    return one.select("*", F.round(rate, 4).alias("failure_rate"), status.alias("status"), F.array_join(alerts, ",").alias("alerts"))


def batch_filter(pipelines: DataFrame, state: str = "pending_approval", glob: str | None = None, least: float | None = None, most: float | None = None, created_before: str | None = None, max_count: int = 50, compat: bool = False) -> DataFrame:
    """Pipelines of a batch. compat: the limit of twice max_count comes before the filter on confidence."""
    rows = pipelines.filter(F.col("state") == state)
    if glob:
        rows = rows.filter(F.col("source_path").rlike(T.glob_pattern(glob)))
    if created_before:
        rows = rows.filter(F.col("created_at") < F.to_timestamp(F.lit(created_before)))
    order = (F.col("priority").asc(), F.col("created_at").asc(), F.col("id").asc())
    if compat:
        rows = rows.orderBy(*order).limit(2 * max_count)
    if least is not None:
        rows = rows.filter(F.col("confidence") >= least)
    if most is not None:
        rows = rows.filter(F.col("confidence") <= most)
    return rows.orderBy(*order).limit(max_count).select("id", "state", "priority", "confidence", "source_path")


def approval_stats(pipelines: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return pipelines.agg(F.count("*").alias("total"), F.round(F.avg(c), 2).alias("avg_confidence"), F.count_if(c >= 0.9).alias("high"), F.count_if(c < 0.8).alias("attention"))


def decision_metrics(feedback: DataFrame) -> DataFrame:
    d, c = F.col("decision"), F.col("confidence")
    return feedback.agg(F.count("*").alias("total"), F.count_if(d == "approved").alias("approved"), F.count_if(d == "rejected").alias("rejected"), F.round(F.avg(F.when(d == "approved", c)), 4).alias("conf_approved"), F.round(F.avg(F.when(d == "rejected", c)), 4).alias("conf_rejected"))


def calibration(feedback: DataFrame, least: int = 50) -> DataFrame:
    """Accuracy by type, from at least so many decisions."""
    g = feedback.groupBy("book_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("decision") == "approved").cast("double")), 4).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    return g.filter(F.col("n") >= least)


def threshold_sweep(feedback: DataFrame, target: float = 0.95, least: int = 10) -> DataFrame:
    """book_type, threshold: the highest threshold over which decisions are accurate enough; null if none is."""
    each = feedback.withColumn("t", F.explode(F.array(*map(F.lit, SWEEP)))).filter(F.col("confidence") >= F.col("t"))
    ok = each.groupBy("book_type", "t").agg(F.count("*").alias("n"), F.avg((F.col("decision") == "approved").cast("double")).alias("acc")).filter((F.col("n") >= least) & (F.col("acc") >= target))
    return feedback.select("book_type").distinct().join(ok.groupBy("book_type").agg(F.max("t").alias("threshold")), "book_type", "left")


def effective_threshold(thresholds: DataFrame) -> Column:
    """The threshold that counts: the one set by hand, else the one learnt from feedback."""
    return F.coalesce("manual_override", "threshold") if "manual_override" in thresholds.columns else F.col("threshold")


def auto_approval(pipelines: DataFrame, thresholds: DataFrame, mode: str, escape_hatch: bool, used_today: int, daily_cap: int) -> DataFrame:
    """id, decision: the first reason that denies automatic approval, else approve.

    pipelines: id, book_type, confidence, valid, needs_review. thresholds: book_type, threshold, and where it has one the
    column manual_override, which counts before the threshold.
    """
    c = F.col("confidence")
    p = pipelines.join(thresholds.select("book_type", effective_threshold(thresholds).alias("threshold")), "book_type", "left")
    known = F.col("book_type").isNotNull() & (F.col("book_type") != "unknown")
    reason: Column = (
        F.when(F.lit(escape_hatch), "escape_hatch").when(F.lit(mode == "supervised"), "supervised").when(c.isNull() | F.isnan(c) | (c < 0) | (c > 1), "invalid_confidence").when(~known, "unknown_type")
        .when(~F.col("valid"), "validation_failed").when(F.col("needs_review"), "needs_review").when(F.lit(used_today >= daily_cap), "daily_cap")
        .when(F.col("threshold").isNull(), "no_threshold").when(c < F.col("threshold"), "below_threshold").otherwise("approve")
    )
    return p.select("id", "book_type", "confidence", reason.alias("decision"))


def readiness(metrics: DataFrame) -> DataFrame:
    """A rate of exactly 0 counts as not ready, as it always has."""
    rate = F.col("rejected") / F.col("total")
    used = F.when((F.col("total") == 0) | (rate == 0), F.lit(1.0)).otherwise(rate)
    return metrics.select("total", F.round(rate, 4).alias("override_rate"), ((F.col("total") >= 100) & (used < 0.15)).alias("partial_ready"), ((F.col("total") >= 500) & (used < 0.05)).alias("full_ready"))


def spot_sample(feedback: DataFrame, rate: float, seed: int) -> DataFrame:
    """At least one and at most a share of the rows, by the hash of seed and id."""
    n = feedback.count()
    return feedback.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).limit(max(1, int(n * rate))) if n else feedback


def stratified(rows: DataFrame, group: str, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows, round by round over the groups; within a group by the hash of seed and key."""
    h = lambda c: F.sha2(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(h(key)))
    return rows.withColumn("turn", turn).orderBy("turn", h(group)).limit(n)


def strategy(rows: DataFrame, of: dict[str, str], least: float = 0.7, fallback: str = "conservative") -> DataFrame:
    name = F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.col("book_type"))
    return rows.withColumn("strategy", F.when(F.col("confidence") < least, fallback).otherwise(F.coalesce(name, F.lit(fallback))))


def idempotency(arriving: DataFrame, known: DataFrame) -> DataFrame:
    """content_hash, action: a hash that is complete, failed or under way is skipped, a rejected or archived one is done again."""
    j = arriving.join(known.select("content_hash", "state"), "content_hash", "left")
    return j.select("content_hash", F.when(F.col("state").isNull(), "new").when(F.col("state").isin("rejected", "archived"), "redo").otherwise("skip").alias("action"))
