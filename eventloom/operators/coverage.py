"""Coverage of stored embeddings, repair queues, and erasure deadlines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRESH = ("Current", "ContentChanged", "ModelMismatch", "NotEmbedded")


def with_queue(entities: DataFrame, queue: DataFrame) -> DataFrame:
    """Each entity with its queue row, at most one."""
    q = queue.groupBy(F.col("id").alias("queueId")).agg(F.max_by("state", "availableAt").alias("state"), F.max_by("failure", "availableAt").alias("failure"), F.max("availableAt").alias("availableAt"), F.max_by("leaseUntil", "availableAt").alias("leaseUntil"))
    return entities.join(q, F.concat(F.col("kind"), F.lit(":"), F.col("id")) == F.col("queueId"), "left")


def freshness(model: str | None) -> Column:
    """By stored source hash, then by stored model; without an expected model any will do."""
    changed = F.col("storedHash") != F.col("sourceHash")
    other = F.lit(False) if model is None else F.col("storedModel") != model
    return F.when(F.col("storedHash").isNull(), "NotEmbedded").when(changed, "ContentChanged").when(other, "ModelMismatch").otherwise("Current")


def repair_state(now: datetime) -> Column:
    """By queue row: none, ready, retried, failed, or in process with a lease that holds (later than ``now``) or has run out."""
    state = F.col("state")
    leased = F.coalesce(F.col("leaseUntil") > F.lit(now), F.lit(False))
    process = F.when(leased, "InProgress").otherwise("LeaseExpired")
    return F.when(F.col("queueId").isNull(), "NoQueuedWork").when(state == "Ready", "Waiting").when(state == "Retry", "Retrying").when(state == "Failed", "Failed").when(state == "Processing", process)


def classified(entities: DataFrame, queue: DataFrame, model: str | None, now: datetime) -> DataFrame:
    """Entities with their queue rows, ``freshness`` and ``repair``."""
    return with_queue(entities, queue).withColumn("freshness", freshness(model)).withColumn("repair", repair_state(now))


def embedding_coverage(entities: DataFrame, queue: DataFrame, model: str | None, now: datetime) -> DataFrame:
    """Entities by kind, freshness, repair state and, of failed work, failure; each in exactly one cell."""
    failure = F.when(F.col("repair") == "Failed", F.col("failure"))
    return classified(entities, queue, model, now).groupBy("kind", "freshness", "repair", failure.alias("failureKind")).agg(F.count("*").alias("entities"))


def observed_models(entities: DataFrame) -> DataFrame:
    """Entities by kind and stored model."""
    return entities.where("storedModel is not null").groupBy("kind", F.col("storedModel").alias("model")).agg(F.count("*").alias("entities"))


def coverage_summary(entities: DataFrame, queue: DataFrame, model: str | None, now: datetime) -> DataFrame:
    """By kind: entities, share of current ones, gaps that no queued work will close, age of the oldest gap."""
    gap = F.col("freshness") != "Current"
    age = F.greatest(F.lit(0), F.unix_seconds(F.lit(now)) - F.unix_seconds(F.min(F.when(gap, F.col("updatedAt")))))
    return classified(entities, queue, model, now).groupBy("kind").agg(
        F.count("*").alias("entities"),
        (F.count(F.when(~gap, 1)) / F.count("*")).alias("coverage"),
        F.count(F.when(gap & (F.col("repair") == "NoQueuedWork"), 1)).alias("orphanedGaps"),
        F.when(F.count(F.when(gap, F.col("updatedAt"))) > 0, age).alias("oldestGapSeconds"),
    )


def embedding_lag(entities: DataFrame, model: str | None = None, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles of seconds from a current entity's update to its embedding; clocks that disagree count 0."""
    lag = F.greatest(F.lit(0), F.unix_seconds("embeddedAt") - F.unix_seconds("updatedAt"))
    rows = entities.where(freshness(model) == "Current").where("updatedAt is not null and embeddedAt is not null").select(lag.alias("lag"))
    return rows.agg(F.count("*").alias("n"), *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY lag)").alias(f"p{int(p * 100)}") for p in ps])


def queue_observation(queue: DataFrame, before: datetime, cap: int) -> DataFrame:
    """Waiting rows (failed ones don't wait): total up to a cap, stuck ones, the oldest."""
    waiting = F.col("state") != "Failed"
    out = queue.agg(F.count(F.when(waiting, 1)).alias("n"), F.count(F.when(waiting & (F.col("availableAt") < F.lit(before)), 1)).alias("stuck"), F.min(F.when(waiting, F.col("availableAt"))).alias("oldestAvailable"))
    return out.select(F.least("n", F.lit(cap)).alias("total"), "stuck", "oldestAvailable", (F.col("n") > cap).alias("capped"))


def backlog(queue: DataFrame, now: datetime, cap: int) -> DataFrame:
    """Rows that can be claimed now: due ready or retried ones, and those in process whose lease has run out; count up to a cap, and the oldest one's age."""
    due = F.col("state").isin("Ready", "Retry") & (F.col("availableAt") <= F.lit(now))
    lost = (F.col("state") == "Processing") & (F.col("leaseUntil") <= F.lit(now))
    out = queue.where(due | lost).agg(F.count("*").alias("n"), F.min("availableAt").alias("oldest"))
    return out.select(F.least("n", F.lit(cap)).alias("claimable"), (F.unix_seconds(F.lit(now)) - F.unix_seconds("oldest")).alias("oldestAgeSeconds"))


def coverage_checks(summary: DataFrame, observation: DataFrame, truncated: bool = False) -> DataFrame:
    """``(name, status, offending)`` of the two checks: no orphaned gap, no stuck work.

    A read that was cut (``truncated`` for the scan, ``capped`` for the queue) never passes.
    """
    gaps = summary.agg(F.lit("NoOrphanedGap").alias("name"), F.coalesce(F.sum("orphanedGaps"), F.lit(0)).alias("offending"), F.lit(truncated).alias("cut"))
    stuck = observation.select(F.lit("NoStuckWork").alias("name"), F.col("stuck").alias("offending"), F.col("capped").alias("cut"))
    status = F.when(F.col("cut"), "Inconclusive").when(F.col("offending") == 0, "Passed").otherwise("Failed")
    return gaps.unionByName(stuck).select("name", status.alias("status"), "offending")


def erasure_deadline(requests: DataFrame, compactions: DataFrame, file_hours: int = 168, log_days: int = 8, stream_days: int = 7) -> DataFrame:
    """When an erasure is complete: the latest of file removal, log rollover and stream expiry.

    A compaction after the erasure starts files and logs anew; a log goes with the day after.
    """
    last = compactions.groupBy("table").agg(F.max("compactedAt").alias("compactedAt"))
    start = F.greatest("erasedAt", F.coalesce("compactedAt", "erasedAt"))
    rows = requests.join(last, "table", "left").withColumn("start", start)
    files = F.col("start") + F.make_interval(hours=F.lit(file_hours))
    logs = F.date_trunc("day", F.col("start")) + F.make_interval(days=F.lit(log_days + 1))
    return rows.groupBy("requestId").agg(F.max(F.greatest(files, logs, F.col("requestedAt") + F.make_interval(days=F.lit(stream_days)))).alias("deadline"))
