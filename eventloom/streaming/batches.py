"""The micro-batch pipeline: assess, ingest, watermark, gate, publish."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import envelopes, facts, reports
from ..specs import POLICY


def start_stream(source: DataFrame, process_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run ``process_batch`` synchronously per micro-batch; returning acknowledges its offsets."""
    writer = source.writeStream.foreachBatch(process_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def native_daily_counts(events: DataFrame, lateness: str = "24 hours") -> DataFrame:
    """The built-in way to count per UTC day with late data dropped; for monitoring beside the tables."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))


def native_dedupe(events: DataFrame, lateness: str = "24 hours") -> DataFrame:
    """The built-in first-wins dedupe by event id within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def assess(records: DataFrame, silver: DataFrame, bronze: DataFrame, observed_at: datetime, watermark: datetime | None, conflicts: DataFrame | None = None) -> DataFrame:
    """Read-only first pass: every valid record with its admission, conflicts and novelty.

    Records that were parsed and validated before are taken as they are, as are conflict ids.
    """
    known = records if "isValidEvent" in records.columns else envelopes.with_fingerprint(envelopes.with_validity(records))
    valid = known.where("isValidEvent")
    if conflicts is None:
        conflicts = facts.all_conflicts(facts.conflicting_ids(valid), facts.historical_conflicts(valid, silver), facts.coordinate_conflicts(valid, bronze))
    out = facts.with_admission(valid, observed_at, watermark).join(conflicts.withColumn("conflict", F.lit(True)), "eventId", "left")
    fresh = facts.newly_admitted(valid, silver, bronze).select("eventId").distinct().withColumn("fresh", F.lit(True))
    return out.join(fresh, "eventId", "left").na.fill(False, ["conflict", "fresh"])


def batch_outcome(quality: Column | None = None, marked: Column | None = None) -> Column:
    """Malformed, conflicting or future records block; marked ones wait for erasure; else publish."""
    bad = F.col("malformed") + F.col("conflicting") + F.col("future") if quality is None else quality
    return F.when(bad > 0, "QualityBlocked").when((F.lit(0) if marked is None else marked) > 0, "ErasurePending").otherwise("Publish")


def candidate_watermark(times: DataFrame, previous: datetime | None, observed_at: datetime, lateness: timedelta = POLICY.lateness) -> DataFrame:
    """Latest visible event time, capped at the observation, less the lateness; never before the previous one."""
    seconds = int(lateness.total_seconds())
    top = F.max(F.least("occurredAt", F.lit(observed_at))) - F.make_interval(secs=F.lit(seconds))
    before = F.lit(previous).cast("timestamp")
    return times.agg(F.greatest(top, before).alias("watermark"))


def admission_metrics(df: DataFrame, batch: int, generation: int, revision: int, lateness: timedelta = POLICY.lateness) -> DataFrame:
    """One metric row of a batch with admissions."""
    status = F.col("admission.status")
    return df.agg(F.count(F.when(status == "CLOSED", 1)).alias("closed"), F.count(F.when(status == "FUTURE", 1)).alias("future")).select(
        F.lit(batch).alias("batch"), F.lit(generation).alias("generation"), F.lit(revision).alias("revision"), F.lit(int(lateness.total_seconds())).alias("latenessSeconds"), "closed", "future"
    )


def visible_watermark(existing: DataFrame, candidates: DataFrame, previous, observed_at, k: int = POLICY.min_subjects) -> DataFrame:
    """The candidate watermark over events that suppression lets through."""
    return candidate_watermark(reports.visible_candidate_times(existing, candidates, k), previous, observed_at)
