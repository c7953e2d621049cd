"""From valid events to Bronze, Silver, late and quarantined facts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import set_digest, utc_day
from ..functions.joins import met
from ..specs import POLICY
from . import envelopes
from .privacy import exclude_markers

COORDINATE = ("topic", "partition", "offset")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in a stated order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``."""
    return first_by(df, keys, [F.col(order).desc()])


def conflicting_ids(df: DataFrame) -> DataFrame:
    """Event ids with more than one fingerprint (two extremes tell, and combine map-side)."""
    return df.groupBy("eventId").agg(F.min("eventFingerprint").alias("a"), F.max("eventFingerprint").alias("b")).where("a <> b").select("eventId")


def without_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("eventId"), "eventId", "left_anti")


def historical_conflicts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Event ids that are stored already under another fingerprint; the stored side is filtered to the batch's ids where it is read."""
    old = met(stored.select("eventId", F.col("eventFingerprint").alias("stored")), incoming, ["eventId"])
    return incoming.select("eventId", "eventFingerprint").join(old, "eventId").where("eventFingerprint <> stored").select("eventId").distinct()


def stored_fingerprints(silver: DataFrame, late: DataFrame, at: datetime) -> DataFrame:
    """Ids and fingerprints of the Silver and late facts that have not expired at ``at``."""
    live = [unexpired(df, at).select("eventId", "eventFingerprint") for df in (silver, late)]
    return live[0].unionByName(live[1])


def coordinate_conflicts(incoming: DataFrame, bronze: DataFrame) -> DataFrame:
    """Event ids of records whose Kafka coordinate is stored with another fingerprint."""
    old = met(bronze.select(*COORDINATE, F.col("eventFingerprint").alias("stored")), incoming, list(COORDINATE))
    return incoming.select("eventId", *COORDINATE, "eventFingerprint").join(old, list(COORDINATE)).where("eventFingerprint <> stored").select("eventId").distinct()


def all_conflicts(*sets: DataFrame) -> DataFrame:
    """Union of conflict ids, distinct."""
    out = sets[0].select("eventId")
    for s in sets[1:]:
        out = out.unionByName(s.select("eventId"))
    return out.distinct()


def new_conflicts(second: DataFrame, first: DataFrame) -> DataFrame:
    """Conflicts that the second pass sees and the first did not; must be empty."""
    return second.join(first.select("eventId"), "eventId", "left_anti")


def newly_admitted(incoming: DataFrame, admitted: DataFrame, bronze: DataFrame, recovery: bool = False) -> DataFrame:
    """Rows not admitted yet by event id, nor stored at their coordinate; recovery lets those coordinates in again."""
    fresh = incoming.join(met(admitted.select("eventId"), incoming, ["eventId"]).distinct(), "eventId", "left_anti")
    return fresh if recovery else fresh.join(met(bronze.select(*COORDINATE), incoming, list(COORDINATE)).distinct(), list(COORDINATE), "left_anti")


def late_not_admitted(closed: DataFrame, silver: DataFrame, conflicts: DataFrame, existing: DataFrame) -> DataFrame:
    """Closed-day facts that neither Silver nor the late table has, and that don't conflict."""
    known = met(silver.select("eventId"), closed, ["eventId"])
    out = closed.join(known, "eventId", "left_anti").join(conflicts.select("eventId"), "eventId", "left_anti")
    return out.join(met(existing.select(*COORDINATE), closed, list(COORDINATE)), list(COORDINATE), "left_anti")


def with_expiry(df: DataFrame, now: datetime, days: int) -> DataFrame:
    return df.withColumn("ingestedAt", F.lit(now)).withColumn("expiresAt", F.lit(now + timedelta(days=days)))


def unexpired(df: DataFrame, at: datetime) -> DataFrame:
    """Rows without an expiry, or with a later one."""
    return df.where(F.col("expiresAt").isNull() | (F.col("expiresAt") > F.lit(at)))


def classify_event_time(event_time: Column, observed_at: datetime, watermark: datetime | None, skew: timedelta = POLICY.future_skew) -> Column:
    """``(status, effectiveTime)``: FUTURE, CLOSED (its UTC day is over at the watermark) or OPEN.

    Days are compared by number: a day is over once a later one has begun at the watermark.
    Sessions run in UTC, as the library's own do; an open fact counts at the latest as seen now.
    """
    late = F.lit(False) if watermark is None else utc_day(event_time) < F.lit(watermark.date())
    known = F.when(event_time <= F.lit(observed_at + skew), F.when(late, "CLOSED").otherwise("OPEN"))
    status = F.coalesce(known, F.lit("FUTURE"))
    return F.struct(status.alias("status"), F.when(status == "OPEN", F.least(event_time, F.lit(observed_at))).alias("effectiveTime"))


def with_admission(df: DataFrame, observed_at: datetime, watermark: datetime | None) -> DataFrame:
    return df.withColumn("admission", classify_event_time(F.col("occurredAt"), observed_at, watermark))


def open_facts(df: DataFrame, observed_at: datetime, watermark: datetime | None) -> DataFrame:
    """Only OPEN rows reach Silver."""
    return with_admission(df, observed_at, watermark).where("admission.status = 'OPEN'").drop("admission")


def _facts(df: DataFrame) -> dict[str, Column]:
    p = lambda n: F.col(f"payload.{n}")
    return {
        "applicationId": F.lower(p("applicationId")),
        "jobId": F.lower(F.coalesce(p("jobId"), p("job.jobId"))),
        "newStatus": p("newStatus"),
        "jobSkills": p("job.skills"),
    }


def to_bronze(df: DataFrame) -> DataFrame:
    """Without raw value, actor, candidate and results; one row per coordinate."""
    kept = df.select(*COORDINATE, "kafkaTimestamp", "eventId", "eventType", "occurredAt", "aggregateType", "aggregateId", "eventFingerprint", *[c.alias(n) for n, c in _facts(df).items()], "subjectToken", "subjectTokens")
    return first_by(kept, list(COORDINATE), ["eventFingerprint"])


def to_silver(valid: DataFrame, markers: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """One row per event id, without conflicting and marked events."""
    clean = exclude_markers(without_ids(valid, conflicting_ids(valid) if conflicts is None else conflicts), markers)
    one = first_by(clean, ["eventId"], ["topic", "partition", "offset"])
    return one.select("eventId", "eventType", "occurredAt", "aggregateType", "aggregateId", *[c.alias(n) for n, c in _facts(one).items()], "subjectToken", "subjectTokens", "eventFingerprint")


def to_late_facts(df: DataFrame, markers: DataFrame, observed_at: datetime) -> DataFrame:
    """Bronze-shaped closed-day rows with their reason and expiry, one per coordinate."""
    clean = first_by(exclude_markers(df, markers), list(COORDINATE), ["eventFingerprint"])
    cols = ["eventId", "eventFingerprint", "eventType", *COORDINATE, "occurredAt", "aggregateType", "aggregateId", "applicationId", "jobId", "newStatus", "jobSkills", "subjectToken", "subjectTokens"]
    return with_expiry(clean.select(*cols, F.lit("CLOSED_DAY").alias("admissionReason")), observed_at, POLICY.late_days)


def conflict_rows(valid: DataFrame, conflicts: DataFrame) -> DataFrame:
    return valid.join(conflicts.select("eventId").distinct(), "eventId")


def to_quarantine(df: DataFrame, reason: Column, now: datetime, future: bool = False) -> DataFrame:
    """Coordinates, hash, tokens, id, reason and expiry only."""
    tokens = F.col("subjectTokens") if "subjectTokens" in df.columns else F.array().cast("array<string>")
    return df.select(*COORDINATE, F.sha2("rawValue", 256).alias("payloadHash"), tokens.alias("subjectTokens"), envelopes.quarantine_id(future).alias("quarantineId"), reason.alias("quarantineReason"), F.lit(now + timedelta(days=POLICY.quarantine_days)).alias("expiresAt"))


def quarantine_union(malformed: DataFrame, conflicts: DataFrame, now: datetime) -> DataFrame:
    """Malformed and conflicting records in one frame."""
    return to_quarantine(malformed, envelopes.quarantine_reason(malformed), now).unionByName(to_quarantine(conflicts, F.lit(envelopes.CONFLICT), now))


def evidence_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union that fills columns which one side lacks."""
    return a.unionByName(b, allowMissingColumns=True)


def conflict_counts(valid: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Valid rows, conflicting ids and conflicting records in one pass."""
    flagged = valid.join(conflicts.select("eventId").distinct().withColumn("c", F.lit(1)), "eventId", "left")
    return flagged.agg(F.count("*").alias("validRows"), F.countDistinct(F.when(F.col("c") == 1, F.col("eventId"))).alias("conflictingIds"), F.count("c").alias("conflictingRecords"))


def admission_quality(df: DataFrame, conflicts: DataFrame, observed_at: datetime, watermark: datetime | None) -> DataFrame:
    """Malformed, conflicting, future and closed records of a batch in one pass."""
    flagged = with_admission(envelopes.with_validity(df), observed_at, watermark).join(conflicts.select("eventId").distinct().withColumn("c", F.lit(1)), "eventId", "left")
    ok = F.col("isValidEvent")
    count = lambda c: F.count(F.when(c, 1))
    return flagged.agg(
        count(~ok).alias("malformed"), count(ok & F.col("c").isNotNull()).alias("conflicting"),
        count(ok & (F.col("admission.status") == "FUTURE")).alias("future"), count(ok & (F.col("admission.status") == "CLOSED")).alias("closed"),
    )


def suppressed_count(all_rows: DataFrame, safe_rows: DataFrame) -> int:
    """Rows that deletion markers held back."""
    return all_rows.count() - safe_rows.count()


def input_fingerprint(df: DataFrame) -> DataFrame:
    """Delivered offsets and a digest of the records, by partition, combined map-side.

    The digest needs no order and no gathered group; a null value differs from an empty one.
    """
    line = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"), F.coalesce(F.sha2(F.col("rawValue").cast("binary"), 256), F.lit("-")))
    return df.groupBy("topic", "partition").agg(F.min("offset").alias("startOffset"), (F.max("offset") + 1).alias("endOffsetExclusive"), F.count("*").alias("records"), set_digest(line).alias("digest"))


def marker_fingerprint(markers: DataFrame) -> DataFrame:
    """The number of distinct markers and their set's digest."""
    distinct = markers.select("subjectToken").distinct()
    return distinct.agg(F.count("*").alias("markers"), set_digest("subjectToken").alias("fingerprint"))


def range_fingerprint(ranges: DataFrame) -> DataFrame:
    """SHA-256 over a manifest's ranges in canonical order (a manifest is small: at most one row a partition)."""
    from ..functions.columns import length_prefixed

    line = length_prefixed([F.col(c) for c in ("topic", "partition", "startOffset", "endOffsetExclusive")])
    return ranges.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";"), 256).alias("fingerprint"))


def selection_digest(coordinates: DataFrame) -> DataFrame:
    """SHA-256 over a replay's coordinates (at most 1000) in canonical order."""
    from ..functions.columns import length_prefixed

    return coordinates.distinct().agg(F.sha2(F.array_join(F.array_sort(F.collect_list(length_prefixed([F.col(c) for c in COORDINATE]))), ";"), 256).alias("digest"))
