"""Declared tables, wire values and policy constants."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql.types import StructType

# Wire values (fixed).
JOB_EVENTS = ("JOB_CREATED", "JOB_UPDATED", "JOB_CLOSED")
SEARCH_EVENTS = ("SEARCH_PERFORMED", "JOB_VIEWED", "SEARCH_RESULT_CLICKED", "SEARCH_RECORDING_FAILED")
APPLICATION_EVENTS = ("APPLICATION_CREATED", "APPLICATION_STATUS_CHANGED", "CANDIDATE_HIRED")
EVENT_TYPES = (*JOB_EVENTS, *SEARCH_EVENTS, *APPLICATION_EVENTS)
AGGREGATE_TYPES = ("Job", "Application", "Search")
STATUSES = ("Accepted", "Declined", "Interview", "Hired", "Rejected")
SEARCH_KINDS = ("jobs", "recommendedJobs", "semanticJobSearch", "candidateMatches")
METRICS = {
    "timeToAccept": ("createdAt", "acceptedAt"),
    "timeToInterview": ("createdAt", "interviewAt"),
    "timeToHire": ("createdAt", "hiredAt"),
    "acceptedToInterview": ("acceptedAt", "interviewAt"),
    "interviewToHire": ("interviewAt", "hiredAt"),
}
STAGES = ("createdAt", "acceptedAt", "declinedAt", "interviewAt", "hiredAt", "rejectedAt")


@dataclass(frozen=True)
class Policy:
    """Thresholds; every operator takes them as arguments with these defaults."""

    min_subjects: int = 10
    lateness: timedelta = timedelta(hours=24)
    future_skew: timedelta = timedelta(minutes=5)
    bronze_days: int = 7
    quarantine_days: int = 7
    silver_days: int = 30
    terminal_days: int = 30
    open_days: int = 180
    snapshot_days: int = 30
    marker_days: int = 31
    late_days: int = 30
    max_envelope_bytes: int = 256 * 1024
    stage_buckets: int = 32


POLICY = Policy()


@dataclass(frozen=True)
class TableSpec:
    """A table's columns in order, its checks, how subjects are attributed in it, and how its files are laid out.

    ``part`` is the expression, and its type, that a row's folder is named by; a table without one is small.
    """

    name: str
    ddl: str
    checks: tuple[str, ...] = ()
    tokens: str | None = None
    key: tuple[str, ...] = field(default=())
    part: tuple[str, str] | None = None

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_FACT = "applicationId STRING, jobId STRING, newStatus STRING, jobSkills ARRAY<STRING>"
_OFFSETS = ("partition >= 0", "offset >= 0")
_ENUMS = (_one_of("eventType", EVENT_TYPES), _one_of("aggregateType", AGGREGATE_TYPES))
_DAY, _EXPIRY_DAY = ("to_date(occurredAt)", "DATE"), ("to_date(expiresAt)", "DATE")
_BUCKET = (f"pmod(xxhash64(applicationId), {POLICY.stage_buckets})", "BIGINT")
_HOURS = "p50Hours DOUBLE NOT NULL, p75Hours DOUBLE NOT NULL, p90Hours DOUBLE NOT NULL, p95Hours DOUBLE NOT NULL"
_ORDERED = "p50Hours <= p75Hours AND p75Hours <= p90Hours AND p90Hours <= p95Hours"

_TABLES = (
    TableSpec(
        "bronze_operational_events",
        "topic STRING NOT NULL, partition INT NOT NULL, offset BIGINT NOT NULL, kafkaTimestamp TIMESTAMP, eventId STRING NOT NULL, eventType STRING NOT NULL, occurredAt TIMESTAMP NOT NULL, "
        f"aggregateType STRING NOT NULL, aggregateId STRING NOT NULL, eventFingerprint STRING NOT NULL, {_FACT}, subjectToken STRING NOT NULL, subjectTokens ARRAY<STRING> NOT NULL, ingestedAt TIMESTAMP NOT NULL, expiresAt TIMESTAMP NOT NULL",
        (*_ENUMS, *_OFFSETS, "expiresAt > ingestedAt"),
        "subjectTokens",
        ("topic", "partition", "offset"),
        _DAY,
    ),
    TableSpec(
        "silver_operational_events",
        f"eventId STRING NOT NULL, eventType STRING NOT NULL, occurredAt TIMESTAMP NOT NULL, aggregateType STRING NOT NULL, aggregateId STRING NOT NULL, {_FACT}, subjectToken STRING NOT NULL, subjectTokens ARRAY<STRING> NOT NULL, "
        "eventFingerprint STRING NOT NULL, ingestedAt TIMESTAMP NOT NULL, expiresAt TIMESTAMP NOT NULL",
        (*_ENUMS, "expiresAt > ingestedAt"),
        "subjectTokens",
        ("eventId",),
        _DAY,
    ),
    TableSpec(
        "silver_application_stage_times",
        "applicationId STRING NOT NULL, subjectToken STRING NOT NULL, subjectTokens ARRAY<STRING> NOT NULL, " + ", ".join(f"{s} TIMESTAMP" for s in STAGES) + ", lastEventAt TIMESTAMP NOT NULL, terminalAt TIMESTAMP, expiresAt TIMESTAMP NOT NULL",
        ("terminalAt IS NULL OR expiresAt > terminalAt",),
        "subjectTokens",
        ("applicationId",),
        _BUCKET,
    ),
    TableSpec(
        "silver_late_operational_events",
        "eventId STRING NOT NULL, eventFingerprint STRING NOT NULL, eventType STRING NOT NULL, topic STRING NOT NULL, partition INT NOT NULL, offset BIGINT NOT NULL, occurredAt TIMESTAMP NOT NULL, "
        f"aggregateType STRING NOT NULL, aggregateId STRING NOT NULL, {_FACT}, subjectToken STRING NOT NULL, subjectTokens ARRAY<STRING> NOT NULL, admissionReason STRING NOT NULL, ingestedAt TIMESTAMP NOT NULL, expiresAt TIMESTAMP NOT NULL",
        (*_ENUMS, *_OFFSETS, "expiresAt > ingestedAt"),
        "subjectTokens",
        ("topic", "partition", "offset"),
        _DAY,
    ),
    TableSpec(
        "quarantine_operational_events",
        "topic STRING NOT NULL, partition INT NOT NULL, offset BIGINT NOT NULL, payloadHash STRING, subjectTokens ARRAY<STRING> NOT NULL, quarantineId STRING NOT NULL, quarantineReason STRING NOT NULL, expiresAt TIMESTAMP NOT NULL",
        _OFFSETS,
        "subjectTokens",
        ("quarantineId",),
        _EXPIRY_DAY,
    ),
    TableSpec("gold_application_funnel", "day DATE NOT NULL, " + ", ".join(f"{c} BIGINT NOT NULL" for c in ("created", *map(str.lower, STATUSES))), tuple(f"{c} >= 0" for c in ("created", *map(str.lower, STATUSES))), part=("day", "DATE")),
    TableSpec("gold_time_to_hire", f"{_HOURS}, eligibleCount BIGINT NOT NULL, excludedCount BIGINT NOT NULL", (_ORDERED, "eligibleCount >= 0", "excludedCount >= 0")),
    TableSpec("gold_hiring_stage_durations", f"metric STRING NOT NULL, {_HOURS}, eligibleCount BIGINT NOT NULL", (_one_of("metric", tuple(METRICS)), _ORDERED, f"eligibleCount >= {POLICY.min_subjects}")),
    TableSpec("gold_job_skills", "day DATE NOT NULL, skill STRING NOT NULL, postings BIGINT NOT NULL", ("postings >= 0",), part=("day", "DATE")),
    TableSpec(
        "control_run_manifests",
        "runId STRING NOT NULL, topic STRING NOT NULL, partition INT NOT NULL, startOffset BIGINT NOT NULL, endOffsetExclusive BIGINT NOT NULL, status STRING NOT NULL, updatedAt STRING NOT NULL",
        ("endOffsetExclusive >= startOffset",),
        key=("runId", "topic", "partition"),
    ),
    TableSpec(
        "control_streaming_progress",
        "lineage STRING NOT NULL, batchId BIGINT NOT NULL, observedAt TIMESTAMP NOT NULL, priorWatermark TIMESTAMP, inputFingerprint STRING NOT NULL, sourceEndOffsets STRING NOT NULL, deliveredOffsets STRING NOT NULL, "
        "outcome STRING NOT NULL, candidateWatermark TIMESTAMP, completedAt TIMESTAMP",
        key=("lineage", "batchId"),
    ),
    TableSpec(
        "control_streaming_decisions",
        "lineage STRING NOT NULL, batchId BIGINT NOT NULL, revision INT NOT NULL, deletionMarkerFingerprint STRING NOT NULL, candidateWatermark TIMESTAMP, publicationRunId STRING NOT NULL, publicationRangeFingerprint STRING NOT NULL, "
        "publicationGeneration BIGINT NOT NULL, publicationRevision BIGINT NOT NULL",
        key=("lineage", "batchId", "revision"),
    ),
    TableSpec(
        "control_streaming_assessments",
        "lineage STRING NOT NULL, batchId BIGINT NOT NULL, observedAt TIMESTAMP NOT NULL, priorWatermark TIMESTAMP, markerFingerprint STRING NOT NULL, outcome STRING NOT NULL, conflicts STRING NOT NULL, admitted STRING NOT NULL, evidence STRING NOT NULL",
        key=("lineage", "batchId"),
    ),
    TableSpec("control_stale_days", "day DATE NOT NULL", key=("day",)),
    TableSpec("control_report", "state STRING NOT NULL, generation BIGINT NOT NULL, revision BIGINT NOT NULL, runId STRING NOT NULL, asOf TIMESTAMP NOT NULL, expiresAt TIMESTAMP NOT NULL", ("expiresAt > asOf",), key=("generation", "revision")),
    TableSpec("report_snapshots", "generation BIGINT NOT NULL, revision BIGINT NOT NULL, runId STRING NOT NULL, state STRING NOT NULL, asOf TIMESTAMP NOT NULL, expiresAt TIMESTAMP NOT NULL, report STRING NOT NULL", ("expiresAt > asOf",), key=("generation", "revision")),
    TableSpec("control_hmac_key_registry", "keyId STRING NOT NULL, verifier STRING NOT NULL", key=("keyId",)),
)
TABLES: dict[str, TableSpec] = {t.name: t for t in _TABLES}
#: Tables that hold subjects' rows.
SUBJECT_TABLES = tuple(t.name for t in _TABLES if t.tokens)
