"""Composite jobs over the declared tables: batch and stream publication, replay, erasure, audits."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import set_digest
from ..functions.joins import met
from ..operators import envelopes, facts, privacy, reports
from ..sources import events, snapshots
from ..sources import tables as store
from ..sources.shared import shared_path
from ..specs import POLICY, SUBJECT_TABLES, TABLES
from ..streaming import batches, journal

GOLD = ("gold_application_funnel", "gold_time_to_hire", "gold_hiring_stage_durations", "gold_job_skills")


#: Deletion markers, or what reads them as they are when asked.
Markers = DataFrame | Callable[[], DataFrame]


def current(markers: Markers) -> DataFrame:
    return markers() if callable(markers) else markers


@dataclass(frozen=True)
class Lake:
    """Where the tables are, and the primary subject key."""

    spark: SparkSession
    base: str
    key_id: str
    key: bytes

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def read(self, name: str, parts: list | None = None) -> DataFrame:
        """The table, or only its folders ``parts``."""
        return store.read_or_empty(self.spark, self.path(name), TABLES[name], parts)

    def write(self, name: str, df: DataFrame) -> None:
        store.write_table(store.conform(df, TABLES[name]), self.path(name), TABLES[name])

    def merge(self, name: str, source: DataFrame) -> int:
        """Insert-only by the table's key: the rows that are missing are appended, and counted."""
        spec = TABLES[name]
        rows = store.conform(source, spec).persist()
        try:
            return 0 if rows.isEmpty() else store.append_rows(store.new_rows(self.read(name), rows, list(spec.key)), self.path(name), spec)
        finally:
            rows.unpersist()

    def mark_stale(self, days: list) -> None:
        """Note, before facts change, which days' reports will no longer hold; a rebuild clears it."""
        rows = self.spark.createDataFrame([(d,) for d in days], TABLES["control_stale_days"].schema)
        if days and self.merge("control_stale_days", rows) > 64:
            store.compact(self.spark, self.path("control_stale_days"), TABLES["control_stale_days"], 4)

    def stale_days(self) -> list:
        return sorted(r["day"] for r in self.read("control_stale_days").distinct().collect())


def prepared(lake: Lake, records: DataFrame) -> DataFrame:
    """Parsed, fingerprinted, validated and tokenised records, stored once for the passes that follow."""
    parsed = envelopes.with_validity(envelopes.with_fingerprint(envelopes.parse_records(records)))
    return privacy.with_subject_tokens(parsed, lake.key_id, lake.key).persist()


@dataclass(frozen=True)
class Pass:
    """What one pass over a batch sees; two passes must see the same before anything is published."""

    quality: dict[str, int]
    conflicts: str
    admitted: str

    @property
    def outcome(self) -> str:
        return "QualityBlocked" if _blocked(self.quality) else "Published"


def _conflicts(lake: Lake, valid: DataFrame, now: datetime) -> DataFrame:
    """Event ids of the batch that conflict with one another, with history or with a stored coordinate."""
    stored = facts.stored_fingerprints(lake.read("silver_operational_events"), lake.read("silver_late_operational_events"), now)
    bronze = store.bound_target(lake.read("bronze_operational_events"), valid, list(facts.COORDINATE))
    return facts.all_conflicts(facts.conflicting_ids(valid), facts.historical_conflicts(valid, stored), facts.coordinate_conflicts(valid, bronze))


def _kept_aside(lake: Lake, df: DataFrame) -> tuple[str, DataFrame]:
    """A stored copy: a cached one would be made anew after every append to a table that it reads."""
    path = shared_path(lake.spark)
    df.write.parquet(path)
    return path, lake.spark.read.schema(df.schema).parquet(path)


def _seen(known: DataFrame, conflicts: DataFrame, admitted: DataFrame, now: datetime, watermark: datetime | None) -> Pass:
    quality = facts.admission_quality(known, conflicts, now, watermark).first().asDict()
    digest = lambda df: df.select("eventId").distinct().agg(set_digest("eventId").alias("d")).first()["d"]
    return Pass(quality, digest(conflicts), digest(admitted))


def assess(lake: Lake, known: DataFrame, markers: DataFrame, now: datetime, watermark: datetime | None) -> tuple[Pass, str]:
    """The read-only first pass: its result, and where its conflict ids are kept."""
    valid = known.where("isValidEvent")
    seen = batches.assess(valid, lake.read("silver_operational_events"), lake.read("bronze_operational_events"), now, watermark, _conflicts(lake, valid, now))
    path, seen = _kept_aside(lake, seen.select("eventId", "conflict", "admission", "subjectTokens", *facts.COORDINATE))
    conflicts = seen.where("conflict").select("eventId").distinct()
    admitted = privacy.exclude_markers(seen.where("not conflict and admission.status = 'OPEN'"), markers)
    return _seen(known, conflicts, admitted, now, watermark), path


def _ingest(lake: Lake, known: DataFrame, markers: DataFrame, now: datetime, watermark: datetime | None) -> tuple[Pass, DataFrame, str]:
    """The second pass: Bronze, quarantine, late facts, stage times, then Silver; every step may be run again.

    Gives what it saw, its conflict ids, and where they are kept until the caller removes them.
    """
    valid = known.where("isValidEvent")
    history, known_late = lake.read("silver_operational_events"), lake.read("silver_late_operational_events")
    path, conflicts = _kept_aside(lake, _conflicts(lake, valid, now))
    clean = privacy.exclude_markers(facts.without_ids(valid, conflicts), markers)
    admitted = facts.with_admission(clean, now, watermark).persist()
    seen = _seen(known, conflicts, admitted.where("admission.status = 'OPEN'"), now, watermark)
    bronze = facts.with_expiry(facts.to_bronze(privacy.exclude_markers(valid, markers)), now, POLICY.bronze_days)
    lake.merge("bronze_operational_events", bronze)
    bad = facts.quarantine_union(known.where("not isValidEvent"), facts.conflict_rows(valid, conflicts), now)
    future = facts.to_quarantine(admitted.where("admission.status = 'FUTURE'"), F.lit(envelopes.FUTURE), now, future=True)
    lake.merge("quarantine_operational_events", bad.unionByName(future))
    closed = facts.to_late_facts(admitted.where("admission.status = 'CLOSED'").withColumns(facts._facts(admitted)), markers, now)
    lake.merge("silver_late_operational_events", facts.late_not_admitted(closed, history, conflicts, known_late))
    silver = facts.with_expiry(facts.to_silver(admitted.where("admission.status = 'OPEN'").drop("admission"), markers, conflicts), now, POLICY.silver_days)
    add_facts(lake, silver)
    admitted.unpersist()
    return seen, conflicts, path


def add_facts(lake: Lake, silver: DataFrame) -> None:
    """Stage times before Silver, so that a crash between them is repaired by running again.

    Only the stage-time buckets that the facts' applications lie in are read, and only those in
    which something changes are written.
    """
    spec = TABLES["silver_application_stage_times"]
    silver = silver.persist()
    try:
        lake.mark_stale(store.parts_of(silver, TABLES["silver_operational_events"]))
        store.upsert_parts(store.conform(reports.stage_times(silver), spec), lake.path(spec.name), spec, reports.merge_stage_times)
        lake.merge("silver_operational_events", silver)
    finally:
        silver.unpersist()


def expired_days(lake: Lake, name: str, as_of: datetime) -> list:
    """The folders with rows that have expired and are still stored."""
    return store.parts_of(lake.read(name).where(F.col("expiresAt") <= F.lit(as_of)), TABLES[name])


def rebuild_gold(lake: Lake, as_of: datetime, k: int = POLICY.min_subjects, exact: bool = False, days: list | None = None) -> None:
    """Report tables from Silver and stage times; an absent source clears them.

    With ``days``, the daily reports of those days alone are made anew, from those days' folders,
    and written over them; a day that has nothing to report any more goes.  The two tables of
    hours are one row, or five, over all stage times that are in force.
    """
    daily = {"gold_application_funnel": reports.wide_funnel_day, "gold_job_skills": reports.skill_postings}
    if days is None or days:
        silver = facts.unexpired(lake.read("silver_operational_events", days), as_of)
        for name, report in daily.items():
            rows = store.conform(report(silver, k), TABLES[name])
            if days is None:
                lake.write(name, rows)
            else:
                store.replace_parts(rows, lake.path(name), TABLES[name], days)
    times = reports.current_stage_times(lake.read("silver_application_stage_times"), as_of)
    lake.write("gold_time_to_hire", reports.time_to_hire(times, k, exact))
    lake.write("gold_hiring_stage_durations", reports.stage_durations(times, k, exact))


def refresh_gold(lake: Lake, as_of: datetime, k: int = POLICY.min_subjects) -> list:
    """Make anew the reports of the days whose facts have changed or expired; gives those days."""
    days = sorted({*lake.stale_days(), *expired_days(lake, "silver_operational_events", as_of)})
    rebuild_gold(lake, as_of, k, days=days)
    if days:
        lake.write("control_stale_days", lake.read("control_stale_days").limit(0))
    return days


def _blocked(quality: dict[str, int]) -> bool:
    return quality["malformed"] + quality["conflicting"] + quality["future"] > 0


def publish(lake: Lake, run_id: str, as_of: datetime, k: int = POLICY.min_subjects) -> str:
    """Rebuild the reports and publish their extract as the next snapshot; gives the verdict.

    A run that was published already is not published again.  The snapshot is written before the
    control row that points to it, so a crash between them leaves the former report in force;
    the snapshot of the broken run is then replaced.  Expired snapshots go.
    """
    control = lake.read("control_report")
    held = control.first()
    generation, revision = (held["generation"], held["revision"]) if held else (0, -1)
    following = revision if held and held["runId"] == run_id else revision + 1
    expires = as_of + timedelta(days=POLICY.snapshot_days)
    row = [(run_id, generation, following, as_of, expires)]
    request = lake.spark.createDataFrame(row, "runId STRING, generation BIGINT, revision BIGINT, asOf TIMESTAMP, expiresAt TIMESTAMP")
    verdict = snapshots.publication_decision(control, request).first()["verdict"]
    if verdict != "PUBLISH":
        return verdict
    refresh_gold(lake, as_of, k)
    report = snapshots.as_json(snapshots.extract_report({n: lake.read(n) for n in GOLD}, as_of))
    shot = request.withColumns({"state": F.lit("published"), "report": F.lit(report)})
    kept = store.expire(lake.read("report_snapshots"), as_of)
    lake.write("report_snapshots", store.merge_upsert(kept, shot, list(TABLES["report_snapshots"].key)))
    lake.write("control_report", snapshots.publish_snapshot(control, request))
    return verdict


def latest_report(lake: Lake, now: datetime) -> DataFrame:
    """The snapshot that is in force, or no row."""
    return snapshots.latest_snapshot(lake.read("control_report"), lake.read("report_snapshots"), now)


def _manifest(lake: Lake, run_id: str, ranges: DataFrame, status: str, at: datetime) -> None:
    rows = ranges.select(F.lit(run_id).alias("runId"), "topic", "partition", "startOffset", "endOffsetExclusive", F.lit(status).alias("status"), F.lit(at.isoformat()).alias("updatedAt"))
    spec = TABLES["control_run_manifests"]
    lake.write(spec.name, store.merge_upsert(lake.read(spec.name), store.conform(rows, spec), list(spec.key)))


def run_batch(lake: Lake, run_id: str, ranges: DataFrame, records: DataFrame, markers: Markers, now: datetime, erasing: bool = False, k: int = POLICY.min_subjects) -> str:
    """Bounded publication of the records of a manifest's offset ranges; gives the outcome.

    Refused: a range without offsets, a run id that was recorded with other ranges, records that
    do not cover the ranges exactly.  Malformed, conflicting or future records block the reports,
    as does an erasure in progress; the manifest names how the run ended.  A run that broke off
    is run again; one that was published is not.
    """
    keys = ["topic", "partition", "startOffset", "endOffsetExclusive"]
    if ranges.isEmpty() or not ranges.where("startOffset IS NULL OR endOffsetExclusive IS NULL OR endOffsetExclusive <= startOffset").isEmpty():
        raise ValueError("a manifest names ranges that hold offsets")
    held = lake.read("control_run_manifests").where(F.col("runId") == run_id)
    if not held.isEmpty():
        if not held.select(*keys).exceptAll(ranges.select(*keys)).isEmpty() or not ranges.select(*keys).exceptAll(held.select(*keys)).isEmpty():
            raise ValueError("the run was recorded with other ranges")
        if held.first()["status"] == "Published":
            return "Published"
    if not events.offset_coverage(records, ranges).where("verdict <> 'COMPLETE'").isEmpty():
        raise ValueError("the records do not cover the ranges")
    _manifest(lake, run_id, ranges, "Started", now)
    purge(lake, markers)
    known = prepared(lake, records)
    try:
        seen = _two_passes(lake, known, markers, now, None)
    finally:
        known.unpersist()
    outcome = "ErasurePending" if erasing and seen.outcome == "Published" else seen.outcome
    if outcome == "Published" and publish(lake, run_id, now, k) not in ("PUBLISH", "ALREADY_PUBLISHED"):
        raise ValueError("the report was refused")
    _manifest(lake, run_id, ranges, outcome, now)
    return outcome


class BatchChanged(ValueError):
    """The second pass over a batch saw other facts than the first."""


def _two_passes(lake: Lake, known: DataFrame, markers: Markers, now: datetime, watermark: datetime | None, keep=None) -> Pass:
    """Assess, then ingest; refused if a conflict appeared between the passes, or what they admit differs.

    Each pass takes the deletion markers as they are when it begins.  ``keep`` stores the first
    pass's result before anything is written.
    """
    first, assessed = assess(lake, known, current(markers), now, watermark)
    if keep:
        keep(first)
    path = None
    try:
        second, conflicts, path = _ingest(lake, known, current(markers), now, watermark)
        before = lake.spark.read.parquet(assessed).where("conflict").select("eventId").distinct()
        if not facts.new_conflicts(conflicts, before).isEmpty():
            raise BatchChanged("a conflict appeared between the passes")
        if first != second:
            raise BatchChanged("the passes saw different facts")
        return second
    finally:
        for p in (assessed, path):
            if p:
                store.remove(lake.spark, p)


def process_batch(lake: Lake, records: DataFrame, batch: int, markers: Markers, now: datetime, lineage: str = "main", k: int = POLICY.min_subjects, erasing: bool = False) -> str:
    """One micro-batch under the journal: a batch that ended is not run again, one that broke off is resumed.

    The batch is assessed and ingested in two passes that must agree.  A publication is decided on
    before it is made, under the markers as they are then; if they change before the decision is
    carried out, it is taken anew, three times at most (``journal.decide``).  While an erasure is in
    progress the records are kept and the reports wait.
    """
    spark = lake.spark
    progress = lake.read("control_streaming_progress")
    held = progress.where((F.col("lineage") == lineage) & (F.col("batchId") == batch)).first()
    if held and held["outcome"] in journal.TERMINAL:
        return held["outcome"]
    known = prepared(lake, records)
    try:
        prints = facts.input_fingerprint(known).orderBy("topic", "partition")
        evidence = prints.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("*")))), 256).alias("f"), F.to_json(F.sort_array(F.collect_list(F.struct("topic", "partition", "endOffsetExclusive")))).alias("o")).first()
        mark = journal.latest_watermark(progress, lineage).first()["watermark"]
        row = spark.createDataFrame([(lineage, batch, now, mark, evidence["f"], evidence["o"], evidence["o"], journal.PREPARED, None, None)], TABLES["control_streaming_progress"].schema)
        lake.write("control_streaming_progress", journal.journal_prepare(progress, row))

        def keep(first: Pass) -> None:
            seen = journal.marker_fingerprint(current(markers)).first()["fingerprint"]
            told = spark.createDataFrame([(lineage, batch, now, mark, seen, first.outcome, first.conflicts, first.admitted, json.dumps(first.quality, sort_keys=True))], TABLES["control_streaming_assessments"].schema)
            lake.write("control_streaming_assessments", store.merge_upsert(lake.read("control_streaming_assessments"), told, ["lineage", "batchId"]))

        seen = _two_passes(lake, known, markers, now, mark, keep)
        lake.write("control_streaming_progress", journal.journal_move(lake.read("control_streaming_progress"), lineage, batch, journal.INGESTED, now))
        outcome, new_mark = "ErasurePending" if erasing and seen.outcome == "Published" else seen.outcome, None
        if outcome == "Published":
            new_mark = _publish_batch(lake, known, batch, lineage, markers, mark, evidence["f"], now, k)
        lake.write("control_streaming_progress", journal.journal_move(lake.read("control_streaming_progress"), lineage, batch, outcome, now, new_mark))
        return outcome
    finally:
        known.unpersist()


def candidate_mark(lake: Lake, known: DataFrame, mark: datetime | None, now: datetime, k: int) -> datetime | None:
    """The watermark after a batch, over its events that the reports show; only the days it touches are read."""
    spec = TABLES["silver_operational_events"]
    ids = known.where("isValidEvent").select("eventId", "occurredAt")
    days = lake.read(spec.name, store.parts_of(ids, spec))
    mine = met(days, ids, ["eventId"])
    rest = days.join(mine.select("eventId"), "eventId", "left_anti")
    return batches.visible_watermark(rest, mine, mark, now, k).first()["watermark"]


def _publish_batch(lake: Lake, known: DataFrame, batch: int, lineage: str, markers: Markers, mark: datetime | None, evidence: str, now: datetime, k: int) -> datetime | None:
    """Decide and publish; gives the new watermark.

    A decision that was stored under the same markers keeps its watermark; under others it is made anew.
    """
    run_id, mine = f"{lineage}-{batch}", (F.col("lineage") == lineage) & (F.col("batchId") == batch)
    while True:
        seen = journal.marker_fingerprint(current(markers)).first()["fingerprint"]
        decisions = lake.read("control_streaming_decisions")
        last = journal.latest_decisions(decisions.where(mine)).first()
        if last is None or last["deletionMarkerFingerprint"] != seen:
            control = lake.read("control_report").first()
            ahead = (control["generation"], control["revision"] + 1) if control else (0, 0)
            row = (lineage, batch, 0, seen, candidate_mark(lake, known, mark, now, k), run_id, evidence, *ahead)
            decided = lake.spark.createDataFrame([row], TABLES["control_streaming_decisions"].schema)
            lake.write("control_streaming_decisions", journal.decide(decisions, decided))
            last = decided.first()
        if journal.marker_fingerprint(current(markers)).first()["fingerprint"] == seen:
            break
    if publish(lake, run_id, now, k) not in ("PUBLISH", "ALREADY_PUBLISHED"):
        raise ValueError("the report was refused")
    return last["candidateWatermark"]


def assert_startable(lake: Lake, checkpoint: str, lineage: str = "main", topic: str = "") -> None:
    """Raise if the journal and a streaming checkpoint contradict one another."""
    empty = "batchId BIGINT, endOffsets MAP<STRING, BIGINT>, committed BOOLEAN"
    held = events.read_checkpoint(lake.spark, checkpoint, topic) if store.exists(lake.spark, f"{checkpoint}/commits") else lake.spark.createDataFrame([], empty)
    if why := journal.refusals(lake.read("control_streaming_progress"), held, lineage):
        raise ValueError(f"the stream can't start: {'; '.join(why)}")


def run_stream(lake: Lake, source: DataFrame, markers: Markers, checkpoint: str, clock=datetime.utcnow, k: int = POLICY.min_subjects, topic: str = ""):
    """Process all that is available, batch by batch; refused if journal and checkpoint contradict one another."""
    assert_startable(lake, checkpoint, topic=topic)
    query = batches.start_stream(source, lambda df, batch: process_batch(lake, df, batch, markers, clock(), k=k) and None, checkpoint)
    query.awaitTermination()
    return query


def select_replay(late: DataFrame, coordinates: DataFrame, silver: DataFrame, markers: DataFrame, now: datetime, most: int = 1000) -> DataFrame:
    """Late facts of explicit coordinates; refused if any is missing, expired, marked or conflicting."""
    asked = coordinates.select(*facts.COORDINATE).distinct()
    n = asked.count()
    if not 0 < n <= most:
        raise ValueError("a replay names 1 to 1000 coordinates")
    found = late.join(F.broadcast(asked), list(facts.COORDINATE), "left_semi")
    live = facts.unexpired(found.where("eventFingerprint is not null and eventId is not null"), now)
    if live.select(*facts.COORDINATE).distinct().count() != n:
        raise ValueError("a coordinate is missing, malformed or expired")
    if privacy.exclude_markers(live, markers).count() != live.count():
        raise ValueError("a coordinate belongs to a marked subject")
    if not facts.historical_conflicts(live, silver).isEmpty():
        raise ValueError("a coordinate conflicts with a stored event")
    return facts.first_by(live, ["eventId"], ["expiresAt", "ingestedAt", "topic", "partition", "offset"])


def replay_late_facts(lake: Lake, coordinates: DataFrame, markers: DataFrame, now: datetime, k: int = POLICY.min_subjects) -> str:
    """Put selected late facts into Silver and stage times, and publish again; a second run changes nothing."""
    chosen = select_replay(lake.read("silver_late_operational_events"), coordinates, lake.read("silver_operational_events"), markers, now)
    silver = chosen.select(*[c for c in TABLES["silver_operational_events"].schema.fieldNames() if c in chosen.columns])
    silver = facts.with_expiry(silver.drop("ingestedAt", "expiresAt"), now, POLICY.silver_days)
    add_facts(lake, store.merge_when_fresh(silver.limit(0), silver, ["eventId"], now))
    run_id = f"replay-{facts.selection_digest(coordinates).first()['digest'][:16]}"
    return "Published" if publish(lake, run_id, now, k) in ("PUBLISH", "ALREADY_PUBLISHED") else "Refused"


def purge(lake: Lake, markers: Markers) -> list[str]:
    """Delete marked rows from every subject table that holds some, folder by folder; gives the tables."""
    markers = current(markers)
    if markers.isEmpty():
        return []
    held = {n: lake.read(n) for n in SUBJECT_TABLES}
    hit = sorted(r["table"] for r in privacy.count_marked(held, markers).where("marked > 0").collect())
    for name in hit:
        spec = TABLES[name]
        events_too = name != "quarantine_operational_events"
        marked = privacy.matched_by_subject(held[name], markers, spec.key)
        gone = marked.unionByName(held[name].where(F.size("subjectTokens") == 0)) if events_too else marked
        if name == "silver_operational_events":
            lake.mark_stale(store.parts_of(gone, spec))
        store.delete_where(lake.spark, lake.path(name), spec, gone, lambda rows, spec=spec, events_too=events_too: privacy.purge_marked(rows, markers, spec.key, event_table=events_too))
    return hit


def listed_files(lake: Lake, name: str) -> DataFrame:
    """``(path, content)`` of a table's data files; content is read only by who asks for it."""
    return lake.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(lake.path(name)).select("path", "content")


def erasure_evidence(lake: Lake, markers: DataFrame) -> DataFrame:
    """``(table, file)``: the files that hold marked rows before an erasure."""
    out = lake.spark.createDataFrame([], "table STRING, file STRING")
    for name in SUBJECT_TABLES:
        if store.exists(lake.spark, lake.path(name)):
            found = privacy.marked_files(lake.spark.read.schema(TABLES[name].schema).parquet(lake.path(name)), markers, ownerless=name != "quarantine_operational_events")
            out = out.unionByName(found.select(F.lit(name).alias("table"), "file"))
    return out


def run_erasure(lake: Lake, subjects: DataFrame, keys: dict[str, bytes], now: datetime, k: int = POLICY.min_subjects, deadline: datetime | None = None) -> DataFrame:
    """Mark, name the files, purge, make the touched reports anew, publish and verify.

    Gives by table the marked rows left (0), the files that held some, and those of them that are
    still there (0); refused if any row or file is left, or if ``deadline`` has passed.  Replaced
    folders are deleted as they are replaced, so no old version outlives the erasure.
    """
    if deadline is not None and now > deadline:
        raise ValueError("the deadline of the erasure has passed")
    markers = privacy.marker_tokens(subjects, keys).persist()
    aside, evidence = _kept_aside(lake, erasure_evidence(lake, markers))
    try:
        purge(lake, markers)
        if lake.stale_days():
            publish(lake, f"erasure-{now.isoformat()}", now, k)
        held = {n: lake.read(n) for n in SUBJECT_TABLES}
        privacy.assert_absent(held, markers)
        files = evidence.groupBy("table").agg(F.count("*").alias("files"))
        left = lake.spark.createDataFrame([], "table STRING, filesLeft BIGINT")
        for name in [r["table"] for r in files.collect()]:
            still = privacy.files_left(evidence.where(F.col("table") == name), listed_files(lake, name))
            left = left.unionByName(still.agg(F.count("*").alias("filesLeft")).select(F.lit(name).alias("table"), "filesLeft"))
        told = privacy.count_marked(held, markers).join(files, "table", "left").join(left, "table", "left").na.fill(0).collect()
        if any(r["filesLeft"] for r in told):
            raise ValueError("files that held marked rows are still there")
        return lake.spark.createDataFrame(told, "table STRING, marked BIGINT, files BIGINT, filesLeft BIGINT")
    finally:
        store.remove(lake.spark, aside)
        markers.unpersist()


def audit_key(lake: Lake, key_id: str, now: datetime | None = None) -> DataFrame:
    """What still refers to a key id, by table and kind; a key may be retired once all are 0.

    Kinds: rows with its text in any column, files with it in their bytes, unexpired rows whose
    primary token is the key's, and tokens that are the key's or of no known form.
    """
    out, needle = lake.spark.createDataFrame([], "table STRING, kind STRING, rows BIGINT"), f"{key_id}_"
    counted = lambda df, name, kind: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit(kind).alias("kind"), "rows")
    for name in TABLES:
        df = lake.read(name)
        out = out.unionByName(counted(privacy.find_text_reference(df, needle), name, "row"))
        if store.exists(lake.spark, lake.path(name)):
            out = out.unionByName(counted(privacy.files_with_text(listed_files(lake, name), needle), name, "file"))
        if name in SUBJECT_TABLES:
            if "subjectToken" in df.columns:
                live = df.where((F.col("expiresAt") > F.lit(now)) if now else F.lit(True))
                out = out.unionByName(counted(live.where(F.col("subjectToken").startswith(needle)), name, "primary token"))
            others = sorted(r["keyId"] for r in lake.read("control_hmac_key_registry").where(F.col("keyId") != key_id).select("keyId").collect())
            out = out.unionByName(counted(privacy.invalid_tokens({name: df}, others or ["no-key"]), name, "token"))
    return out


def backfill_stage_times(lake: Lake, markers: DataFrame) -> None:
    """First fill of stage times from Silver, without applications that a marker touches."""
    silver = privacy.without_marked_applications(lake.read("silver_operational_events"), markers)
    lake.write("silver_application_stage_times", reports.stage_times(silver))


def maintenance_tick(lake: Lake, markers: Markers, now: datetime, files: int = 8, k: int = POLICY.min_subjects, erasing: bool = False, compacted: datetime | None = None, every: timedelta = timedelta(0)) -> str:
    """Expire, purge, refresh the reports of the days concerned and publish them, prune the journal, compact and reclaim.

    Only folders with expired or marked rows are written.  While an erasure is in progress nothing
    is compacted; otherwise folders of many files are, once ``every`` has passed since ``compacted``.
    """
    for name in SUBJECT_TABLES:
        gone = lake.read(name).where(F.col("expiresAt") <= F.lit(now))
        if name == "silver_operational_events":
            lake.mark_stale(store.parts_of(gone, TABLES[name]))
        store.delete_where(lake.spark, lake.path(name), TABLES[name], gone, lambda rows: store.expire(rows, now))
    purge(lake, markers)
    days = lake.stale_days()
    verdict = publish(lake, f"tick-{now.isoformat()}", now, k) if days else "UNCHANGED"
    progress, decisions = lake.read("control_streaming_progress"), lake.read("control_streaming_decisions")
    kept = journal.prune_progress(progress, decisions, progress.limit(0).select("lineage", "batchId"), now)
    if kept.count() < progress.count():
        lake.write("control_streaming_progress", kept)
        orphans = journal.orphan_decisions(lake.read("control_streaming_progress"), decisions)
        if not orphans.isEmpty():
            key = list(TABLES["control_streaming_decisions"].key)
            lake.write("control_streaming_decisions", decisions.join(orphans.select(*key), key, "left_anti"))
    for name in TABLES if not erasing else ():
        store.compact(lake.spark, lake.path(name), TABLES[name], files, now, compacted, every)
        store.reclaim(lake.spark, lake.path(name), now, dry_run=False)
    return verdict
