"""Operators on literal frames: boundaries, faults, recovery."""

from __future__ import annotations

import json
import math
import uuid
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.functions.columns import canonical_set, cosine, haversine_km
from eventloom.operators import discovery, envelopes, evaluation, facts, privacy, reports, retrieval
from eventloom.plans import jobs
from eventloom.sources import events, tables
from eventloom.specs import SEARCH_KINDS, TABLES
from eventloom.streaming import batches, journal

NOW = datetime(2024, 1, 10)
RECORD = "topic string, partition int, offset bigint, value binary, timestamp timestamp"


def uid(n: int) -> str:
    return str(uuid.UUID(int=n))


def envelope(n: int, kind: str, aggregate: str, about: str, payload: dict, at: str = "2024-01-05T10:00:00Z", **extra) -> dict:
    return {"eventId": uid(1000 + n), "eventType": kind, "occurredAt": at, "aggregateType": aggregate, "aggregateId": about, "actorId": uid(1), "payload": payload, **extra}


def created(n: int, **kw) -> dict:
    return envelope(n, "APPLICATION_CREATED", "Application", uid(n + 1), {"applicationId": uid(n + 1), "candidateId": uid(500 + n), "jobId": uid(9), "status": "Created"}, **kw)


def records(spark, bodies: list, start: int = 0):
    rows = [("t", 0, start + i, b if b is None else (b if isinstance(b, str) else json.dumps(b)).encode(), NOW) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, RECORD)


def validity(spark, bodies: list) -> list[bool]:
    df = envelopes.with_validity(envelopes.parse_records(records(spark, bodies)))
    return [r["isValidEvent"] for r in df.orderBy("offset").collect()]


def test_contract_cases(spark):
    job = lambda **k: envelope(1, "JOB_CREATED", "Job", uid(9), {"job": {"jobId": uid(9), "skills": ["a", "b"], "status": "Open"} | k})
    hit = {"resultId": uid(5), "rank": 1, "score": 0.5}
    search = lambda results: envelope(2, "SEARCH_PERFORMED", "Search", uid(7), {"searchId": uid(7), "searchKind": "jobs", "results": results})
    click = lambda rank: envelope(3, "SEARCH_RESULT_CLICKED", "Search", uid(7), {"searchId": uid(7), "resultId": uid(5), "searchKind": "jobs", "rank": rank})
    view = lambda **k: envelope(4, "JOB_VIEWED", "Search", uid(5), {"searchId": None, "resultId": uid(5), "searchKind": None, "rank": None} | k)
    failed = lambda f: envelope(5, "SEARCH_RECORDING_FAILED", "Search", uid(7), {"searchId": uid(7), "searchKind": "jobs", "failure": f})
    no_actor = created(6)
    del no_actor["actorId"]
    twice = json.dumps(created(7))[:-1] + ',"actorId":"' + uid(1) + '"}'
    cases = [
        (created(0), True), (created(0, extra=None), True), (created(0, at="2024-01-05T10:00:00"), False), (created(0) | {"eventType": "NO"}, False),
        (no_actor, False), (twice, False), (None, False), ("no json", False), (created(0) | {"eventId": "x"}, False), (created(0) | {"aggregateId": uid(99)}, False),
        (job(), True), (job(skills=["a", "a"]), False), (job(skills=[" "]), False), (job(skills=[1]), False), (job(skills=["x" * 256]), True), (job(skills=["x" * 257]), False), (job(status="Shut"), False), (job(more=1), True),
        (search([hit]), True), (search([]), True), (search([hit | {"rank": 2}]), False), (search([hit, hit | {"rank": 2}]), False), (search([{"resultId": uid(5), "rank": 1}]), False), (search([hit | {"score": "1"}]), False),
        (click(1), True), (click(101), False), (click("1"), False), (view(), True), (view(searchId=uid(7), rank=3), True), (view(searchId=uid(7)), False), (failed("Some.Error_1"), True), (failed("not this"), False),
    ]
    assert validity(spark, [c for c, _ in cases]) == [ok for _, ok in cases]


def test_contracts_ask_for_keys_and_failures_of_the_wire_form(spark):
    one = '"eventId":"00000000-0000-4000-8000-000000000001","eventType":"SEARCH_RECORDING_FAILED","occurredAt":"2024-05-01T10:00:00Z","aggregateType":"Search","aggregateId":"00000000-0000-4000-8000-000000000002","actorId":"00000000-0000-4000-8000-000000000003"'

    def body(failure: str, extra: str = "") -> str:
        return '{%s,"payload":{"searchId":"00000000-0000-4000-8000-000000000002","searchKind":"%s","results":[],"failure":%s%s}}' % (one, SEARCH_KINDS[0], failure, extra)

    cases = [(body('"java.io.IOException"'), True), (body('""'), False), (body('"two words"'), False), (body("7"), False), (body("null"), False), (body('"%s"' % ("x" * 101)), False), (body('"a$b"', ',"failure":"c"'), False)]
    df = spark.createDataFrame([(i, text.encode()) for i, (text, _) in enumerate(cases)], "offset long, value binary")
    got = {r["offset"]: r["isValidEvent"] for r in envelopes.with_validity(envelopes.parse_records(df)).select("offset", "isValidEvent").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_tokens_and_days_need_one_scan_each(spark):
    rows = spark.range(10).select(F.lit("JOB_VIEWED").alias("eventType"), F.lit("c").alias("actorId"), F.struct(F.lit("A").alias("candidateId"), F.lit(None).cast("string").alias("searchKind"), F.array(F.struct(F.lit("x").alias("resultId"))).alias("results")).alias("payload"))
    made = privacy.with_subject_tokens(rows, "k1", b"a" * 32)
    assert "Exchange" not in made._jdf.queryExecution().toString() and len(made.first()["subjectTokens"]) == 2
    facts = spark.createDataFrame([("e", "APPLICATION_WITHDRAWN", None, "a", "s", datetime(2024, 5, 1))], "eventId string, eventType string, newStatus string, applicationId string, subjectToken string, occurredAt timestamp")
    plan = reports.wide_funnel_day(facts)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan


def test_suppression_boundary(spark):
    rows = [(f"e{i}", "APPLICATION_CREATED", NOW, f"a{i}", None, f"s{min(i, 8)}" if i < 20 else f"s{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "eventId string, eventType string, occurredAt timestamp, applicationId string, newStatus string, subjectToken string")
    assert reports.wide_funnel_day(df).count() == 0
    more = df.union(spark.createDataFrame([("e99", "APPLICATION_CREATED", NOW, "a99", None, "s99")], df.schema))
    assert reports.wide_funnel_day(more).first()["created"] == 21
    small_cell = more.union(spark.createDataFrame([("x", "APPLICATION_STATUS_CHANGED", NOW, "a99", "Hired", "s99")], df.schema))
    assert reports.wide_funnel_day(small_cell).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 86_400_000_000 * 40), st.integers(0, 40), st.integers(0, 40 * 24))
def test_admission_rule(micros, watermark_day, observed_hour):
    """The expression's pure rule; the expression itself is compared below."""
    start = datetime(2024, 1, 1)
    event, mark, seen = start + timedelta(microseconds=micros), start + timedelta(days=watermark_day), start + timedelta(hours=observed_hour)
    status = rule(event, seen, mark)
    assert status in ("FUTURE", "CLOSED", "OPEN")
    SEEN.append((event, seen, mark, status))


SEEN: list = []


def rule(event: datetime, seen: datetime, mark: datetime) -> str:
    if event > seen + timedelta(minutes=5):
        return "FUTURE"
    end = datetime(event.year, event.month, event.day) + timedelta(days=1)
    return "CLOSED" if end <= mark else "OPEN"


def test_admission_expression_follows_the_rule(spark):
    seen, mark = datetime(2024, 1, 20, 12), datetime(2024, 1, 10)
    edge = [seen + timedelta(minutes=5), seen + timedelta(minutes=5, microseconds=1), datetime(2024, 1, 9, 23, 59, 59, 999999), mark, *[e for e, *_ in SEEN]]
    df = spark.createDataFrame([(e,) for e in edge], "t timestamp").withColumn("a", facts.classify_event_time(F.col("t"), seen, mark))
    for r in df.collect():
        assert r["a"]["status"] == rule(r["t"], seen, mark)
        assert r["a"]["effectiveTime"] == (min(r["t"], seen) if r["a"]["status"] == "OPEN" else None)


def test_tokens_are_keyed_and_ordered(spark):
    df = envelopes.valid_events(envelopes.parse_records(records(spark, [created(0), created(1)])))
    rows = privacy.with_subject_tokens(df, "k1", b"a" * 32).collect()
    for r in rows:
        n = r["offset"]
        assert r["subjectTokens"] == [privacy.token("k1", b"a" * 32, uid(500 + n)), privacy.token("k1", b"a" * 32, uid(1))]
        assert r["subjectToken"] == r["subjectTokens"][0]
    both = privacy.marker_tokens(spark.createDataFrame([(uid(500),)], "subjectId string"), {"k1": b"a" * 32, "k0": b"b" * 32})
    assert {r[0][:3] for r in both.collect()} == {"k1_", "k0_"}


def test_stage_merge_is_idempotent(spark):
    f = spark.createDataFrame([("e1", "APPLICATION_CREATED", NOW, "a", None, "s", ["s"]), ("e2", "APPLICATION_STATUS_CHANGED", NOW + timedelta(days=1), "a", "Hired", "s", ["s", "r"])], "eventId string, eventType string, occurredAt timestamp, applicationId string, newStatus string, subjectToken string, subjectTokens array<string>")
    one = reports.stage_times(f)
    first = reports.merge_stage_times(one.limit(0), one)
    again = reports.merge_stage_times(first.drop("changed"), one)
    assert first.first()["changed"] and not again.first()["changed"]
    assert again.drop("changed").collect() == first.drop("changed").collect()
    assert again.first()["expiresAt"] == NOW + timedelta(days=31)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    return jobs.Lake(spark, str(tmp_path_factory.mktemp("lake")), "k1", b"x" * 32)


def test_stream_replay_and_erasure(spark, lake, tmp_path):
    """Micro-batches under the journal, a resumed batch, late facts, their replay, and an erasure."""
    none = spark.createDataFrame([], "subjectToken string")
    assert jobs.process_batch(lake, records(spark, [created(i) for i in range(12)]), 0, none, NOW) == "Published"
    hired = [envelope(100 + i, "APPLICATION_STATUS_CHANGED", "Application", uid(i + 1), {"applicationId": uid(i + 1), "candidateId": uid(500 + i), "jobId": uid(9), "previousStatus": "Created", "newStatus": "Hired"}, at="2024-01-06T10:00:00Z") for i in range(12)]
    second = records(spark, hired, 50)
    assert jobs.process_batch(lake, second, 1, none, NOW) == "Published"
    assert jobs.process_batch(lake, second, 1, none, NOW) == "Published"
    assert lake.read("gold_time_to_hire").first()["p50Hours"] == 24.0
    mark = journal.latest_watermark(lake.read("control_streaming_progress"), "main").first()["watermark"]
    assert mark == datetime(2024, 1, 5, 10)
    late = records(spark, [created(200, at="2024-01-03T10:00:00Z")], 90)
    assert jobs.process_batch(lake, late, 2, none, NOW) == "Published"
    assert lake.read("silver_late_operational_events").count() == 1
    chosen = spark.createDataFrame([("t", 0, 90)], "topic string, partition int, offset bigint")
    for _ in range(2):
        assert jobs.replay_late_facts(lake, chosen, none, NOW) == "Published"
    assert lake.read("silver_operational_events").count() == 25
    bad = records(spark, ["broken"], 95)
    assert jobs.process_batch(lake, bad, 3, none, NOW) == "QualityBlocked"
    left = jobs.run_erasure(lake, spark.createDataFrame([(uid(500),)], "subjectId string"), {"k1": b"x" * 32}, NOW)
    assert {(r["marked"], r["filesLeft"]) for r in left.collect()} == {(0, 0)}
    assert {r["table"] for r in left.where("files > 0").collect()} == {"bronze_operational_events", "silver_operational_events", "silver_application_stage_times"}
    assert lake.read("silver_operational_events").count() == 23
    found = {(r["table"], r["kind"]) for r in jobs.audit_key(lake, "k1", NOW).where("rows > 0").collect()}
    assert {("silver_operational_events", kind) for kind in ("row", "file", "primary token", "token")} <= found
    assert jobs.audit_key(lake, "k2", NOW).where("rows > 0 and kind <> 'token'").count() == 0
    with pytest.raises(ValueError, match="deadline"):
        jobs.run_erasure(lake, spark.createDataFrame([(uid(501),)], "subjectId string"), {"k1": b"x" * 32}, NOW, deadline=NOW - timedelta(days=1))
    jobs.maintenance_tick(lake, none, NOW + timedelta(days=400))
    assert lake.read("silver_operational_events").count() == 0


def data_files(lake, name: str) -> set[str]:
    return set(lake.read(name).inputFiles())


def test_batches_append_and_publish(spark, tmp_path):
    """Manifests, coverage, snapshots and outcomes of bounded runs; stored files are left alone."""
    lake = jobs.Lake(spark, str(tmp_path), "k1", b"x" * 32)
    none = spark.createDataFrame([], "subjectToken string")
    ranges = lambda *r: spark.createDataFrame([("t", 0, a, b) for a, b in r], "topic string, partition int, startOffset long, endOffsetExclusive long")
    first = records(spark, [created(i) for i in range(12)])
    with pytest.raises(ValueError, match="cover"):
        jobs.run_batch(lake, "r0", ranges((0, 13)), first, none, NOW)
    with pytest.raises(ValueError, match="hold offsets"):
        jobs.run_batch(lake, "r0", ranges((5, 5)), first, none, NOW)
    assert lake.read("control_run_manifests").count() == 0
    assert jobs.run_batch(lake, "r0", ranges((0, 12)), first, none, NOW) == "Published"
    files = {n: data_files(lake, n) for n in ("bronze_operational_events", "silver_operational_events")}
    shot = jobs.latest_report(lake, NOW).first()
    assert (shot["runId"], shot["revision"]) == ("r0", 0) and json.loads(shot["report"])["funnel"][0]["created"] == 12
    with pytest.raises(ValueError, match="other ranges"):
        jobs.run_batch(lake, "r0", ranges((0, 11)), first, none, NOW)
    second = records(spark, [created(i) for i in range(12, 24)], 12)
    assert jobs.run_batch(lake, "r1", ranges((12, 24)), second, none, NOW, erasing=True) == "ErasurePending"
    assert jobs.latest_report(lake, NOW).first()["runId"] == "r0"
    for _ in range(2):
        assert jobs.run_batch(lake, "r1", ranges((12, 24)), second, none, NOW) == "Published"
    for name, before in files.items():
        assert before < data_files(lake, name) and lake.read(name).count() == 24
    shot = jobs.latest_report(lake, NOW).first()
    assert (shot["runId"], shot["revision"]) == ("r1", 1) and json.loads(shot["report"])["funnel"][0]["created"] == 24
    assert jobs.run_batch(lake, "r2", ranges((24, 25)), records(spark, ["broken"], 24), none, NOW) == "QualityBlocked"
    assert {(r["runId"], r["status"]) for r in lake.read("control_run_manifests").collect()} == {("r0", "Published"), ("r1", "Published"), ("r2", "QualityBlocked")}
    assert jobs.latest_report(lake, NOW + timedelta(days=31)).count() == 0


def test_a_run_that_broke_off_is_run_again(spark, tmp_path, monkeypatch):
    """A crash before the control row moves leaves no new report in force; the next run makes it."""
    lake = jobs.Lake(spark, str(tmp_path), "k1", b"x" * 32)
    none = spark.createDataFrame([], "subjectToken string")
    batch = records(spark, [created(i) for i in range(12)])
    write = jobs.Lake.write

    def breaks(self, name, df):
        if name == "control_report":
            raise OSError("lost")
        write(self, name, df)

    monkeypatch.setattr(jobs.Lake, "write", breaks)
    with pytest.raises(OSError):
        jobs.process_batch(lake, batch, 0, none, NOW)
    assert jobs.latest_report(lake, NOW).count() == 0
    monkeypatch.setattr(jobs.Lake, "write", write)
    for _ in range(2):
        assert jobs.process_batch(lake, batch, 0, none, NOW) == "Published"
    assert lake.read("report_snapshots").count() == 1 and jobs.latest_report(lake, NOW).count() == 1
    assert lake.read("control_streaming_decisions").count() == 1 and lake.read("bronze_operational_events").count() == 12


def test_decisions_follow_the_marker_view(spark):
    schema = TABLES["control_streaming_decisions"].schema
    row = lambda seen: spark.createDataFrame([("main", 1, 0, seen, NOW, "main-1", "f", 0, 0)], schema)
    held = row("a").limit(0)
    for seen, revisions in (("a", 1), ("a", 1), ("b", 2), ("a", 3)):
        held = journal.decide(held, row(seen))
        assert held.count() == revisions
    with pytest.raises(ValueError, match="too many"):
        journal.decide(held, row("b"))
    marks = lambda *t: journal.marker_fingerprint(spark.createDataFrame([(x,) for x in t], "subjectToken string")).first()["fingerprint"]
    assert marks() != marks("a") and marks("a", "b") == marks("b", "a", "a") != marks("a", "c")


def test_stream_of_files_is_published(spark, tmp_path):
    lake = jobs.Lake(spark, str(tmp_path / "lake"), "k1", b"x" * 32)
    none = spark.createDataFrame([], "subjectToken string")
    path = str(tmp_path / "in")
    for i in (0, 12):
        records(spark, [created(n) for n in range(i, i + 12)], i).coalesce(1).write.mode("append").parquet(path)
    source = events.read_event_stream(spark, {"path": path}, "files")
    jobs.run_stream(lake, source, none, str(tmp_path / "ck"), clock=lambda: NOW)
    jobs.run_stream(lake, source, none, str(tmp_path / "ck"), clock=lambda: NOW)
    assert {(r["batchId"], r["outcome"]) for r in lake.read("control_streaming_progress").collect()} == {(0, "Published"), (1, "Published")}
    assert lake.read("gold_application_funnel").first()["created"] == 24 and jobs.latest_report(lake, NOW).first()["runId"] == "main-1"
    other = jobs.Lake(spark, str(tmp_path / "other"), "k1", b"x" * 32)
    with pytest.raises(ValueError, match="batch 0: COMMITTED_WITHOUT_JOURNAL; batch 1"):
        jobs.run_stream(other, source, none, str(tmp_path / "ck"), clock=lambda: NOW)
    with pytest.raises(ValueError, match="batch 1: JOURNAL_ONLY"):
        jobs.run_stream(lake, source, none, str(tmp_path / "lost"), clock=lambda: NOW)


def test_file_stream(spark, tmp_path):
    """A record stream over files, acknowledged batch by batch; its checkpoint can be read."""
    path, seen = str(tmp_path / "in"), []
    for i in range(3):
        records(spark, [created(i)], i).coalesce(1).write.mode("append").parquet(path)
    q = batches.start_stream(events.read_event_stream(spark, {"path": path}, "files"), lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck"))
    q.awaitTermination()
    assert seen == [(0, 1), (1, 1), (2, 1)]
    log = events.read_checkpoint(spark, str(tmp_path / "ck"), "t").orderBy("batchId").collect()
    late, rest = events.read_event_stream(spark, {"path": path}, "files", starting=[("t", 0, 2)]), []
    batches.start_stream(late, lambda df, n: rest.extend(r["offset"] for r in df.collect()), str(tmp_path / "ck2")).awaitTermination()
    assert rest == [2]
    assert [r["batchId"] for r in log] == [0, 1, 2] and all(r["committed"] and r["contiguous"] for r in log)


def test_tables_refuse_drift(spark, tmp_path):
    spec, path = TABLES["gold_job_skills"], str(tmp_path / "t")
    tables.ensure_table(spark, path, spec)
    good = tables.conform(spark.createDataFrame([(NOW.date(), "a", 3)], "day date, skill string, postings bigint"), spec)
    tables.overwrite_table(good, path, spec)
    assert tables.read_or_empty(spark, path, spec).count() == 1
    with pytest.raises(ValueError, match="shape"):
        tables.write_table(good.drop("skill"), path, spec)
    with pytest.raises(ValueError, match="checks"):
        tables.write_table(tables.conform(good.withColumn("postings", F.lit(-1)), spec), path, spec)
    assert tables.read_or_empty(spark, path, spec).count() == 1
    assert not tables.exists(spark, tables.staged(path))
    good.write.parquet(f"{tables.staged(path)}/rows")  # a write that broke off before all was staged
    later = datetime.now() + timedelta(days=30)
    assert not tables.reclaim(spark, path, datetime.now()) and tables.reclaim(spark, path, later) and tables.exists(spark, tables.staged(path))
    assert tables.reclaim(spark, path, later, dry_run=False) and not tables.exists(spark, tables.staged(path))


def test_range_scan_options():
    opts = events.kafka_range_options([("t", 0, 5, 9), ("t", 1, 0, 2)], {"kafka.bootstrap.servers": "h:1"})
    assert json.loads(opts["startingOffsets"]) == {"t": {"0": 5, "1": 0}} and json.loads(opts["endingOffsets"]) == {"t": {"0": 9, "1": 2}}
    with pytest.raises(ValueError):
        events.kafka_range_options([("t", 0, 5, 5)], {})
    opts = events.kafka_stream_options({"kafka.bootstrap.servers": "h:1"}, 50, [("t", 1, 7), ("t", 0, 3)])
    assert json.loads(opts["startingOffsets"]) == {"t": {"0": 3, "1": 7}} and json.loads(opts["assign"]) == {"t": [0, 1]} and opts["maxOffsetsPerTrigger"] == "50"
    assert "startingOffsets" not in events.kafka_stream_options({"subscribe": "t"})
    for wrong in ([], [("t", 0, -1)], [("t", 0, 1), ("t", 0, 2)]):
        with pytest.raises(ValueError, match="each partition once"):
            events.kafka_stream_options({}, starting=wrong)


def test_columns(spark):
    r = spark.range(1).select(
        cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("k"), canonical_set(F.array(F.lit(" B"), F.lit("a"), F.lit("b"), F.lit(" "))).alias("s"),
    ).first()
    assert math.isclose(r["c"], 2**-0.5) and r["z"] is None and math.isclose(r["k"], math.pi * 6371) and r["s"] == ["a", "b"]


def test_nearby_wraps_the_date_line(spark):
    rows = [(1, "Open", False, 0.0, 179.9), (2, "Open", False, 0.0, -179.9), (3, "Open", True, 0.0, 179.9), (4, "Closed", False, 0.0, 179.9)]
    j = spark.createDataFrame(rows, "id int, status string, remote boolean, lat double, lon double")
    c = spark.createDataFrame([(0, 0.0, 180.0)], "centreId int, cLat double, cLon double")
    assert {r["id"] for r in discovery.nearby_jobs(j, c, 50.0).collect()} == {1, 2}


def test_fusion_ties_and_failures(spark):
    h = spark.createDataFrame([("q", "a", 1, 1), ("q", "a", 2, 2), ("q", "a", 1, 3), ("q", "b", 2, 1), ("q", "b", 1, 2)], "queryId string, branch string, id int, rank int")
    assert [r["id"] for r in retrieval.rrf(h, ["a", "b"], 5).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        retrieval.hybrid_jobs(None, h, 5)


def test_assessment_verdicts(spark):
    """One clean pair is recommended; each change raises its own reason."""
    side = lambda p, **k: {f"{p}_{n}": v for n, v in k.items()}
    both = lambda **k: side("b", **k) | side("c", **k)
    query = dict(queryId=1, useCase="Jobs", filterGroup="Broad", split="HeldOut", reviewed=True) | both(outcome="Succeeded", recall=0.5, ndcg=0.5, latencyMillis=10.0)
    term = dict(agreed=True, rubricApproved=True, attested=True, noiseMillis=5.0, budgetMillis=50.0) | both(rankings="Observed", embeddings="ProviderGenerated", vector=True, requests=9, privacy="Passed", eligibility="Passed", billing="plan", currency="EUR")
    cost = dict(useCase="Jobs", supported=True, maximumCost=10, b_cost=5, c_cost=5)
    cases = [
        ({}, "Recommend", []), ({"c_recall": 0.4}, "Reject", ["RelevanceRegression"]), ({"c_latencyMillis": 15.0}, "Recommend", []), ({"c_latencyMillis": 15.5}, "Reject", ["LatencyRegression"]), ({"c_latencyMillis": None}, "Defer", ["MissingLatency"]),
        ({"b_latencyMillis": 60.0}, "Defer", ["AbsoluteLatencyBudgetExceeded"]), ({"agreed": False}, "Defer", ["PolicyProposed"]), ({"reviewed": None}, "Defer", ["LabelsUnreviewed"]), ({"attested": None}, "Defer", ["MissingLabelAttestation"]),
        ({"c_outcome": "Failed"}, "Reject", ["RetrievalFailure", "MissingRelevance"]), ({"c_outcome": "Unavailable"}, "Defer", ["IncompleteCoverage", "MissingRelevance"]), ({"c_outcome": None}, "Defer", ["IncompleteCoverage"]), ({"split": "Tuning"}, "Defer", ["IncompleteCoverage"]),
        ({"c_privacy": None}, "Defer", ["MissingObservedEvidence", "MissingComparableBilling"]), ({"c_eligibility": "Failed"}, "Reject", ["EligibilityFailure"]), ({"c_cost": 6}, "Reject", ["CostLimitExceeded"]), ({"c_currency": "USD", "c_cost": 99}, "Defer", ["MissingComparableBilling"]),
        ({"c_requests": 10}, "Reject", ["ProviderRequestRegression"]), ({"b_requests": None}, "Defer", ["MissingProviderMeasurements"]), ({"budgetMillis": None}, "Invalid", []), ({"noiseMillis": float("nan")}, "Invalid", []), ({"maximumCost": -1}, "Invalid", []), ({"supported": False}, "Invalid", []),
    ]

    def frame(row: dict, ddl: str):
        rows = [{"pairId": i} | row | {n: v for n, v in change.items() if n in row} for i, (change, *_) in enumerate(cases)]
        names = [c.split()[0] for c in ddl.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)

    two = lambda *pairs: ", ".join(f"{s}_{n} {t}" for s in "bc" for n, t in pairs)
    measured = frame(query, "pairId int, queryId int, useCase string, filterGroup string, split string, reviewed boolean, " + two(("outcome", "string"), ("recall", "double"), ("ndcg", "double"), ("latencyMillis", "double")))
    terms = frame(term, "pairId int, agreed boolean, rubricApproved boolean, attested boolean, noiseMillis double, budgetMillis double, " + two(*[(n, "string") for n in ("rankings", "embeddings", "privacy", "eligibility", "billing", "currency")], ("vector", "boolean"), ("requests", "int")))
    costs = frame(cost, "pairId int, useCase string, supported boolean, maximumCost int, b_cost int, c_cost int")
    got = [(r["decision"], r["reasons"]) for r in evaluation.assess(measured, terms, costs).orderBy("pairId").collect()]
    assert got == [(decision, reasons) for _, decision, reasons in cases]
    assert evaluation.assess(measured.limit(0), terms, costs).where("decision <> 'Invalid'").count() == 0


def test_insert_only_merge_does_not_hang_on_partitions(spark):
    """Two rows of one key: the same one is taken however the rows are dealt, and stored ones stay."""
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d")], "id int, body string")
    old = spark.createDataFrame([(3, "old")], "id int, body string")
    for n in (1, 4):
        rows = {(r["id"], r["body"]) for r in tables.merge_insert_only(old, new.repartition(n), ["id"]).collect()}
        assert rows == {(1, "a"), (2, "c"), (3, "old")}


def test_rows_without_an_expiry_stay(spark):
    rows = spark.createDataFrame([(1, None), (2, NOW), (3, NOW + timedelta(days=1))], "id int, expiresAt timestamp")
    assert {r["id"] for r in tables.expire(rows, NOW).collect()} == {1, 3}


def test_a_conflict_with_a_late_fact_is_seen(spark):
    """Live late facts count as history beside Silver; expired ones don't."""
    schema = "eventId string, eventFingerprint string, expiresAt timestamp"
    later = NOW + timedelta(days=1)
    silver = spark.createDataFrame([("a", "1", later), ("b", "1", NOW)], schema)
    late = spark.createDataFrame([("c", "1", None), ("d", "1", NOW)], schema)
    stored = facts.stored_fingerprints(silver, late, NOW)
    incoming = spark.createDataFrame([(x, "2") for x in "abcd"], "eventId string, eventFingerprint string")
    assert {r["eventId"] for r in facts.historical_conflicts(incoming, stored).collect()} == {"a", "c"}


def test_exact_search_against_brute_force(spark, monkeypatch):
    """Ties, nulls, zero vectors and other sizes; the matrix and the joined form give the same rows."""
    items = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)]
    items += [(100, items[3][1]), (101, [0.0] * 4), (102, None), (103, [1.0, 2.0]), (104, [1.0, None, 2.0, 3.0]), (105, [])]
    df = spark.createDataFrame(items, "id int, embedding array<double>").repartition(3)
    asks = spark.createDataFrame([(i, v) for i, v in items if i % 20 == 0 or i > 100], "queryId int, queryVector array<double>")
    size = lambda v: math.sqrt(sum(x * x for x in v))
    good = lambda v: bool(v) and None not in v and size(v) > 0
    want = set()
    for q, u in items:
        if (q % 20 == 0 or q > 100) and good(u):
            cos = [(-round(sum(a * b for a, b in zip(u, v)) / size(u) / size(v), 12), i) for i, v in items if good(v) and len(v) == len(u)]
            want |= {(q, i, n + 1) for n, (_, i) in enumerate(sorted(cos)[:5])}
    found = lambda: {(r["queryId"], r["id"], r["rank"]) for r in retrieval.knn(df, asks, 5).collect()}
    assert found() == want
    monkeypatch.setattr(retrieval, "SCORES_AT_A_TIME", 20)
    assert found() == want
    assert retrieval.knn(df.limit(0), asks, 5).count() == 0 and retrieval.knn(df, asks.limit(0), 5).count() == 0
