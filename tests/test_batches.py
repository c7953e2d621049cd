"""Batches that cost what they change: touched folders alone, reports by day, two passes, crashes between steps."""

from __future__ import annotations

import json
import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import NOW, created, records, uid

from eventloom.functions import joins
from eventloom.functions.columns import set_digest
from eventloom.operators import discovery, envelopes, evaluation, facts, neighbours, reports, retrieval
from eventloom.plans import jobs
from eventloom.sources import tables
from eventloom.specs import TABLES
from eventloom.streaming import journal

SILVER, TIMES = "silver_operational_events", "silver_application_stage_times"


@pytest.fixture
def lake(spark, tmp_path):
    return jobs.Lake(spark, str(tmp_path / "lake"), "k1", b"x" * 32)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "subjectToken string")


def files(lake, name: str) -> set[str]:
    return set(lake.read(name).inputFiles())


def silver_rows(spark, rng: random.Random, n: int, first: int, days: range, subjects: int = 9):
    """Lifecycle facts and postings of few subjects, so that suppression matters."""
    rows = []
    for i in range(first, first + n):
        at = datetime(2024, 1, 1) + timedelta(days=rng.choice(days), hours=rng.randrange(24))
        kind = rng.choice(["APPLICATION_CREATED", "APPLICATION_STATUS_CHANGED", "JOB_CREATED"])
        status = rng.choice(["Hired", "Rejected"]) if kind == "APPLICATION_STATUS_CHANGED" else None
        about = None if kind == "JOB_CREATED" else f"a{rng.randrange(40)}"
        subject = f"s{rng.randrange(subjects)}"
        rows.append((f"e{i}", kind, at, "Job" if kind == "JOB_CREATED" else "Application", "x", about, "j", status, [rng.choice(["Go", "sql "])], subject, [subject], f"f{i}", NOW, NOW + timedelta(days=30)))
    return spark.createDataFrame(rows, TABLES[SILVER].schema)


def test_upserts_write_the_buckets_they_touch(spark, lake):
    rng = random.Random(1)
    jobs.add_facts(lake, silver_rows(spark, rng, 200, 0, range(5)))
    before = files(lake, TIMES)
    one = silver_rows(spark, rng, 200, 200, range(3, 5)).where("applicationId = 'a7' and eventType <> 'JOB_CREATED'")
    bucket = tables.parts_of(one, TABLES[TIMES])
    assert len(bucket) == 1 and len(before) > 10
    jobs.add_facts(lake, one)
    after = files(lake, TIMES)
    gone, new = before - after, after - before
    assert gone and new and all(f"/part={bucket[0]}/" in f for f in gone | new)
    want = reports.stage_times(lake.read(SILVER))
    columns = [c for c in TABLES[TIMES].schema.fieldNames() if c != "subjectToken"]
    assert sorted(map(str, lake.read(TIMES).select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    jobs.add_facts(lake, one)
    assert files(lake, TIMES) == after


def test_reports_by_touched_day_equal_a_rebuild(spark, lake, tmp_path):
    """Random batches, then an expiry: after each, the daily tables are as if made anew, and other days' files stay."""
    rng, whole = random.Random(2), jobs.Lake(spark, str(tmp_path / "whole"), "k1", b"x" * 32)
    for step, days in enumerate((range(6), range(4, 6), range(2, 3))):
        batch = silver_rows(spark, rng, 100 * len(days), 1000 * step, days, 25)
        kept = {n: files(lake, n) for n in ("gold_application_funnel", "gold_job_skills")}
        jobs.add_facts(lake, batch)
        touched = jobs.refresh_gold(lake, NOW)
        assert [d.day for d in touched] == [d + 1 for d in days] and lake.stale_days() == []
        jobs.add_facts(whole, batch)
        jobs.rebuild_gold(whole, NOW)
        for name, old in kept.items():
            assert sorted(map(tuple, lake.read(name).collect())) == sorted(map(tuple, whole.read(name).collect())) and lake.read(name).count() > 0
            assert {f for f in old if not any(f"part={d}/" in f for d in touched)} <= files(lake, name)
    plan = lake.read(SILVER, tables.parts_of(batch, TABLES[SILVER]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(lake.read(SILVER, [datetime(2024, 1, 3).date()]).inputFiles()) > 0
    assert jobs.refresh_gold(lake, NOW + timedelta(days=31)) and lake.read("gold_job_skills").count() == 0


def test_visible_times_count_the_touched_days_alone(spark):
    rng = random.Random(3)
    stored, batch = silver_rows(spark, rng, 300, 0, range(8)), silver_rows(spark, rng, 60, 500, range(2, 4))
    got = {r["eventId"] for r in reports.visible_candidate_times(stored, batch, 3).collect()}
    whole = stored.unionByName(batch)
    days = {r["day"] for r in reports.wide_funnel_day(whole, 3).collect()}
    cells = {(r["day"], r["skill"]) for r in reports.skill_postings(whole, 3).collect()}
    want = {r["eventId"] for r in batch.collect() if (r["occurredAt"].date() in days if r["eventType"] != "JOB_CREATED" else (r["occurredAt"].date(), r["jobSkills"][0].strip().lower()) in cells)}
    assert got == want and want


def shuffled_scans(df) -> bool:
    """Whether a scan of files reaches a join or a grouping other than one with a broadcast side first."""
    nearest = []

    def walk(node, above):
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            nearest.append(above)
        if "Join" in name or "Aggregate" in name or "Window" in name:
            above = name
        for i in range(node.children().size()):
            walk(node.children().apply(i), above)

    walk(df._jdf.queryExecution().sparkPlan(), None)
    assert nearest
    return any(name != "BroadcastHashJoin" for name in nearest)


def test_a_small_batch_does_not_shuffle_what_is_stored(spark, lake):
    rng = random.Random(4)
    jobs.add_facts(lake, silver_rows(spark, rng, 300, 0, range(6)))
    stored, batch = lake.read(SILVER), silver_rows(spark, rng, 50, 280, range(6))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = tables.new_rows(stored, batch, ["eventId"])
        assert not shuffled_scans(fresh) and {r["eventId"] for r in fresh.collect()} == {f"e{i}" for i in range(300, 330)}
        conflicts = facts.historical_conflicts(batch.withColumn("eventFingerprint", F.lit("other")), stored)
        assert not shuffled_scans(conflicts) and {r["eventId"] for r in conflicts.collect()} == {f"e{i}" for i in range(280, 300)}
        coordinates = batch.withColumns({"topic": F.lit("t"), "partition": F.lit(0), "offset": F.lit(1).cast("long")})
        late = facts.late_not_admitted(coordinates, stored, batch.limit(0), coordinates.limit(0))
        assert not shuffled_scans(late) and late.count() == 30
        assert joins.met(stored, batch, ["eventId"], most=3).count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_replacement_that_broke_off_is_done_again(spark, lake, monkeypatch):
    """Staged rows replace their folders before the next read, once or twice; emptied folders go; what wasn't staged whole is forgotten."""
    rng, spec = random.Random(5), TABLES[SILVER]
    jobs.add_facts(lake, silver_rows(spark, rng, 120, 0, range(4)))
    path, days = lake.path(SILVER), tables.parts_of(lake.read(SILVER), spec)
    kept = [r["eventId"] for r in lake.read(SILVER, days[2:]).collect()]
    rows = lake.read(SILVER, days[:2]).where(F.to_date("occurredAt") == F.lit(days[0])).limit(3)
    wanted = sorted(kept + [r["eventId"] for r in rows.collect()])
    rows = spark.createDataFrame(rows.collect(), spec.schema)
    write, calls = tables._write, []

    def breaks(*args, **kw):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        write(*args, **kw)

    monkeypatch.setattr(tables, "_write", breaks)
    with pytest.raises(OSError):
        tables.replace_parts(rows, path, spec, days[:2])
    monkeypatch.setattr(tables, "_write", write)
    assert sorted(r["eventId"] for r in lake.read(SILVER).collect()) == wanted
    assert not tables.exists(spark, tables.staged(path)) and tables.parts_of(lake.read(SILVER), spec) == [days[0], *days[2:]]
    write(rows.withColumn("part", F.to_date("occurredAt")), f"{tables.staged(path)}/rows", spec, "overwrite")
    assert lake.read(SILVER).count() == len(wanted)


def test_folders_of_many_files_are_compacted(spark, lake):
    rng, spec = random.Random(6), TABLES[SILVER]
    for i in range(4):
        lake.merge(SILVER, silver_rows(spark, rng, 20, 100 * i, range(1 if i < 3 else 2)))
    before = files(lake, SILVER)
    later = NOW + timedelta(hours=1)
    assert tables.compact(spark, lake.path(SILVER), spec, 2, later, NOW, timedelta(days=1)) == []
    assert tables.compact(spark, lake.path(SILVER), spec, 2, later, NOW, timedelta(hours=1)) == ["2024-01-01"]
    after = files(lake, SILVER)
    assert lake.read(SILVER).count() == 80 and len(after) < len(before) and {f for f in before if "2024-01-02" in f} <= after


def test_a_conflict_between_the_passes_stops_publication(spark, lake, none, monkeypatch):
    batch = records(spark, [created(i) for i in range(12)])
    assess = jobs.assess

    def then_a_conflict(own, known, markers, now, watermark):
        seen = assess(own, known, markers, now, watermark)
        other = known.where("offset = 3").withColumns({"offset": F.lit(90).cast("long"), "eventFingerprint": F.lit("other")})
        silver = facts.with_expiry(facts.to_silver(other, none), now, 30)
        own.merge(SILVER, silver)
        return seen

    monkeypatch.setattr(jobs, "assess", then_a_conflict)
    with pytest.raises(jobs.BatchChanged, match="conflict appeared"):
        jobs.process_batch(lake, batch, 0, none, NOW)
    assert jobs.latest_report(lake, NOW).count() == 0
    monkeypatch.setattr(jobs, "assess", assess)
    assert jobs.process_batch(lake, batch, 0, none, NOW) == "QualityBlocked"
    told = lake.read("control_streaming_assessments").collect()
    assert len(told) == 1 and told[0]["outcome"] == "QualityBlocked"


def test_a_marker_between_the_passes_stops_publication(spark, lake, none):
    """Markers are read anew by each pass and each attempt; the next attempt publishes without the subject."""
    from eventloom.operators import privacy

    marker = privacy.marker_tokens(spark.createDataFrame([(uid(500),)], "subjectId string"), {"k1": b"x" * 32})
    calls = []

    def markers():
        calls.append(1)
        return marker if len(calls) > 1 else none

    batch = records(spark, [created(i) for i in range(12)])
    with pytest.raises(jobs.BatchChanged, match="different facts"):
        jobs.process_batch(lake, batch, 0, markers, NOW)
    assert jobs.latest_report(lake, NOW).count() == 0 and lake.read("control_streaming_decisions").count() == 0
    assert jobs.process_batch(lake, batch, 0, markers, NOW) == "Published"
    assert lake.read("gold_application_funnel").first()["created"] == 11
    decided = lake.read("control_streaming_decisions").collect()
    assert len(decided) == 1 and decided[0]["candidateWatermark"] == lake.read("control_streaming_progress").first()["candidateWatermark"]


def test_replay_and_tick_publish(spark, lake, none):
    """Late facts that are let in, and facts that expire, reach the readers' snapshot; an idle tick publishes nothing."""
    rng, later = random.Random(9), NOW + timedelta(days=20)
    rows = silver_rows(spark, rng, 60, 0, range(2), 25).where("eventType = 'APPLICATION_CREATED'")
    late = rows.withColumns({"topic": F.lit("t"), "partition": F.lit(0), "offset": F.substring("eventId", 2, 9).cast("long"), "admissionReason": F.lit("CLOSED_DAY")})
    lake.merge("silver_late_operational_events", late)
    asked = lake.read("silver_late_operational_events").select(*facts.COORDINATE)
    n = asked.count()
    report = lambda: jobs.latest_report(lake, NOW).first()["report"]
    assert n > 15 and jobs.replay_late_facts(lake, asked, none, NOW) == "Published" and lake.read(SILVER).count() == n
    assert lake.read("report_snapshots").count() == 1 and report().count("2024-01") == lake.read("gold_application_funnel").count()
    assert jobs.maintenance_tick(lake, none, NOW + timedelta(hours=1)) == "UNCHANGED" and lake.read("report_snapshots").count() == 1
    for wrong, why in (([("t", 0, 7777)], "missing"), ([], "1 to 1000")):
        with pytest.raises(ValueError, match=why):
            jobs.replay_late_facts(lake, spark.createDataFrame(wrong, asked.schema), none, NOW)
    assert jobs.maintenance_tick(lake, none, later + timedelta(days=20)) == "PUBLISH"
    assert lake.read(SILVER).count() == 0 and lake.read("gold_application_funnel").count() == 0


def test_a_start_on_contradicting_offsets_is_refused(spark):
    """Kafka ends by partition against the journal's; an unfinished last batch may be resumed, two may not."""
    told = lambda *ends: json.dumps([{"topic": "t", "partition": p, "endOffsetExclusive": e} for p, e in ends])
    row = lambda b, outcome, *ends: ("main", b, NOW, None, "f", "[]", told(*ends), outcome, None, None)
    schema = TABLES["control_streaming_progress"].schema
    good = [row(3, "Published", (0, 5), (1, 9)), row(4, "Published", (0, 7), (1, 9)), row(5, "Prepared", (0, 8), (1, 9))]
    ck = [(4, {"0": 7, "1": 9}, True), (5, {"0": 8, "1": 9}, False)]
    held = lambda rows: spark.createDataFrame(rows, "batchId long, endOffsets map<string,bigint>, committed boolean")
    why = lambda journalled, rows: journal.refusals(spark.createDataFrame(journalled, schema), held(rows), "main")
    assert why(good, ck) == [] and why(good, [*ck, (6, {"0": 9, "1": 9}, False)]) == ["2 unfinished batches"]
    assert why(good, [(4, {"0": 6, "1": 9}, True), ck[1]]) == ["batch 4: OFFSETS_DIFFER"]
    assert why(good, [ck[0], (5, {"0": 8, "1": 9}, True)]) == ["batch 5: COMMITTED_UNFINISHED"]
    assert why(good, ck[:1]) == ["batch 5: JOURNAL_ONLY"] and why([], ck) == ["batch 4: COMMITTED_WITHOUT_JOURNAL"]


def test_the_row_before_is_found_by_ranges(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice([None, rng.randrange(50)])) for i in rng.sample(range(10_000), 400)]
    want, last = {}, None
    for i, v in sorted(rows):
        want[i], last = last, v
    df = spark.createDataFrame(rows, "id int, v int").repartition(6)
    assert {r["id"]: r["before"] for r in joins.with_previous(df, "id", "v", "before").collect()} == want
    assert joins.with_previous(df.limit(0), "id", "v", "before").count() == 0


def test_digests_of_sets(spark):
    digest = lambda *t: spark.createDataFrame([(x,) for x in t], "t string").repartition(3).agg(set_digest("t").alias("d")).first()["d"]
    assert digest("a", "b", None) == digest(None, "b", "a") and len({digest(), digest(None), digest(""), digest("a"), digest("a", "a"), digest("-"), digest("ab"), digest("a", "b")}) == 8


def test_skill_evidence_of_many_sizes(spark):
    """Forty hits that need 2 to 100 skills: places by the exact ratios, without an overflow."""
    from fractions import Fraction

    have = [f"k{i}" for i in range(30)]
    needs = {n: [f"k{i}" for i in range(n % 31 + (n > 60), n % 31 + (n > 60) + n)] for n in range(2, 101)}
    rows = [("q", n, n - 1, have, need) for n, need in needs.items()]
    hits = spark.createDataFrame(rows, "queryId string, id int, rank int, viewerSkills array<string>, targetSkills array<string>")
    got = {r["id"]: r["evidenceRank"] for r in retrieval.skill_evidence_rank(hits, 1000).collect()}
    ratio = {n: Fraction(len(set(need) & set(have)), n) for n, need in needs.items()}
    assert got == {n: 1 + sum(r > ratio[n] for r in ratio.values()) if ratio[n] else None for n in needs}


def test_approximate_search_of_odd_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0] * 3), (1004, [None, *[1.0] * 7]), (1005, rows[5][1])]
    items = spark.createDataFrame(rows, "id int, embedding array<double>").repartition(3)
    asks = spark.createDataFrame([(5, rows[5][1]), (7, [0.0] * 8), (8, None), (9, [1.0] * 3)], "queryId int, queryVector array<double>")
    got = neighbours.ann(items, asks, 2).collect()
    assert {(r["queryId"], r["id"], r["rank"]) for r in got} == {(5, 5, 1), (5, 1005, 2)}
    for some in (items.limit(0), items.where("id in (1000, 1001, 1002)")):
        assert neighbours.ann(some, asks, 2).count() == 0
    assert neighbours.ann(items, asks.limit(0), 2).count() == 0
    own = neighbours.train(items)
    stored = neighbours.index(items, own)
    assert stored.count() == 301 and len(stored.first()["code"]) == 2
    assert {r["id"] for r in neighbours.ann(items, asks, 2, own, stored).collect()} == {5, 1005}


def test_clustered_items_need_few_probes(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    items = spark.createDataFrame([(i, (centres[i % 30] + 0.05 * rng.normal(size=16)).tolist()) for i in range(1500)], "id int, embedding array<double>")
    own = neighbours.train(items)
    assert own.probes <= len(own.cells) // 3


def test_postings_are_shuffled_once(spark, tmp_path):
    """Building shuffles each text once and each posting once: records written by all its stages."""
    table = spark.range(200).select("id", F.expr("concat_ws(' ', transform(sequence(0, 49), x -> concat('w', pmod(id * 7 + x, 300))))").alias("body"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> dict[tuple[int, int], int]:
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    before = shuffled()
    retrieval.build_postings(table, {"body": 1.0}, str(tmp_path / "postings"), 8)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    records = sum(n for key, n in shuffled().items() if key not in before)
    assert spark.read.parquet(str(tmp_path / "postings")).count() == 200 * 51
    assert records == 200 + 200 * 51


def test_pairs_of_a_postings_search_are_not_shuffled(spark, tmp_path):
    """Read postings are shuffled once, by id; their pairs with queries are summed up and cut to the best where they are."""
    table = spark.range(100).select("id", F.expr("concat_ws(' ', transform(sequence(0, 9), x -> concat('w', pmod(id + x, 30))))").alias("body"))
    queries = spark.range(40).select(F.col("id").alias("queryId"), F.expr("concat_ws(' ', transform(sequence(0, 4), x -> concat('w', pmod(id * 3 + x, 30))))").alias("query"))
    path = str(tmp_path / "postings")
    retrieval.build_postings(table, {"body": 1.0}, path, 8)
    found = retrieval.search_postings(spark, path, queries, 3, 8)
    assert found.count() == 40 * 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(((?:[^(),]+#\d+L?, )+)\d+\)", plan)
    assert sorted({re.sub(r"#\d+L?, $", "", k) for k in keys}) == ["id", "queryId", "term"]


def test_postings_give_what_a_scan_gives(spark, tmp_path, monkeypatch):
    """Two weighted fields, nulls, equal texts, words of every text, queries without a hit; few terms and many; pruned folders."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))) + " Common", " ".join(rng.choices(words, k=3)) if i % 3 else None) for i in range(200)]
    docs += [(500 + i, docs[i][1], docs[i][2]) for i in range(20)] + [(900, None, None)]
    asks = [(q, " ".join(rng.choices(words, k=4)) + (" common" if q % 2 else "")) for q in range(12)] + [(50, "nothing like it"), (51, ""), (52, None)]
    table = spark.createDataFrame(docs, "id int, body string, title string").repartition(3)
    queries = spark.createDataFrame(asks, "queryId int, query string")
    fields, path = {"body": 1.0, "title": 2.0}, str(tmp_path / "postings")
    count = lambda text: [w for w in (text or "").lower().split() if w]
    held = {i: (count(body), count(title)) for i, body, title in docs}
    avgdl = sum(len(b) + 2 * len(t) for b, t in held.values()) / len(held)
    want = set()
    for q, ask in asks:
        scores = {}
        for term in set(count(ask)):
            tf = {i: b.count(term) + 2 * t.count(term) for i, (b, t) in held.items() if term in b or term in t}
            for i, f in tf.items():
                idf = math.log(1 + (len(held) - len(tf) + 0.5) / (len(tf) + 0.5))
                scores[i] = scores.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(held[i][0]) + 2 * len(held[i][1])) / avgdl))
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(sorted((-round(s, 9), i) for i, s in scores.items())[:7])}
    rows = lambda df: {(r["queryId"], r["id"], r["rank"]) for r in df.collect()}
    retrieval.build_postings(table, fields, path, 8)
    found = retrieval.search_postings(spark, path, queries, 7, 8)
    assert rows(retrieval.lexical(table, queries, fields, 7)) == rows(found) == want
    one = retrieval.search_postings(spark, path, queries.where("queryId = 2"), 7, 8)
    assert "PartitionFilters: [part" in one._jdf.queryExecution().toString().replace("isnotnull(part", "part").replace("cast(", "") and "PushedFilters: [In(term" in one._jdf.queryExecution().toString()
    monkeypatch.setattr(retrieval, "PLAN_TERMS", 3)
    assert rows(retrieval.lexical(table, queries, fields, 7)) == rows(retrieval.search_postings(spark, path, queries, 7, 8)) == want
    assert retrieval.lexical(table.limit(0), queries, fields, 7).count() == 0


def test_places_in_circles_of_any_size(spark, monkeypatch):
    """Circles from 1 to 9000 km, at the poles and over the date line, by brute force; with centres broadcast and dealt."""
    rng = random.Random(13)
    places = [(i, "Open", i % 9 == 0, rng.choice([rng.uniform(-90, 90), rng.gauss(48, 0.1)]), rng.choice([rng.uniform(-180, 180), rng.gauss(2, 0.1), 179.99, -180.0])) for i in range(400)]
    places += [(900, "Open", False, None, 2.0), (901, "Closed", False, 48.0, 2.0), (902, "Open", None, 48.0, 2.0), (903, "Open", False, 90.0, 0.0)]
    centres = [(0, 48.0, 2.0), (1, 89.95, 120.0), (2, -89.0, 0.0), (3, 10.0, 179.9), (4, 0.0, -180.0), (5, None, 1.0)]
    jobs_ = spark.createDataFrame(places, "id int, status string, remote boolean, lat double, lon double")
    asked = spark.createDataFrame(centres, "centreId int, cLat double, cLon double")

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))

    for radius in (1.0, 10.0, 500.0, 9000.0):
        want = {(i, c) for i, status, remote, lat, lon in places for c, a, b in centres if status == "Open" and not remote and lat is not None and a is not None and km(lat, lon, a, b) <= radius}
        for most in (200_000, 1):
            monkeypatch.setattr(discovery, "MOST_CELLS", most)
            got = [(r["id"], r["centreId"]) for r in discovery.nearby_jobs(jobs_, asked, radius).collect()]
            assert len(got) == len(set(got)) and set(got) == want, radius


def test_centres_beyond_the_limit_are_not_broadcast(spark, monkeypatch):
    """A small table of centres makes many cells; the planner must not broadcast them, however small it takes them for."""
    places = spark.range(200).selectExpr("id", "'Open' AS status", "false AS remote", "id % 180 - 90D AS lat", "id - 100D AS lon")
    asked = places.selectExpr("id AS centreId", "lat AS cLat", "lon AS cLon")
    monkeypatch.setattr(discovery, "MOST_CELLS", 10)
    near = discovery.nearby_jobs(places, asked, 400.0)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString() and near.count() >= 200


def test_a_circle_at_a_pole_touches_few_cells(spark, monkeypatch):
    """Thousands of cells to a centre would go beyond the limit of those broadcast."""
    pole = spark.createDataFrame([(1, 90.0, 0.0), (2, -89.99, 10.0)], "centreId int, cLat double, cLon double")
    places = pole.selectExpr("centreId AS id", "'Open' AS status", "false AS remote", "cLat AS lat", "cLon AS lon")
    monkeypatch.setattr(discovery, "MOST_CELLS", 200)
    near = discovery.nearby_jobs(places, pole, 10.0)
    assert "Broadcast" in near._jdf.queryExecution().executedPlan().toString() and near.count() == 2


def test_relevance_by_label_needs_no_pairs(spark):
    """Labels judged as their pairs are; and two billion relevant pairs, which can't be listed."""
    items = spark.createDataFrame([(i, None if i % 9 == 0 else i % 4) for i in range(60)], "id int, label int")
    asks = items.where("id % 5 = 0").select(F.col("id").alias("queryId"), "label")
    ranked = asks.select("queryId", F.explode(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(i.alias("rank"), ((F.col("queryId") + i * i) % 60).alias("id")))).alias("h")).select("queryId", "h.*")
    pairs = asks.join(items, "label").select("queryId", "id")
    for by_pairs, by_label in ((evaluation.recall_at_k, evaluation.recall_in_group), (evaluation.ndcg_at_k, evaluation.ndcg_in_group)):
        assert sorted(by_pairs(ranked, pairs, 7).collect()) == sorted(by_label(ranked, items, asks, 7).collect())
    many = spark.range(200_000).select("id", F.lit(1).alias("label"))
    some = many.where("id < 10000").select(F.col("id").alias("queryId"), "label")
    own = some.select("queryId", F.col("queryId").alias("id"), F.lit(1).alias("rank"))
    assert evaluation.recall_in_group(own, many, some, 7).agg(F.count("*"), F.max("recall")).first() == (10_000, 1 / 200_000)


def test_tasks_hand_on_their_best_only(spark):
    """Of a task's items, however many tie, each query gets k; the joined result is the same."""
    import pyarrow as pa

    shape = pa.schema([("queryId", pa.int32()), ("id", pa.int32()), ("score", pa.float64())])
    asked = pa.table([pa.array([1, 2], pa.int32()), pa.array([[1.0, 0.0], [0.0, 1.0]])], ["queryId", "v"])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(b, b + 50), pa.int32()), pa.array([[1.0, 1.0]] * 50)], ["id", "v"]) for b in (0, 50, 100)]
    out = pa.Table.from_batches(retrieval._scorer(asked, 3, shape)(iter(batches)), shape).to_pylist()
    assert sorted((r["queryId"], r["id"]) for r in out) == [(q, i) for q in (1, 2) for i in range(3)]


def test_code_tables_are_made_for_a_few_queries_at_a_time(spark, monkeypatch):
    """A task's tables don't grow with the queries: never more than ASKS of them; all still find themselves, in parts too."""
    rng = np.random.default_rng(9)
    items = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "id int, embedding array<double>")
    asks = items.select(F.col("id").alias("queryId"), F.col("embedding").alias("queryVector"))
    own = neighbours.train(items)
    monkeypatch.setattr(neighbours, "ASKS", 16)
    whole = neighbours.Quantiser.tables

    def few(self, queries):
        assert len(queries) <= 16
        return whole(self, queries)

    monkeypatch.setattr(neighbours.Quantiser, "tables", few)
    for most in (64 * 2**20, 4096):
        monkeypatch.setattr(neighbours, "QUERY_BYTES", most)
        got = neighbours.ann(items, asks, 1, own).collect()
        assert sorted((r["queryId"], r["id"]) for r in got) == [(i, i) for i in range(200)]


def test_a_filter_by_validity_opens_each_text_once(spark):
    """The verdict's rules look at the document many times; a filter must not open it anew for each."""
    known = envelopes.with_validity(envelopes.parse_records(records(spark, [created(1), "{"])))
    plan = known.where("isValidEvent").select("eventId")._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") <= 2 and known.where("isValidEvent").count() == 1
