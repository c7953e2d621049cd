"""Queries over event, privacy and report operators, with their SQL."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from ..functions.columns import set_digest_sql
from ..operators import envelopes, privacy, reports
from ..operators import facts as ops
from ..sources import events as src
from ..sources import snapshots, tables
from ..sources.shared import shared_path
from ..specs import TABLES, TableSpec
from ..streaming import batches, journal
from . import derive as d
from . import jobs

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that checks it."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ctes(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


_CELLS = [("created", "\"eventType\" = 'APPLICATION_CREATED'"), *[(s.lower(), f"\"newStatus\" = '{s}'") for s in ("Accepted", "Declined", "Interview", "Hired", "Rejected")]]


@query(
    _ctes(d.FACTS)
    + " SELECT day, "
    + ", ".join(f"count(DISTINCT CASE WHEN {c} THEN app END) AS {n}" for n, c in _CELLS)
    + " FROM facts GROUP BY day HAVING "
    + " AND ".join(f"(count(DISTINCT CASE WHEN {c} THEN subj END) = 0 OR count(DISTINCT CASE WHEN {c} THEN subj END) >= 10)" for _, c in _CELLS)
)
def a4_wide_funnel_day(spark, sf):
    return reports.wide_funnel_day(d.facts(spark, sf))


@query(_ctes(d.FACTS) + ' SELECT day, "eventType", "newStatus", count(DISTINCT app) AS "contributingApplications" FROM facts GROUP BY ALL HAVING count(DISTINCT subj) >= 10')
def a3_funnel_activity(spark, sf):
    return reports.funnel_activity(d.facts(spark, sf))


@query(_ctes(d.FACTS) + " SELECT day, count(*) AS n FROM facts GROUP BY day HAVING count(DISTINCT subj) >= 20")
def a2_suppress_small(spark, sf):
    counts = d.facts(spark, sf).groupBy(F.to_date("occurredAt").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("subjectToken").alias("s"))
    return reports.suppress_small(counts, ["s"], 20)


@query(_ctes(d.POSTED) + " SELECT day, skill, count(DISTINCT id) AS postings FROM posted WHERE skill <> '' GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 10")
def a5_skill_postings(spark, sf):
    return reports.skill_postings(d.posted(spark, sf))


_STAGE_SQL = ", ".join(
    f"epoch_us(min(CASE WHEN {c} THEN ts END)) AS {n}"
    for n, c in [("created", "event_type = 'signup'"), ("accepted", "event_type = 'view'"), ("interview", "event_type = 'click'"), ("hired", "event_type = 'purchase'"), ("rejected", "event_type = 'error'")]
)


@query(
    _ctes(d.FACTS, f"s AS (SELECT 'a' || user_id AS \"applicationId\", {_STAGE_SQL}, epoch_us(max(ts)) AS last FROM facts GROUP BY user_id)")
    + " SELECT *, coalesce(least(hired, rejected) + 30 * 86400000000, last + 180 * 86400000000) AS expires FROM s"
)
def a6_stage_times(spark, sf):
    rows = reports.stage_times(d.facts(spark, sf, by_user=True))
    return _stages_out(rows)


def _stages_out(rows):
    us = F.unix_micros
    return rows.select("applicationId", *[us(f"{n}At").alias(n) for n in ("created", "accepted", "interview", "hired", "rejected")], us("lastEventAt").alias("last"), us("expiresAt").alias("expires"))


@query(SQL["a6_stage_times"])
def s12_merge_stage_times(spark, sf):
    f = d.facts(spark, sf, by_user=True)
    old, new = reports.stage_times(f.where("offset % 2 = 0")), reports.stage_times(f.where("offset % 2 = 1"))
    return _stages_out(reports.merge_stage_times(old, new))


_H = lambda a, b: f"(epoch_us({b}) - epoch_us({a})) / 3600000000.0"
_P = ", ".join(f'quantile_disc(h, {p}) AS "p{int(p * 100)}Hours"' for p in (0.5, 0.75, 0.9, 0.95))


@query(
    _ctes(d.STAGES, f"x AS (SELECT subj, CASE WHEN {_H('created', 'hired')} >= 0 THEN {_H('created', 'hired')} END AS h FROM st)")
    + f' SELECT {_P}, count(DISTINCT CASE WHEN h IS NOT NULL THEN subj END) AS "eligibleCount", count(DISTINCT CASE WHEN h IS NULL THEN subj END) AS "excludedCount" FROM x'
)
def a7_time_to_hire(spark, sf):
    return reports.time_to_hire(d.order_stage_times(spark, sf))


@query(
    _ctes(
        d.STAGES,
        "x AS ("
        + " UNION ALL ".join(f"SELECT '{m}' AS metric, subj, {_H(a, b)} AS h FROM st" for m, a, b in [("timeToAccept", "created", "accepted"), ("timeToInterview", "created", "interview"), ("timeToHire", "created", "hired"), ("acceptedToInterview", "accepted", "interview"), ("interviewToHire", "interview", "hired")])
        + ")",
    )
    + f' SELECT metric, {_P}, count(DISTINCT subj) AS "eligibleCount" FROM x WHERE h >= 0 GROUP BY metric HAVING count(DISTINCT subj) >= 10'
)
def a8_stage_durations(spark, sf):
    return reports.stage_durations(d.order_stage_times(spark, sf))


@query(_ctes(d.FACTS, 'w AS (SELECT day FROM facts GROUP BY day HAVING ' + " AND ".join(f"(count(DISTINCT CASE WHEN {c} THEN subj END) = 0 OR count(DISTINCT CASE WHEN {c} THEN subj END) >= 10)" for _, c in _CELLS) + ")") + ' SELECT "eventId" FROM facts SEMI JOIN w USING (day) WHERE event_id % 5 = 0')
def j13_visible_candidate_times(spark, sf):
    f = d.facts(spark, sf)
    return reports.visible_candidate_times(f.where("offset % 5 <> 0"), f.where("offset % 5 = 0")).select("eventId")


@query("SELECT cast(ts AS date) AS day, count(*) AS n FROM events WHERE cast(ts AS date) BETWEEN DATE '2024-01-05' AND DATE '2024-01-14' GROUP BY 1")
def p24_report_period(spark, sf):
    days = d.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return reports.filter_period(days, date(2024, 1, 5), date(2024, 1, 14))


# Envelopes ------------------------------------------------------------------------------------


@query(_ctes(d.ENVELOPES) + " SELECT count(*) AS records, count(*) FILTER (r NOT IN (0,1,2,3,5)) AS valid, count(*) FILTER (r IN (0,1,2,3,5)) AS malformed FROM recs")
def a9_batch_counts(spark, sf):
    return envelopes.batch_counts(envelopes.parse_records(d.envelopes(spark, sf)))


@query(_ctes(d.ENVELOPES) + """ SELECT partition, "offset", CASE WHEN r <> 1 THEN '00000000-0000-4000-8000-' || lpad(cast(event_id AS varchar), 12, '0') END AS "eventId", CASE WHEN r <> 1 THEN epoch_us(date_trunc('second', ts)) END AS occurred FROM recs""")
def p1_parse_records(spark, sf):
    p = envelopes.parse_records(d.envelopes(spark, sf))
    return p.select("partition", "offset", "eventId", F.unix_micros("occurredAt").alias("occurred"))


@query(_ctes(d.ENVELOPES) + ' SELECT partition, "offset", r NOT IN (0,1,2,3,5) AS "isValidEvent" FROM recs')
def p2_with_validity(spark, sf):
    return envelopes.with_validity(envelopes.parse_records(d.envelopes(spark, sf))).select("partition", "offset", "isValidEvent")


@query(_ctes(d.ENVELOPES) + ' SELECT partition, "offset", r NOT IN (0,1,3) AS created, false AS hired FROM recs')
def p3_payload_contracts(spark, sf):
    p = envelopes.parse_records(d.envelopes(spark, sf))
    return envelopes.payload_contract(p, "created", "hired").select("partition", "offset", "created", "hired")


def _with_headers(spark, sf):
    e = d.table(spark, sf, "events")
    k = F.col("event_id")
    header = lambda key, v: F.struct(F.lit(key).alias("key"), v.cast("binary").alias("value"))
    version = F.when(k % 7 == 0, "2").otherwise("1")
    base = F.array(header("hiring-schema-version", version), header("x-trace", F.when(k % 11 == 0, F.repeat(F.lit("z"), 300)).otherwise("z")))
    return e.select("event_id", F.when(k % 13 == 0, F.concat(base, F.array(header("x-trace", F.lit("y"))))).otherwise(base).alias("headers"))


@query("SELECT event_id, event_id % 13 = 0 OR event_id % 11 = 0 AS malformed, event_id % 7 <> 0 AS agrees FROM events")
def p4_header_contract(spark, sf):
    h = _with_headers(spark, sf)
    report = h.select("event_id", envelopes.header_report(h).alias("r"))
    return report.select("event_id", "r.malformed", F.col("r.version").alias("agrees"))


@query("SELECT event_id, CASE WHEN event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_id % 7 = 0 THEN 'UNSUPPORTED_SCHEMA_VERSION' ELSE 'INVALID_OPERATIONAL_EVENT_ENVELOPE' END AS reason FROM events")
def p6_quarantine_reason(spark, sf):
    h = _with_headers(spark, sf)
    return h.select("event_id", envelopes.quarantine_reason(h).alias("reason"))


@query(_ctes(d.ENVELOPES) + " SELECT 'valid' AS kind, count(*) AS n FROM recs WHERE r NOT IN (0,1,2,3,5) UNION ALL SELECT 'malformed', count(*) FROM recs WHERE r IN (0,1,2,3,5)")
def p5_valid_malformed_split(spark, sf):
    p = envelopes.parse_records(d.envelopes(spark, sf))
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n(envelopes.valid_events(p), "valid").unionByName(n(envelopes.malformed_events(p), "malformed"))


@query(_ctes(d.ENVELOPES) + """ SELECT partition, "offset", CASE WHEN r = 1 THEN 'tombstone:{"topic":"t","partition":' || partition || ',"offset":' || "offset" || '}' ELSE 'hash' END AS kind,
  'future:' || sha256('{"topic":"t","partition":' || partition || ',"offset":' || "offset" || '}') AS "futureId" FROM recs""")
def p7_quarantine_id(spark, sf):
    p = envelopes.parse_records(d.envelopes(spark, sf))
    found = envelopes.quarantine_id()
    kind = F.when(found == F.sha2("rawValue", 256), "hash").otherwise(found)
    return p.select("partition", "offset", kind.alias("kind"), envelopes.quarantine_id(future=True).alias("futureId"))


@query("SELECT event_id, sha256(event_id || ':' || event_type) AS \"eventFingerprint\" FROM events")
def p8_fingerprint(spark, sf):
    e = d.table(spark, sf, "events").withColumn("rawValue", F.concat_ws(":", F.col("event_id").cast("string"), "event_type"))
    return envelopes.with_fingerprint(e).select("event_id", "eventFingerprint")


def _known(spark, sf):
    return envelopes.valid_events(envelopes.with_fingerprint(envelopes.parse_records(d.envelopes(spark, sf))))


@query("SELECT '00000000-0000-4000-8000-' || lpad(cast(event_id AS varchar), 12, '0') AS \"eventId\" FROM events WHERE event_id % 40 = 4")
def a1_conflicting_ids(spark, sf):
    return ops.conflicting_ids(_known(spark, sf))


@query(_ctes(d.ENVELOPES) + ' SELECT count(*) AS n FROM recs WHERE r NOT IN (0,1,2,3,4,5)')
def j1_conflict_exclusion(spark, sf):
    v = _known(spark, sf)
    return ops.without_ids(v, ops.conflicting_ids(v)).agg(F.count("*").alias("n"))


@query(_ctes(d.ENVELOPES) + ' SELECT count(*) AS "validRows", count(DISTINCT CASE WHEN r = 4 THEN event_id END) AS "conflictingIds", count(*) FILTER (r = 4) AS "conflictingRecords" FROM recs WHERE r NOT IN (0,1,2,3,5)')
def a10_conflict_counts(spark, sf):
    v = _known(spark, sf)
    return ops.conflict_counts(v, ops.conflicting_ids(v))


@query(_ctes(d.ENVELOPES) + """ SELECT count(*) FILTER (r IN (0,1,2,3,5)) AS malformed, count(*) FILTER (r = 4) AS conflicting,
  count(*) FILTER (r NOT IN (0,1,2,3,5) AND date_trunc('second', ts) > TIMESTAMP '2024-01-20 12:05:00') AS future,
  count(*) FILTER (r NOT IN (0,1,2,3,5) AND date_trunc('second', ts) <= TIMESTAMP '2024-01-20 12:05:00' AND cast(ts AS date) < DATE '2024-01-10') AS closed FROM recs""")
def a11_admission_quality(spark, sf):
    known = envelopes.with_validity(envelopes.with_fingerprint(envelopes.parse_records(d.envelopes(spark, sf))))
    return ops.admission_quality(known, ops.conflicting_ids(known.where("isValidEvent")), d.OBSERVED, d.WATERMARK)


@query(_ctes(d.ENVELOPES) + ' SELECT partition, "offset" FROM recs WHERE r = 4')
def j8_conflict_rows(spark, sf):
    v = _known(spark, sf)
    return ops.conflict_rows(v, ops.conflicting_ids(v)).select("partition", "offset")


@query(_ctes(d.ENVELOPES) + """ SELECT "quarantineReason", count(*) AS n FROM (SELECT CASE WHEN r = 4 THEN 'CONFLICTING_DUPLICATE_EVENT' ELSE 'INVALID_OPERATIONAL_EVENT_ENVELOPE' END AS "quarantineReason" FROM recs WHERE r <= 5) GROUP BY 1""")
def p12_quarantine(spark, sf):
    known = envelopes.with_validity(envelopes.with_fingerprint(envelopes.parse_records(d.envelopes(spark, sf))))
    valid = known.where("isValidEvent")
    rows = ops.quarantine_union(known.where("not isValidEvent"), ops.conflict_rows(valid, ops.conflicting_ids(valid)), d.OBSERVED)
    return rows.groupBy("quarantineReason").agg(F.count("*").alias("n"))


def _tokenised(spark, sf):
    v = _known(spark, sf)
    return v.withColumn("subjectTokens", F.array(F.concat(F.lit("s"), F.regexp_extract("payload.candidateId", r"0*(\d+)$", 1)))).withColumn("subjectToken", F.col("subjectTokens")[0])


@query(_ctes(d.ENVELOPES) + ' SELECT partition, "offset", \'s\' || user_id AS "subjectToken" FROM recs WHERE r NOT IN (0,1,2,3,5)')
def p9_bronze_projection(spark, sf):
    return ops.to_bronze(_tokenised(spark, sf)).select("partition", "offset", "subjectToken")


@query(_ctes(d.ENVELOPES) + " SELECT '00000000-0000-4000-8000-' || lpad(cast(event_id AS varchar), 12, '0') AS \"eventId\", epoch_us(date_trunc('second', ts)) AS occurred FROM recs WHERE r NOT IN (0,1,2,3,4,5) AND user_id % 17 <> 0")
def p10_silver_projection(spark, sf):
    return ops.to_silver(_tokenised(spark, sf), d.markers(spark, sf)).select("eventId", F.unix_micros("occurredAt").alias("occurred"))


@query(_ctes(d.FACTS) + " SELECT \"eventId\", 'CLOSED_DAY' AS \"admissionReason\" FROM facts WHERE day < DATE '2024-01-10' AND user_id % 17 <> 0")
def p11_late_facts(spark, sf):
    rows = ops.with_admission(d.facts(spark, sf), d.OBSERVED, d.WATERMARK).where("admission.status = 'CLOSED'")
    rows = rows.withColumns({"aggregateType": F.lit("Application"), "aggregateId": F.col("applicationId"), "jobId": F.lit(None).cast("string")})
    return ops.to_late_facts(rows, d.markers(spark, sf), d.OBSERVED).select("eventId", "admissionReason")


@query(_ctes(d.FACTS) + " SELECT \"eventId\" FROM facts WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 12:00:00'")
def p14_unexpired(spark, sf):
    rows = d.facts(spark, sf).withColumn("expiresAt", F.col("occurredAt") + F.expr("INTERVAL 7 DAYS"))
    return ops.unexpired(rows, d.OBSERVED).select("eventId")


@query("SELECT count(*) AS n, epoch_us(TIMESTAMP '2024-01-27 12:00:00') AS expires FROM events")
def p13_expiry_stamp(spark, sf):
    return ops.with_expiry(d.facts(spark, sf), d.OBSERVED, 7).groupBy(F.unix_micros("expiresAt").alias("expires")).agg(F.count("*").alias("n"))


_ADMIT = "CASE WHEN ts > TIMESTAMP '2024-01-20 12:05:00' THEN 'FUTURE' WHEN cast(ts AS date) < DATE '2024-01-10' THEN 'CLOSED' ELSE 'OPEN' END"


@query(f"SELECT event_id, {_ADMIT} AS status, CASE WHEN {_ADMIT} = 'OPEN' THEN least(epoch_us(ts), epoch_us(TIMESTAMP '2024-01-20 12:00:00')) END AS effective FROM events")
def p15_event_time_admission(spark, sf):
    e = d.table(spark, sf, "events").withColumn("a", ops.classify_event_time(F.col("ts"), d.OBSERVED, d.WATERMARK))
    return e.select("event_id", "a.status", F.unix_micros("a.effectiveTime").alias("effective"))


@query(f"SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE {_ADMIT} = 'OPEN'")
def p16_open_facts(spark, sf):
    return ops.open_facts(d.facts(spark, sf), d.OBSERVED, d.WATERMARK).select("eventId")


@query(f"SELECT 5 AS batch, 1 AS generation, 2 AS revision, 86400 AS \"latenessSeconds\", count(*) FILTER ({_ADMIT} = 'CLOSED') AS closed, count(*) FILTER ({_ADMIT} = 'FUTURE') AS future FROM events")
def r6_admission_metrics(spark, sf):
    return batches.admission_metrics(ops.with_admission(d.facts(spark, sf), d.OBSERVED, d.WATERMARK), 5, 1, 2)


@query("SELECT epoch_us(greatest(least(max(ts), TIMESTAMP '2024-01-20 12:00:00') - INTERVAL 24 HOUR, TIMESTAMP '2024-01-10')) AS watermark FROM events")
def r3_candidate_watermark(spark, sf):
    return batches.candidate_watermark(d.facts(spark, sf), d.WATERMARK, d.OBSERVED).select(F.unix_micros("watermark").alias("watermark"))


@query(f"SELECT user_id, CASE WHEN count(*) FILTER ({_ADMIT} = 'FUTURE') > 3 THEN 'QualityBlocked' WHEN user_id % 17 = 0 THEN 'ErasurePending' ELSE 'Publish' END AS outcome FROM events GROUP BY user_id")
def r7_batch_outcome(spark, sf):
    a = d.table(spark, sf, "events").withColumn("a", ops.classify_event_time(F.col("ts"), d.OBSERVED, d.WATERMARK))
    g = a.groupBy("user_id").agg((F.count(F.when(F.col("a.status") == "FUTURE", 1)) - 3).alias("future"))
    return g.select("user_id", batches.batch_outcome(F.greatest("future", F.lit(0)), (F.col("user_id") % 17 == 0).cast("int")).alias("outcome"))


# Joins against stored facts -------------------------------------------------------------------


def _stored(spark, sf):
    f = d.facts(spark, sf)
    changed = F.when(F.col("offset") % 10 == 0, F.concat(F.col("eventFingerprint"), F.lit("x"))).otherwise(F.col("eventFingerprint"))
    return f.where("offset % 2 = 0").withColumn("eventFingerprint", changed)


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE event_id % 10 = 0")
def j4_historical_conflicts(spark, sf):
    return ops.historical_conflicts(d.facts(spark, sf), _stored(spark, sf))


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE event_id % 10 = 0")
def j5_coordinate_conflicts(spark, sf):
    return ops.coordinate_conflicts(d.facts(spark, sf), _stored(spark, sf))


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 0")
def j6_newly_admitted(spark, sf):
    f = d.facts(spark, sf)
    return ops.newly_admitted(f, f.where("offset % 3 = 0"), f.where("offset % 4 = 0")).select("eventId")


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE cast(ts AS date) < DATE '2024-01-10' AND event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0")
def j7_late_not_admitted(spark, sf):
    f = d.facts(spark, sf)
    closed = ops.with_admission(f, d.OBSERVED, d.WATERMARK).where("admission.status = 'CLOSED'")
    return ops.late_not_admitted(closed, f.where("offset % 3 = 0"), f.where("offset % 5 = 0"), f.where("offset % 7 = 0")).select("eventId")


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE event_id % 6 = 0 OR event_id % 10 = 0")
def u1_conflict_union(spark, sf):
    f = d.facts(spark, sf)
    return ops.all_conflicts(f.where("offset % 6 = 0"), ops.historical_conflicts(f, _stored(spark, sf)))


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE event_id % 6 = 0 AND event_id % 9 <> 0")
def u6_new_conflicts(spark, sf):
    f = d.facts(spark, sf)
    return ops.new_conflicts(f.where("offset % 6 = 0").select("eventId"), f.where("offset % 9 = 0")).select("eventId")


@query("SELECT user_id, max_by(event_id, event_id) AS last FROM events GROUP BY user_id")
def w5_latest_by(spark, sf):
    return ops.latest_by(d.table(spark, sf, "events"), ["user_id"], "event_id").select("user_id", F.col("event_id").alias("last"))


@query("SELECT l_orderkey, l_linenumber AS n, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def w1_first_by(spark, sf):
    return ops.first_by(d.table(spark, sf, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"]).select("l_orderkey", F.col("l_linenumber").alias("n"), "l_partkey")


_LINE = "('t:' || (event_id % 3) || ':' || event_id || ':' || sha256(sha256(event_id || '|' || event_type)))"


@query(f'SELECT event_id % 3 AS partition, count(*) AS records, min(event_id) AS "startOffset", max(event_id) + 1 AS "endOffsetExclusive", {set_digest_sql(_LINE)} AS digest FROM events GROUP BY 1')
def a13_input_fingerprint(spark, sf):
    return ops.input_fingerprint(d.facts(spark, sf).withColumn("rawValue", F.col("eventFingerprint"))).select("partition", "records", "startOffset", "endOffsetExclusive", "digest")


@query(f"WITH m AS (SELECT DISTINCT 's' || user_id AS t FROM events WHERE user_id % 17 = 0) SELECT count(*) AS markers, {set_digest_sql('t')} AS fingerprint FROM m")
def a14_marker_fingerprint(spark, sf):
    return ops.marker_fingerprint(d.markers(spark, sf))


@query("WITH r AS (SELECT event_id % 3 AS p, min(event_id) AS a, max(event_id) + 1 AS b FROM events GROUP BY 1), l AS (SELECT '1:t' || length(cast(p AS varchar)) || ':' || p || length(cast(a AS varchar)) || ':' || a || length(cast(b AS varchar)) || ':' || b AS s FROM r) SELECT sha256(string_agg(s, ';' ORDER BY s)) AS fingerprint FROM l")
def a15_range_fingerprint(spark, sf):
    return ops.range_fingerprint(_ranges(spark, sf))


# Subjects -------------------------------------------------------------------------------------


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE user_id % 17 <> 0")
def j2_exclude_markers(spark, sf):
    return privacy.exclude_markers(d.facts(spark, sf), d.markers(spark, sf)).select("eventId")


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE user_id % 17 = 0")
def j3_matched_by_subject(spark, sf):
    return privacy.matched_by_subject(d.facts(spark, sf), d.markers(spark, sf), ("eventId",)).select("eventId")


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE event_id % 50 NOT IN (SELECT event_id % 50 FROM events WHERE user_id % 17 = 0 AND event_id % 50 < 10)")
def j11_without_marked_applications(spark, sf):
    f = d.facts(spark, sf).withColumn("applicationId", (F.col("offset") % 50).cast("string"))
    marked = f.where("offset % 50 < 10")
    rest = f.where("offset % 50 >= 10").withColumn("subjectTokens", F.array(F.lit("none")))
    return privacy.without_marked_applications(marked.unionByName(rest), d.markers(spark, sf)).select("eventId")


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE user_id % 17 <> 0 AND event_id % 23 <> 0")
def s13_purge_marked(spark, sf):
    f = d.facts(spark, sf).withColumn("subjectTokens", F.when(F.col("offset") % 23 == 0, F.array().cast("array<string>")).otherwise(F.col("subjectTokens")))
    return privacy.purge_marked(f, d.markers(spark, sf), ("eventId",)).select("eventId")


@query("SELECT count(*) AS suppressed FROM events WHERE user_id % 17 = 0")
def a12_suppressed(spark, sf):
    f = d.facts(spark, sf)
    flagged = privacy.matched_by_subject(f, d.markers(spark, sf), ("eventId",))
    return flagged.agg(F.count("*").alias("suppressed"))


@query("SELECT 'events' AS \"table\", count(*) AS marked FROM events WHERE user_id % 17 = 0 UNION ALL SELECT 'odd', count(*) FROM events WHERE user_id % 17 = 0 AND event_id % 2 = 1")
def s24_count_marked(spark, sf):
    f = d.facts(spark, sf)
    return privacy.count_marked({"events": f, "odd": f.where("offset % 2 = 1")}, d.markers(spark, sf))


@query("SELECT count(*) AS rows FROM events WHERE contains(cast(user_id AS varchar), '77') OR contains(cast(event_id AS varchar), '77')")
def s22_find_text_reference(spark, sf):
    return privacy.find_text_reference(d.table(spark, sf, "events").select("user_id", "event_id"), "77").agg(F.count("*").alias("rows"))


@query("SELECT 0 AS priority, 'a' AS \"table\", count(*) AS rows FROM events WHERE user_id % 4 = 1 HAVING count(*) > 0")
def p28_token_key_violations(spark, sf):
    f = d.facts(spark, sf).withColumns({"expiresAt": F.lit(d.OBSERVED), "subjectToken": F.concat(F.when(F.col("subjectToken").rlike("."), F.concat(F.lit("k"), (F.regexp_extract("subjectToken", r"\d+", 0).cast("long") % 4).cast("string"), F.lit("_x"))))})
    ones = f.where("subjectToken like 'k1%' or subjectToken like 'k2%'")
    return privacy.token_key_violations({"a": ones, "b": ones.limit(0)}, "k2", d.WATERMARK)


@query("SELECT DISTINCT 'a' AS \"table\", 's' || user_id AS token FROM events")
def p29_invalid_tokens(spark, sf):
    return privacy.invalid_tokens({"a": d.facts(spark, sf)}, ["k1", "k2"])


@query("SELECT cast(n_nationkey AS varchar) AS \"keyId\", CASE WHEN n_nationkey < 10 AND n_nationkey >= 5 THEN CASE WHEN n_nationkey = 7 THEN 'CHANGED' ELSE 'UNCHANGED' END WHEN n_nationkey < 5 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'REMOVED' ELSE 'RETIRED' END ELSE CASE WHEN n_nationkey % 2 = 0 THEN 'UNANCHORED' ELSE 'NEW' END END AS verdict FROM nation WHERE n_nationkey < 15")
def p30_reconcile_keys(spark, sf):
    n = d.table(spark, sf, "nation").withColumn("keyId", F.col("n_nationkey").cast("string"))
    k = F.col("n_nationkey")
    registry = n.where(k < 10).select("keyId", F.col("n_name").alias("verifier"))
    configured = n.where((k >= 5) & (k < 15)).select("keyId", F.when(k == 7, "other").otherwise(F.col("n_name")).alias("verifier"))
    return privacy.reconcile_keys(registry, configured, n.where((k < 15) & (k % 2 == 0)))


@query()
def f1_subject_tokens(spark, sf):
    v = _known(spark, sf)
    return privacy.with_subject_tokens(v, "k1", b"example-key-of-32-bytes-or-more!!").select("partition", "offset", "subjectToken", "subjectTokens")


@query()
def f2_marker_tokens(spark, sf):
    ids = d.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("subjectId"))
    return privacy.marker_tokens(ids, {"k1": b"example-key-of-32-bytes-or-more!!", "k0": b"earlier-key-of-32-bytes-or-more!!"})


@query()
def s21_marked_files(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet")
    rows = raw.select("*", F.array(F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("subjectTokens"))
    return privacy.marked_files(rows, d.markers(spark, sf))


# Sources --------------------------------------------------------------------------------------


def _ranges(spark, sf):
    e = d.table(spark, sf, "events").withColumn("partition", (F.col("event_id") % 3).cast("int"))
    return e.groupBy("partition").agg(F.min("event_id").alias("startOffset"), (F.max("event_id") + 1).alias("endOffsetExclusive")).withColumn("topic", F.lit("t"))


@query("SELECT event_id % 3 AS partition, count(*) AS records, CASE WHEN count(DISTINCT event_id) = max(event_id) - min(event_id) + 1 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS verdict FROM events GROUP BY 1")
def s4_offset_coverage(spark, sf):
    return src.offset_coverage(d.facts(spark, sf), _ranges(spark, sf)).select("partition", "records", "verdict")


@query("SELECT event_id % 3 AS partition, CASE event_id % 3 WHEN 0 THEN 'EXPIRED' WHEN 1 THEN 'NOT_YET_AVAILABLE' ELSE 'AVAILABLE' END AS verdict FROM events GROUP BY ALL")
def s5_offset_availability(spark, sf):
    r = _ranges(spark, sf)
    p = F.col("partition")
    bounds = r.select("topic", "partition", F.when(p == 0, F.col("startOffset") + 1).otherwise(F.col("startOffset")).alias("earliest"), F.when(p == 1, F.col("endOffsetExclusive") - 1).otherwise(F.col("endOffsetExclusive")).alias("latest"))
    return src.offset_availability(r, bounds).select("partition", "verdict")


@query("SELECT event_id AS \"offset\" FROM events WHERE (event_id % 3 = 0 AND event_id < 300) OR (event_id % 3 = 2 AND event_id BETWEEN 100 AND 199)")
def s1_offset_range(spark, sf):
    from ..sources.shared import shared_path

    path = shared_path(spark)
    d.facts(spark, sf).select("topic", "partition", "offset", F.col("eventFingerprint").cast("binary").alias("value"), F.col("occurredAt").alias("timestamp")).write.parquet(path)
    return src.read_offset_range(spark, [("t", 0, 0, 300), ("t", 2, 100, 200)], {"path": path}, "files").select("offset")


_SPEC = TableSpec("t", "eventId STRING NOT NULL, n BIGINT", ("n >= 10",), key=("eventId",))


@query("SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE cast(event_id AS varchar) END AS \"eventId\", user_id AS n, (CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END) + (CASE WHEN user_id < 10 THEN 1 ELSE 0 END) AS broken FROM events WHERE event_id % 9 = 0 OR user_id < 10")
def s7_check_rows(spark, sf):
    e = d.table(spark, sf, "events")
    rows = e.select(F.when(F.col("event_id") % 9 != 0, F.col("event_id").cast("string")).alias("eventId"), F.col("user_id").alias("n"))
    return tables.check_rows(rows, _SPEC).select("eventId", "n", F.size("violations").alias("broken"))


@query("SELECT cast(event_id AS varchar) AS \"eventId\", CASE WHEN event_id % 3 <> 0 THEN 'stored' ELSE 'new' END AS \"newStatus\" FROM events")
def s8_merge_insert_only(spark, sf):
    f = d.facts(spark, sf)
    stored = f.where("offset % 3 <> 0").withColumn("newStatus", F.lit("stored"))
    batch = f.where("offset % 2 = 0 or offset % 3 = 0").withColumn("newStatus", F.lit("new"))
    merged = tables.merge_insert_only(stored, batch, ["eventId"])
    return tables.merge_insert_only(merged, batch.withColumn("newStatus", F.lit("again")), ["eventId"]).select("eventId", "newStatus")


@query("SELECT event_id % 3 AS partition, count(*) AS n FROM events WHERE event_id BETWEEN 100 AND 200 GROUP BY 1")
def s9_bound_target(spark, sf):
    f = d.facts(spark, sf)
    low_high = f.where("offset between 100 and 200")
    exact = tables.bound_target(f, low_high, ["topic", "partition", "offset"])
    return exact.groupBy("partition").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, count(*) FILTER (ts <= TIMESTAMP '2024-01-20 12:00:00') AS stale FROM events")
def s10_freshness(spark, sf):
    return tables.freshness(d.table(spark, sf, "events").withColumn("expiresAt", F.col("ts")), d.OBSERVED)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE event_type END AS event_type FROM events")
def s11_merge_upsert(spark, sf):
    e = d.table(spark, sf, "events").select("event_id", "event_type")
    return tables.merge_upsert(e, e.where("event_id % 3 = 0").withColumn("event_type", F.lit("new")), ["event_id"])


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'")
def s18_expire(spark, sf):
    return tables.expire(d.table(spark, sf, "events").withColumn("expiresAt", F.col("ts")), d.OBSERVED).select("event_id")


@query("SELECT r_regionkey AS revision, CASE WHEN r_regionkey = 4 THEN 'INVALID_EXPIRY' WHEN r_regionkey = 1 THEN 'ALREADY_PUBLISHED' WHEN r_regionkey = 3 THEN 'STALE_GENERATION' WHEN r_regionkey <= 1 THEN 'STALE_REVISION' ELSE 'PUBLISH' END AS verdict FROM region")
def s16_publication_decision(spark, sf):
    r = d.table(spark, sf, "region")
    k = F.col("r_regionkey").cast("bigint")
    control = r.where("r_regionkey = 1").select(F.lit("published").alias("state"), F.lit(7).cast("bigint").alias("generation"), k.alias("revision"), F.lit("run1").alias("runId"), F.lit(d.OBSERVED).alias("asOf"), F.lit(d.OBSERVED + timedelta(days=30)).alias("expiresAt"))
    asks = r.select(F.concat(F.lit("run"), k.cast("string")).alias("runId"), F.when(k == 3, 6).otherwise(7).cast("bigint").alias("generation"), k.alias("revision"), F.lit(d.OBSERVED).alias("asOf"), F.when(k == 4, F.lit(d.WATERMARK)).otherwise(F.lit(d.OBSERVED + timedelta(days=30))).alias("expiresAt"))
    return snapshots.publication_decision(control, asks).select(F.col("revision").cast("int").alias("revision"), "verdict")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 2 AND o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1996-01-01'")
def s17_latest_snapshot(spark, sf):
    o = d.table(spark, sf, "orders")
    snaps = o.select("o_orderkey", F.lit(1).alias("generation"), (F.col("o_orderkey") % 5).alias("revision"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("state"), F.col("o_orderdate").alias("expiresAt"))
    control = o.limit(1).select(F.lit(1).alias("generation"), F.lit(2).cast("bigint").alias("revision"))
    from datetime import datetime

    return snapshots.latest_snapshot(control, snaps, datetime(1996, 1, 1)).select("o_orderkey")


@query("SELECT cast(o_orderkey AS varchar) AS \"runId\" FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey % 3 <> 0")
def s25_prune_receipts(spark, sf):
    o = d.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "abandoned").otherwise("reserved")
    runs = o.select(F.col("o_orderkey").cast("string").alias("runId"), status.alias("status"), F.col("o_orderdate").alias("updatedAt"))
    from datetime import datetime

    return snapshots.prune_receipts(runs, runs.where(F.col("runId").cast("long") % 3 == 0), datetime(1996, 2, 1)).select("runId")


# Journal --------------------------------------------------------------------------------------


def _progress(spark, sf):
    o = d.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    outcome = F.when(k % 5 == 0, "Published").when(k % 5 == 1, "QualityBlocked").when(k % 5 == 2, "Prepared").otherwise("Empty")
    return o.select(F.concat(F.lit("l"), (F.col("o_custkey") % 4).cast("string")).alias("lineage"), k.alias("batchId"), outcome.alias("outcome"), F.when(k % 5 == 0, F.col("o_orderdate")).alias("candidateWatermark"), F.when(k % 5 != 2, F.col("o_orderdate")).alias("completedAt"))


@query("SELECT epoch_us(max_by(o_orderdate, o_orderkey)) AS watermark, max(o_orderkey) AS \"batchId\" FROM orders WHERE o_custkey % 4 = 1 AND o_orderkey % 5 = 0")
def t3_latest_watermark(spark, sf):
    return journal.latest_watermark(_progress(spark, sf), "l1").select(F.unix_micros("watermark").alias("watermark"), "batchId")


_KEEP = "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 2 OR o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderkey % 97 = 0 UNION SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 5 <> 2 GROUP BY o_custkey % 4 UNION SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 5 = 0 GROUP BY o_custkey % 4"


@query(f"SELECT o_orderkey AS \"batchId\" FROM ({_KEEP})")
def j14_prune_progress(spark, sf):
    from datetime import datetime

    p = _progress(spark, sf)
    return journal.prune_progress(p, p.limit(0), p.where("batchId % 97 = 0"), datetime(1998, 2, 1)).select("batchId")


@query(
    "WITH c AS (SELECT o_orderkey AS b, o_orderkey * 10 + (CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS e FROM orders WHERE o_orderkey % 7 <> 0) "
    "SELECT o_orderkey AS \"batchId\", CASE WHEN o_orderkey % 7 = 0 THEN 'JOURNAL_ONLY' WHEN o_orderkey % 11 = 0 THEN 'OFFSETS_DIFFER' WHEN o_orderkey % 13 = 0 THEN 'COMMITTED_UNFINISHED' ELSE 'OK' END AS verdict FROM orders"
)
def j21_reconcile_checkpoint(spark, sf):
    o = d.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    progress = o.select(k.alias("batchId"), (k * 10).alias("endOffset"), F.lit(10**12).alias("startOffset"), F.when(k % 13 == 0, "Prepared").otherwise("Published").alias("outcome"))
    check = o.where(k % 7 != 0).select(k.alias("batchId"), (k * 10 + F.when(k % 11 == 0, 1).otherwise(0)).alias("endOffset"), F.lit(True).alias("committed"))
    return journal.reconcile_checkpoint(progress, check).select("batchId", "verdict")


@query("SELECT o_orderkey AS \"batchId\" FROM orders WHERE o_orderkey % 4 = 0")
def j14_orphan_decisions(spark, sf):
    p = _progress(spark, sf)
    return journal.orphan_decisions(p.where("batchId % 4 <> 0"), p).select("batchId")


@query("SELECT cast(event_id AS varchar) AS \"eventId\", event_id % 10 = 0 AS conflict, event_id % 2 = 1 AS fresh FROM events")
def r2_assess(spark, sf):
    f, s = d.facts(spark, sf).withColumn("isValidEvent", F.lit(True)), _stored(spark, sf)
    return batches.assess(f.withColumn("rawValue", F.col("eventId")), s, s, d.OBSERVED, d.WATERMARK).select("eventId", "conflict", "fresh")


# What one batch changes ------------------------------------------------------------------------


def _lake(spark):
    """An empty lake in the shared folder."""
    return jobs.Lake(spark, shared_path(spark), "k1", b"x" * 32)


def _silver(spark, sf):
    """The events as Silver facts, by user."""
    f = d.facts(spark, sf, by_user=True)
    whole = f.select("*", F.lit("Application").alias("aggregateType"), F.col("applicationId").alias("aggregateId"), F.lit("j").alias("jobId"), F.lit(d.OBSERVED).alias("ingestedAt"), F.lit(d.OBSERVED + timedelta(days=30)).alias("expiresAt"))
    return tables.conform(whole, TABLES["silver_operational_events"])


@query(SQL["a6_stage_times"])
def s12_upsert_by_bucket(spark, sf):
    """Stage times stored from most facts; the rest arrives as a batch that writes the buckets it touches."""
    lake, spec = _lake(spark), TABLES["silver_application_stage_times"]
    f, late = _silver(spark, sf), F.col("eventId").cast("long") % 7 == 0
    for part in (f.where(~late), f.where(late)):
        tables.upsert_parts(tables.conform(reports.stage_times(part), spec), lake.path(spec.name), spec, reports.merge_stage_times)
    return _stages_out(lake.read(spec.name))


@query(
    _ctes(d.FACTS)
    + " SELECT day, "
    + ", ".join(f"count(DISTINCT CASE WHEN {c} THEN 'a' || user_id END) AS {n}" for n, c in _CELLS)
    + " FROM facts GROUP BY day HAVING "
    + " AND ".join(f"(count(DISTINCT CASE WHEN {c} THEN subj END) = 0 OR count(DISTINCT CASE WHEN {c} THEN subj END) >= 10)" for _, c in _CELLS)
)
def x6_gold_by_touched_day(spark, sf):
    """Reports built from the facts before a day, then made anew for the days that a later batch touches."""
    lake = _lake(spark)
    f, batch = _silver(spark, sf), F.to_date("occurredAt") >= F.lit(date(2024, 1, 20))
    for part in (f.where(~batch | (F.col("eventId").cast("long") % 2 == 0)), f.where(batch)):
        lake.mark_stale(tables.parts_of(part, TABLES["silver_operational_events"]))
        lake.merge("silver_operational_events", part)
        jobs.refresh_gold(lake, d.OBSERVED)
    return lake.read("gold_application_funnel")


@query("SELECT cast(event_id AS varchar) AS \"eventId\" FROM events WHERE user_id % 17 <> 0 AND ts > TIMESTAMP '2024-01-05 00:00:00'")
def s13_purge_by_touched_day(spark, sf):
    """Expired and marked rows leave the folders that hold some; other folders' files stay."""
    lake, spec = _lake(spark), TABLES["silver_operational_events"]
    lake.merge(spec.name, _silver(spark, sf).withColumn("expiresAt", F.greatest(F.col("ingestedAt") + F.expr("interval 1 second"), F.when(F.col("occurredAt") > F.lit(datetime(2024, 1, 5)), F.lit(d.OBSERVED + timedelta(days=30))))))
    now = d.OBSERVED + timedelta(days=1)
    tables.delete_where(spark, lake.path(spec.name), spec, lake.read(spec.name).where(F.col("expiresAt") <= F.lit(now)), lambda rows: tables.expire(rows, now))
    jobs.purge(lake, d.markers(spark, sf))
    return lake.read(spec.name).select("eventId")
