"""Report extracts and their publication."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .tables import bounded

MOST_ROWS = 10_000
CONTROL = "state STRING, generation BIGINT, revision BIGINT, runId STRING, asOf TIMESTAMP, expiresAt TIMESTAMP"


@dataclass(frozen=True)
class Report:
    as_of: datetime
    funnel: list[Row]
    time_to_hire: Row | None
    stage_durations: list[Row]
    skills: list[Row]


def extract_report(gold: dict[str, DataFrame], as_of: datetime, most: int = MOST_ROWS) -> Report:
    """The published families' rows, of a bounded number and without nulls."""

    def rows(name: str, order: list[str]) -> list[Row]:
        got = bounded(gold[name].orderBy(*order), most).collect()
        if len(got) > most:
            raise ValueError(f"{name}: more than {most} rows")
        if any(v is None for r in got for v in r):
            raise ValueError(f"{name}: a cell is null")
        return got

    hire = rows("gold_time_to_hire", ["p50Hours"])
    if len(hire) > 1:
        raise ValueError("time to hire has one row")
    return Report(as_of, rows("gold_application_funnel", ["day"]), hire[0] if hire else None, rows("gold_hiring_stage_durations", ["metric"]), rows("gold_job_skills", ["day", "skill"]))


def publication_decision(control: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdict by request ``(runId, generation, revision, asOf, expiresAt)`` against the control row."""
    c = control.select(F.col("generation").alias("g"), F.col("revision").alias("r"), F.col("runId").alias("run"))
    one = c.first()
    g, r, run = (one["g"], one["r"], one["run"]) if one else (0, -1, None)
    both = requests.withColumns({"g": F.lit(g), "r": F.lit(r), "run": F.lit(run)})
    verdict = (
        F.when(F.col("expiresAt") <= F.col("asOf"), "INVALID_EXPIRY")
        .when((F.col("runId") == F.col("run")) & (F.col("revision") == F.col("r")), "ALREADY_PUBLISHED")
        .when(F.col("generation") != F.col("g"), "STALE_GENERATION")
        .when(F.col("revision") <= F.col("r"), "STALE_REVISION")
        .otherwise("PUBLISH")
    )
    return both.select(*requests.columns, verdict.alias("verdict"))


def publish_snapshot(control: DataFrame, request: DataFrame) -> DataFrame:
    """The control row after one request; refused requests leave it as it was."""
    ok = publication_decision(control, request).where("verdict = 'PUBLISH'")
    new = ok.select(F.lit("published").alias("state"), "generation", "revision", "runId", "asOf", "expiresAt")
    return new.unionByName(control.select(*new.columns)).orderBy(F.desc("revision")).limit(1)


def as_json(report: Report) -> str:
    """A report's families as one JSON text; bounded, since an extract is."""
    family = lambda rows: [r.asDict() for r in rows]
    hire = report.time_to_hire.asDict() if report.time_to_hire else None
    return json.dumps({"funnel": family(report.funnel), "timeToHire": hire, "stageDurations": family(report.stage_durations), "skills": family(report.skills)}, default=str)


def latest_snapshot(control: DataFrame, snapshots: DataFrame, now: datetime) -> DataFrame:
    """Published snapshots of the control row's generation and revision that have not expired."""
    c = control.select("generation", "revision")
    return snapshots.join(c, ["generation", "revision"], "left_semi").where((F.col("state") == "published") & (F.col("expiresAt") > F.lit(now)))


def prune_receipts(runs: DataFrame, referenced: DataFrame, now: datetime, ttl_days: int = 31) -> DataFrame:
    """Receipts that may go: settled, older than the horizon, and referenced by nothing."""
    old = F.col("updatedAt") < F.lit(now) - F.make_interval(days=F.lit(ttl_days))
    return runs.where(F.col("status").isin("published", "abandoned") & old).join(referenced.select("runId"), "runId", "left_anti")
