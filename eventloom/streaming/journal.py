"""The batch journal: progress and decision tables, their checks and pruning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import with_previous
from ..operators.facts import latest_by, marker_fingerprint
from ..sources.tables import merge_insert_only, merge_upsert

PREPARED, INGESTED = "Prepared", "IngestionCommitted"
TERMINAL = ("Published", "QualityBlocked", "ErasurePending", "Empty")
ATTEMPTS = 3


def journal_prepare(progress: DataFrame, row: DataFrame) -> DataFrame:
    """Record a batch's input once; the same batch with other evidence is refused."""
    same = progress.select("lineage", "batchId", F.col("inputFingerprint").alias("was")).join(row, ["lineage", "batchId"])
    if not same.where("was <> inputFingerprint").isEmpty():
        raise ValueError("the batch was recorded with other input")
    return merge_insert_only(progress, row.withColumn("outcome", F.lit(PREPARED)), ["lineage", "batchId"])


def journal_move(progress: DataFrame, lineage: str, batch: int, outcome: str, at: datetime, watermark=None) -> DataFrame:
    """Prepared → IngestionCommitted → a terminal outcome; nothing moves back."""
    now = progress.where((F.col("lineage") == lineage) & (F.col("batchId") == batch))
    held = now.first()
    steps = {PREPARED: (INGESTED, *TERMINAL), INGESTED: TERMINAL}
    if held is None or (held["outcome"] != outcome and outcome not in steps.get(held["outcome"], ())):
        raise ValueError("no such step in the journal")
    done = outcome in TERMINAL
    new = now.withColumn("outcome", F.lit(outcome))
    if done:
        new = new.withColumn("completedAt", F.lit(at).cast("timestamp")).withColumn("candidateWatermark", F.lit(watermark).cast("timestamp"))
    return merge_upsert(progress, new, ["lineage", "batchId"])


def journal_append(decisions: DataFrame, row: DataFrame) -> DataFrame:
    """Append the next decision revision (0, 1, 2, …) of a batch."""
    last = decisions.join(row.select("lineage", "batchId"), ["lineage", "batchId"], "left_semi").agg(F.max("revision").alias("m")).first()["m"]
    if row.first()["revision"] != (0 if last is None else last + 1):
        raise ValueError("decision revisions follow one another")
    if last is not None and last + 1 >= ATTEMPTS:
        raise ValueError("too many decision attempts")
    return decisions.unionByName(row.select(*decisions.columns))


def decide(decisions: DataFrame, row: DataFrame) -> DataFrame:
    """The decisions with one that publishes a batch under the row's view of the markers.

    The batch's last decision stands if it saw the same markers; otherwise the next revision is
    added, three at most.
    """
    mine = decisions.join(row.select("lineage", "batchId"), ["lineage", "batchId"], "left_semi")
    last = latest_decisions(mine).first()
    if last is not None and last["deletionMarkerFingerprint"] == row.first()["deletionMarkerFingerprint"]:
        return decisions
    following = 0 if last is None else last["revision"] + 1
    return journal_append(decisions, row.withColumn("revision", F.lit(following)))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    return latest_by(decisions, ["lineage", "batchId"], "revision")


def latest_watermark(progress: DataFrame, lineage: str) -> DataFrame:
    """The watermark of the last published batch."""
    rows = progress.where((F.col("lineage") == lineage) & (F.col("outcome") == "Published") & F.col("candidateWatermark").isNotNull())
    return rows.agg(F.max_by("candidateWatermark", "batchId").alias("watermark"), F.max("batchId").alias("batchId"))


def prune_progress(progress: DataFrame, decisions: DataFrame, retained: DataFrame, now: datetime, ttl_days: int = 31) -> DataFrame:
    """Rows to keep: unfinished, retained by Spark, recent, last terminal and last with a watermark by lineage."""
    key = ["lineage", "batchId"]
    recent = progress.where(F.col("completedAt").isNull() | (F.col("completedAt") >= F.lit(now) - F.make_interval(days=F.lit(ttl_days)))).select(*key)
    last = progress.where(F.col("outcome").isin(*TERMINAL)).groupBy("lineage").agg(F.max("batchId").alias("batchId"))
    marked = progress.where("candidateWatermark is not null").groupBy("lineage").agg(F.max("batchId").alias("batchId"))
    keep = recent.union(last.select(*key)).union(marked.select(*key)).union(retained.select(*key)).distinct()
    return progress.join(keep, key, "left_semi")


def orphan_decisions(progress: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions whose batch the journal no longer holds."""
    return decisions.join(progress.select("lineage", "batchId"), ["lineage", "batchId"], "left_anti")


def reconcile_checkpoint(progress: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Verdict by batch over ``(batchId, endOffset, startOffset, outcome)`` and ``(batchId, endOffset, committed)``.

    A batch's predecessor is found by ranges of batch ids, so no task sees them all.
    """
    j = progress.select("batchId", F.col("endOffset").alias("journalEnd"), "startOffset", "outcome")
    c = checkpoint.select("batchId", F.col("endOffset").alias("sparkEnd"), "committed")
    both = j.join(c, "batchId", "full")
    both = with_previous(both, "batchId", "sparkEnd", "previousEnd")
    done = F.coalesce(F.col("outcome").isin(*TERMINAL), F.lit(False))
    verdict = (
        F.when(F.col("sparkEnd").isNull(), "JOURNAL_ONLY")
        .when(F.col("committed") & F.col("journalEnd").isNull(), "COMMITTED_WITHOUT_JOURNAL")
        .when(F.col("journalEnd").isNull(), "CHECKPOINT_ONLY")
        .when(F.col("journalEnd") != F.col("sparkEnd"), "OFFSETS_DIFFER")
        .when(F.col("startOffset") < F.coalesce("previousEnd", F.col("startOffset")), "DELIVERED_OUTSIDE")
        .when(F.col("committed") & ~done, "COMMITTED_UNFINISHED")
        .otherwise("OK")
    )
    return both.select("batchId", verdict.alias("verdict"), done.alias("finished"))


#: Verdicts under which a stream must not start.
REFUSED = ("COMMITTED_WITHOUT_JOURNAL", "OFFSETS_DIFFER", "DELIVERED_OUTSIDE", "COMMITTED_UNFINISHED")


def refusals(progress: DataFrame, checkpoint: DataFrame, lineage: str) -> list[str]:
    """Why a stream must not start from ``(batchId, endOffsets, committed)``, the batches that a checkpoint holds.

    Besides the refused verdicts: batches that the journal has and a checkpoint that is behind it
    lacks (older ones Spark removes by itself), and more than one unfinished batch.  Ends are
    compared where the checkpoint tells them by partition, as Kafka's do.
    """
    mine = progress.where(F.col("lineage") == lineage).select("batchId", "outcome", F.col("deliveredOffsets").alias("told"))
    ends = F.to_json(F.transform(F.array_sort(F.map_entries("endOffsets")), lambda e: F.struct(e["key"].cast("int").alias("partition"), e["value"].alias("endOffsetExclusive"))))
    told = F.to_json(F.transform(F.array_sort(F.from_json("told", "array<struct<partition:int,endOffsetExclusive:bigint>>")), lambda e: e))
    spark_side = checkpoint.select("batchId", "committed", ends.alias("ends"))
    both = mine.select("batchId", "outcome", told.alias("endOffset"), F.lit(None).cast("string").alias("startOffset"))
    known = spark_side.join(both.select("batchId", F.col("endOffset").alias("own")), "batchId", "left")
    seen = known.select("batchId", F.coalesce("ends", "own", F.lit("unknown")).alias("endOffset"), "committed")
    verdicts = reconcile_checkpoint(both, seen)
    newest = checkpoint.agg(F.max("batchId").alias("b")).first()["b"]
    bad = verdicts.where(F.col("verdict").isin(*REFUSED) | ((F.col("verdict") == "JOURNAL_ONLY") & (F.col("batchId") > F.lit(-1 if newest is None else newest))))
    out = [f"batch {r['batchId']}: {r['verdict']}" for r in bad.orderBy("batchId").limit(20).collect()]
    open_ones = verdicts.where(~F.col("finished") & ~F.col("verdict").isin("JOURNAL_ONLY", "COMMITTED_WITHOUT_JOURNAL")).count()
    return out + ([f"{open_ones} unfinished batches"] if open_ones > 1 else [])
