"""Bounded and streaming event scans, offset checks and checkpoint logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = "topic STRING, partition INT, offset BIGINT, value BINARY, timestamp TIMESTAMP"
HEADERS = "ARRAY<STRUCT<key: STRING, value: BINARY>>"
RANGES = "topic STRING, partition INT, startOffset BIGINT, endOffsetExclusive BIGINT"


def validate_record_schema(df: DataFrame) -> None:
    """The record columns must be there with their types; headers may be."""
    want = {f.name: f.dataType for f in StructType.fromDDL(RECORD)}
    have = {f.name: f.dataType for f in df.schema}
    wrong = [n for n, t in want.items() if have.get(n) != t]
    headers = StructType.fromDDL(f"headers {HEADERS}")["headers"].dataType
    if "headers" in have and have["headers"].simpleString() != headers.simpleString():
        wrong.append("headers")
    if wrong:
        raise ValueError(f"record columns missing or of another type: {', '.join(wrong)}")


def kafka_range_options(ranges: list[tuple[str, int, int, int]], options: dict[str, str]) -> dict[str, str]:
    """Options of a bounded Kafka read of one topic's explicit offsets."""
    topics = {t for t, *_ in ranges}
    if len(topics) != 1:
        raise ValueError("a manifest covers one topic")
    if any(end <= start for _, _, start, end in ranges):
        raise ValueError("a range is empty")
    topic = topics.pop()
    by = lambda i: json.dumps({topic: {str(r[1]): r[i] for r in ranges}})
    return {**options, "assign": json.dumps({topic: sorted(r[1] for r in ranges)}), "startingOffsets": by(2), "endingOffsets": by(3), "failOnDataLoss": "true", "includeHeaders": "true"}


def read_offset_range(spark: SparkSession, ranges: list[tuple[str, int, int, int]], options: dict[str, str], source: str = "kafka") -> DataFrame:
    """Records of explicit offset ranges, from Kafka or from record-shaped Parquet at ``options['path']``."""
    kafka = kafka_range_options(ranges, {k: v for k, v in options.items() if k != "path"})
    if source == "kafka":
        return spark.read.format("kafka").options(**kafka).load()
    df = spark.read.parquet(options["path"])
    validate_record_schema(df)
    wanted = F.lit(False)
    for topic, partition, start, end in ranges:
        wanted = wanted | ((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= start) & (F.col("offset") < end))
    return df.where(wanted)


def kafka_stream_options(options: dict[str, str], max_per_trigger: int = 1000, starting: list[tuple[str, int, int]] | None = None) -> dict[str, str]:
    """Options of a Kafka stream: read committed, bounded triggers, and explicit starting offsets ``(topic, partition, offset)``.

    A stream with a checkpoint goes on from there; the offsets hold for its first start alone.
    """
    out = {"maxOffsetsPerTrigger": str(max_per_trigger), "kafka.isolation.level": "read_committed", "failOnDataLoss": "true", "includeHeaders": "true"} | options
    if starting is None:
        return out
    if not starting or any(offset < 0 for *_, offset in starting) or len({s[:2] for s in starting}) < len(starting):
        raise ValueError("starting offsets name each partition once, from 0 on")
    at: dict[str, dict[str, int]] = {}
    for topic, partition, offset in sorted(starting):
        at.setdefault(topic, {})[str(partition)] = offset
    return out | {"startingOffsets": json.dumps(at), "assign": json.dumps({topic: sorted(map(int, by)) for topic, by in at.items()})}


def read_event_stream(spark: SparkSession, options: dict[str, str], source: str = "kafka", max_per_trigger: int = 1000, starting: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """A record stream, from Kafka (see ``kafka_stream_options``) or from Parquet files; of files, records below a starting offset are left out."""
    if source == "kafka":
        return spark.readStream.format("kafka").options(**kafka_stream_options(options, max_per_trigger, starting)).load()
    rows = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", options.get("maxFilesPerTrigger", "1")).parquet(options["path"])
    if starting is None:
        return rows
    wanted = F.lit(False)
    for topic, partition, offset in starting:
        wanted = wanted | ((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= offset))
    return rows.where(wanted)


def offset_coverage(df: DataFrame, ranges: DataFrame, allow_gaps: bool = False) -> DataFrame:
    """Verdict by partition: its records against the manifest's range."""
    seen = df.groupBy("topic", "partition").agg(F.countDistinct("offset").alias("n"), F.min("offset").alias("low"), F.max("offset").alias("high"))
    both = ranges.join(seen, ["topic", "partition"], "full")
    whole = (F.col("low") == F.col("startOffset")) & (F.col("high") == F.col("endOffsetExclusive") - 1) & (F.col("n") == F.col("endOffsetExclusive") - F.col("startOffset"))
    inside = (F.col("low") >= F.col("startOffset")) & (F.col("high") < F.col("endOffsetExclusive"))
    verdict = (
        F.when(F.col("startOffset").isNull(), "UNEXPECTED_PARTITION")
        .when(F.col("n").isNull(), F.lit("COMPLETE" if allow_gaps else "MISSING_PARTITION"))
        .when(inside if allow_gaps else whole, "COMPLETE")
        .otherwise("OUT_OF_RANGE" if allow_gaps else "INCOMPLETE")
    )
    return both.select("topic", "partition", "startOffset", "endOffsetExclusive", F.coalesce("n", F.lit(0)).alias("records"), verdict.alias("verdict"))


def offset_availability(ranges: DataFrame, bounds: DataFrame) -> DataFrame:
    """Whether a requested range has expired, is not written yet, or can be read (``earliest``/``latest`` by partition)."""
    both = ranges.join(bounds, ["topic", "partition"], "left")
    verdict = F.when(F.col("earliest").isNull(), "UNKNOWN_PARTITION").when(F.col("startOffset") < F.col("earliest"), "EXPIRED").when(F.col("endOffsetExclusive") > F.col("latest"), "NOT_YET_AVAILABLE").otherwise("AVAILABLE")
    return both.select("topic", "partition", "startOffset", "endOffsetExclusive", verdict.alias("verdict"))


def read_checkpoint(spark: SparkSession, folder: str, topic: str) -> DataFrame:
    """Batches of a streaming checkpoint: end offsets by partition, commit flag, and whether ids are contiguous."""

    def log(name: str) -> DataFrame:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*").text(f"{folder}/{name}")
        return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)$", 1).alias("id"), "value").where("id <> ''").withColumn("batchId", F.col("id").cast("long"))

    offsets = log("offsets").where(F.col("value").startswith("{")).select("batchId", F.from_json("value", "map<string,map<string,bigint>>").alias("m"))
    ends = offsets.where(F.map_contains_key("m", topic)).select("batchId", F.element_at("m", topic).alias("endOffsets"))
    commits = log("commits").select("batchId").distinct().withColumn("committed", F.lit(True))
    every = log("offsets").select("batchId").distinct()
    before = F.lag("batchId").over(Window.orderBy("batchId"))
    return every.join(ends, "batchId", "left").join(commits, "batchId", "left").select("batchId", "endOffsets", F.coalesce("committed", F.lit(False)).alias("committed"), F.coalesce(F.col("batchId") == before + 1, F.lit(True)).alias("contiguous"))
