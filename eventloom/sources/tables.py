"""Declared tables as plain Parquet, in folders by day or by bucket of a key: reads, merges, retention, compaction.

Insert-only merges append files.  Everything else replaces whole folders, those that it touches
and no others, by Spark's dynamic partition overwrite.  What will replace them is written beside
the table first; a replacement that broke off half-way is done again before the next read or
write, so a lost driver leaves no folder empty.  Merge functions are pure: they give rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.joins import met
from ..specs import TableSpec

#: The column that names a row's folder.
PART = "part"


def shape(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def matches(schema: StructType, spec: TableSpec) -> bool:
    """Names and types in order."""
    return shape(schema) == shape(spec.schema)


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The declared columns, in order and of the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema])


def check_rows(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows that break NOT NULL or a CHECK, with the names of what they break."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in _rules(spec)]))
    return df.withColumn("violations", broken).where(F.size("violations") > 0)


def _rules(spec: TableSpec) -> list[tuple[str, Column]]:
    rules = [(f"{f.name} IS NOT NULL", F.col(f.name).isNotNull()) for f in spec.schema if not f.nullable]
    return rules + [(c, F.coalesce(F.expr(c), F.lit(True))) for c in spec.checks]


def checked(df: DataFrame, spec: TableSpec) -> int:
    """The number of rows; refuses any that break NOT NULL or a CHECK. One pass."""
    good = F.lit(True)
    for _, ok in _rules(spec):
        good = good & ok
    seen = df.agg(F.count("*").alias("rows"), F.count(F.when(~good, 1)).alias("broken")).first()
    if seen["broken"]:
        raise ValueError(f"{spec.name}: rows break the declared checks")
    return seen["rows"]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete files that nothing reads any more."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _placed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows with their folder; a folder's rows go to few tasks, and those of a large one to several."""
    if not spec.part:
        return df
    return df.withColumn(PART, F.expr(spec.part[0]).cast(spec.part[1])).hint("rebalance", PART)


def _scan(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    schema = spec.schema if not spec.part else StructType.fromDDL(f"{spec.ddl}, {PART} {spec.part[1]}")
    return spark.read.schema(schema).parquet(path)


def _write(df: DataFrame, path: str, spec: TableSpec, mode: str, **options: str) -> None:
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(PART) if spec.part else writer).parquet(path)


def read_or_empty(spark: SparkSession, path: str, spec: TableSpec, parts: list | None = None) -> DataFrame:
    """The table, or an empty frame of its schema; ``parts`` reads the named folders alone."""
    repair(spark, path, spec)
    if not exists(spark, path):
        return spark.createDataFrame([], spec.schema)
    df = _scan(spark, path, spec)
    if parts is not None and spec.part:
        df = df.where(F.col(PART).isin(parts) if parts else F.lit(False))
    return df.select(*spec.schema.fieldNames())


def parts_of(df: DataFrame, spec: TableSpec) -> list:
    """The folders that rows lie in: at most as many as there are days or buckets."""
    return sorted(r[0] for r in df.select(F.expr(spec.part[0]).cast(spec.part[1]).alias(PART)).distinct().collect())


def staged(path: str) -> str:
    """Where what will replace a table's folders is written first."""
    return f"{path.rstrip('/')}__staged"


def _stage(df: DataFrame, path: str, spec: TableSpec, parts: list | None) -> None:
    spark, at = df.sparkSession, staged(path)
    if not matches(df.schema, spec):
        raise ValueError(f"{spec.name}: the frame's shape differs from the declared one")
    repair(spark, path, spec)
    remove(spark, at)
    _write(_placed(df, spec), f"{at}/rows", spec, "overwrite")
    try:
        checked(_scan(spark, f"{at}/rows", spec), spec)
    except ValueError:
        remove(spark, at)
        raise
    fs, writing = _fs(spark, f"{at}/parts-unfinished")
    out = fs.create(writing)
    out.write(bytearray(json.dumps(None if parts is None else [str(x) for x in parts]).encode()))
    out.close()
    fs.rename(writing, _fs(spark, f"{at}/parts")[1])


def repair(spark: SparkSession, path: str, spec: TableSpec) -> None:
    """Finish a replacement that was staged whole but broke off; doing it twice changes nothing."""
    at = f"{staged(path)}/parts"
    if exists(spark, at):
        _apply(spark, path, spec, json.loads(spark.read.text(at).first()[0]))


def _apply(spark: SparkSession, path: str, spec: TableSpec, parts: list | None) -> None:
    """Replace folders by what is staged for them."""
    rows = _scan(spark, f"{staged(path)}/rows", spec)
    if parts is None or not spec.part:
        _write(rows, path, spec, "overwrite", partitionOverwriteMode="static")
    else:
        _write(rows, path, spec, "overwrite", partitionOverwriteMode="dynamic")
        left = {str(r[0]) for r in rows.select(PART).distinct().collect()}
        for part in {str(p) for p in parts} - left:
            remove(spark, f"{path}/{PART}={part}")
    remove(spark, staged(path))


def write_table(df: DataFrame, path: str, spec: TableSpec) -> None:
    """Replace the whole table; refuses another shape and rows that break the declared checks."""
    _stage(df, path, spec, None)
    _apply(df.sparkSession, path, spec, None)


overwrite_table = write_table


def replace_parts(df: DataFrame, path: str, spec: TableSpec, parts: list) -> None:
    """Replace the folders ``parts`` by ``df``, whose rows lie in them; the others' files stay. A folder without rows goes."""
    if parts:
        _stage(df, path, spec, parts)
        _apply(df.sparkSession, path, spec, parts)


def append_rows(df: DataFrame, path: str, spec: TableSpec) -> int:
    """Add files; the new rows alone are checked, and stored files stay as they are. Gives the number of rows added.

    A writer that is run again after a crash must give the rows that are still missing (see ``new_rows``).
    """
    spark = df.sparkSession
    if not matches(df.schema, spec):
        raise ValueError(f"{spec.name}: the frame's shape differs from the declared one")
    repair(spark, path, spec)
    held = df.persist()
    try:
        if n := checked(held, spec):
            _write(_placed(held, spec), path, spec, "append")
        return n
    finally:
        held.unpersist()


def ensure_table(spark: SparkSession, path: str, spec: TableSpec) -> None:
    """Create an empty table, or verify that the stored one has the declared shape."""
    repair(spark, path, spec)
    if not exists(spark, path):
        write_table(spark.createDataFrame([], spec.schema), path, spec)
        return
    stored = [c for c in shape(spark.read.parquet(path).schema) if c[0] != PART] if _has_files(spark, path) else shape(spec.schema)
    if stored != shape(spec.schema):
        raise ValueError(f"{spec.name}: the stored shape differs from the declared one")


def _has_files(spark: SparkSession, path: str) -> bool:
    return bool(spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).inputFiles())


def merge_insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus ``new_rows``; a second run changes nothing."""
    return target.unionByName(new_rows(target, source, keys))


def new_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The source rows whose key the target lacks, one per key: the first by its content, whatever the partitioning.

    Only the target rows that the source's keys meet take part in the anti-join.
    """
    row = F.struct(*target.columns)
    one = source.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return one.join(met(bound_target(target, source, keys), source, keys).select(*keys), keys, "left_anti").select(*target.columns)


def bound_target(target: DataFrame, source: DataFrame, keys: list[str], most: int = 256) -> DataFrame:
    """The target rows that a merge can meet: per-partition offset bounds become a pushed-down filter."""
    if not {"topic", "partition", "offset"} <= set(keys):
        return target
    bounds = source.groupBy("topic", "partition").agg(F.min("offset").alias("low"), F.max("offset").alias("high")).limit(most + 1).collect()
    if len(bounds) > most:
        return target
    keep = F.lit(False)
    for b in bounds:
        keep = keep | ((F.col("topic") == b["topic"]) & (F.col("partition") == b["partition"]) & F.col("offset").between(b["low"], b["high"]))
    return target.where(keep)


def freshness(source: DataFrame, now: datetime) -> DataFrame:
    """Rows, and rows that are expired or have no expiry, at ``now``."""
    stale = F.col("expiresAt").isNull() | (F.col("expiresAt") <= F.lit(now))
    return source.agg(F.count("*").alias("rows"), F.count(F.when(stale, 1)).alias("stale"))


def merge_when_fresh(target: DataFrame, source: DataFrame, keys: list[str], now: datetime | Callable[[], datetime]) -> DataFrame:
    """Insert-only merge that is refused whole if any source row has expired; a clock is read when the merge is asked for."""
    if freshness(source, now() if callable(now) else now).first()["stale"]:
        raise ValueError("a source row has expired")
    return merge_insert_only(target, source, keys)


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows of their key."""
    return target.join(source.select(*keys), keys, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def upsert_parts(source: DataFrame, path: str, spec: TableSpec, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list:
    """Merge ``source`` into the folders it touches; gives those that were replaced.

    ``merge(held, source)`` gives the folders' new rows with a ``changed`` flag; a folder without a changed row stays as it is.
    """
    spark = source.sparkSession
    touched = parts_of(source, spec)
    merged = merge(read_or_empty(spark, path, spec, touched), source).persist()
    try:
        changed = parts_of(merged.where("changed"), spec)
        rows = conform(merged.where(F.expr(spec.part[0]).isin(changed)) if changed else merged.limit(0), spec)
        replace_parts(rows, path, spec, changed)
        return changed
    finally:
        merged.unpersist()


def delete_where(spark: SparkSession, path: str, spec: TableSpec, hit: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> list:
    """Replace the folders that the rows of ``hit`` lie in by what ``keep`` leaves of them; gives those folders."""
    touched = parts_of(hit, spec)
    if touched:
        replace_parts(conform(keep(read_or_empty(spark, path, spec, touched)), spec), path, spec, touched)
    return touched


def expire(df: DataFrame, at: datetime) -> DataFrame:
    """The table without rows that expire at or before ``at``; rows without an expiry stay."""
    return df.where(F.col("expiresAt").isNull() | (F.col("expiresAt") > F.lit(at)))


def compact(spark: SparkSession, path: str, spec: TableSpec, target_files: int, now: datetime | None = None, last: datetime | None = None, every: timedelta = timedelta(0)) -> list:
    """Rewrite folders of more than ``target_files`` files, once ``every`` has passed since ``last``; gives those folders."""
    if (now and last and now - last < every) or not exists(spark, path):
        return []
    names = [f.rsplit("/", 2)[-2] for f in _scan(spark, path, spec).inputFiles()]
    many = sorted(folder for folder, n in Counter(names).items() if n > target_files)
    if not spec.part:
        if many:
            write_table(read_or_empty(spark, path, spec).coalesce(target_files), path, spec)
        return many
    values = [folder.split("=", 1)[1] for folder in many]
    if values:
        rows = _scan(spark, path, spec).where(F.col(PART).cast("string").isin(values)).select(*spec.schema.fieldNames())
        replace_parts(rows, path, spec, values)
    return values


def reclaim(spark: SparkSession, path: str, now: datetime, hours: int = 168, dry_run: bool = True) -> list[str]:
    """Leftovers beside a table, older than ``hours``, of writes that broke off before all was staged: listed, and removed if not a dry run."""
    fs, at = _fs(spark, staged(path))
    if not fs.exists(at) or exists(spark, f"{staged(path)}/parts"):
        return []
    if fs.getFileStatus(at).getModificationTime() / 1000 > (now - timedelta(hours=hours)).timestamp():
        return []
    if not dry_run:
        fs.delete(at, True)
    return [at.getName()]


def exists_any(df: DataFrame) -> bool:
    return not df.isEmpty()


def bounded(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows and one more, which proves an overflow."""
    return df.limit(n + 1)
