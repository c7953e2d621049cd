"""Joins of a small batch with a large stored side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: Keys that are broadcast at most: a few tens of megabytes.
MOST_KEYS = 1_000_000


def met(stored: DataFrame, batch: DataFrame, keys: list[str], most: int = MOST_KEYS) -> DataFrame:
    """The stored rows whose key the batch has.

    The batch's rows are counted, up to ``most``; within that their distinct keys are broadcast, so
    the stored side is filtered where it is read and never shuffled.  More are joined by shuffle.
    Null keys meet nothing.
    """
    asked = batch.select(*keys)
    small = asked.limit(most + 1).count() <= most
    asked = asked.distinct()
    return stored.join(F.broadcast(asked) if small else asked, keys, "left_semi")


def with_previous(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the ``value`` of the row before it in the order of ``order``, which is unique.

    No task sees all rows: sorted ranges are stored, each looks back within itself, and the first
    row of a range takes the last value of the range before, of which there is one row a range.
    """
    at, part = f"__{name}_at", f"__{name}_part"
    path = shared_path(df.sparkSession)
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn(at, F.monotonically_increasing_id())
    ranged.write.parquet(path)
    stored = df.sparkSession.read.schema(ranged.schema).parquet(path).withColumn(part, F.shiftright(at, 33))
    ends = stored.groupBy(part).agg(F.max_by(F.struct(value), at).alias("last"))
    before = ends.select(part, F.lag("last").over(Window.orderBy(part))[value].alias("edge"))
    within = Window.partitionBy(part).orderBy(at)
    both = stored.withColumn("__n", F.row_number().over(within)).withColumn(name, F.lag(value).over(within)).join(before, part)
    return both.withColumn(name, F.when(F.col("__n") == 1, F.col("edge")).otherwise(F.col(name))).select(*df.columns, name)
