"""Best-fit packing by minimum bin slack.

Documents become token ids and an end id; longer ones than a sequence are cut into full
pieces after a shorter first one.  What has to be packed is then only how many pieces there
are of each length, a histogram of at most ``capacity`` rows whatever the corpus size.  On
it the driver repeats: find by bitset subset-sum over the lengths that are left the fullest
feasible combination that holds the longest one, and remove it as often as the counts allow.
The plan (lengths, repetitions, offsets) is bounded too and goes to the tasks as a small
array; every piece finds its place from its rank among pieces of its length, which Spark
computes from per-partition counts, so no length is gathered in one task.

Nulls pack as empty text (one end token); repeated rows are packed each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import PieceEncoder
from .common import doc_text, materialize, small_batches

CAPACITY = 1024
END_ID = 2
PIECES = "part int, row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document with their place in it and the crc32 of their ids.

    ``(part, row)`` names a piece within this result.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, row = PieceEncoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                start, stop = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    out.append((part, row, doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, row = stop, stop + capacity, row + 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    small_batches(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, PIECES)


def fullest(lengths: list[int], left: np.ndarray, room: int) -> list[int]:
    """Lengths, longest first, whose sum comes nearest to ``room`` from below.

    Subset sums are kept as bits of one integer per distinct length; a length is offered as
    often as it is left, in doubling bundles, and the choice is read back from the top sum.
    """
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for size in lengths:
        if size > room:
            continue
        times, bundle = min(int(left[size]), room // size), 1
        while times > 0:
            take = min(bundle, times)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & full
            times, bundle = times - take, bundle * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            chosen += [size] * take
            at -= size * take
    return sorted(chosen, reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``(times, lengths)`` of the bins that hold every piece of ``histogram``."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    plan = []
    while (there := np.flatnonzero(left)[::-1]).size:
        first = int(there[0])
        left[first] -= 1
        bin_ = [first, *fullest([int(x) for x in there if left[x]], left, capacity - first)]
        left[first] += 1
        sizes, need = np.unique(bin_, return_counts=True)
        times = int((left[sizes] // need).min())
        left[sizes] -= times * need
        plan.append((times, bin_))
    return plan


def slots(plan: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """Per length: ranks from ``first`` on go to bins from ``bin`` on, ``per`` in each, from ``offset``."""
    out, used, bins = [], {}, 0
    for times, sizes in plan:
        offset = 0
        for size in dict.fromkeys(sizes):
            per = sizes.count(size)
            out.append((size, used.get(size, 0), bins, per, offset))
            used[size] = used.get(size, 0) + times * per
            offset += size * per
        bins += times
    return pd.DataFrame(out, columns=["length", "first", "bin", "per", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of ``(part, row, length, ...)``."""
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    per_part = materialize(per_part)
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(minimum_bin_slack(histogram, capacity))
    spark = pieces.sparkSession
    by_length = spark.sparkContext.broadcast({int(k): tuple(g[c].to_numpy() for c in ("first", "bin", "per", "offset")) for k, g in table.groupby("length")})
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_part.select(F.col("part").alias("s_part"), F.col("length").alias("s_length"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part", "length").orderBy("row")) - 1
    ranked = pieces.withColumn("within", within).join(starts, (F.col("part") == F.col("s_part")) & (F.col("length") == F.col("s_length")))
    ranked = ranked.withColumn("rank", F.col("within") + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        size, r = length.to_numpy(), rank.to_numpy()
        for k in np.unique(size):
            first, bin_, per, at = by_length.value[int(k)]
            mine = size == k
            j = np.searchsorted(first, r[mine], side="right") - 1
            d = r[mine] - first[j]
            sequence[mine] = bin_[j] + d // per[j]
            offset[mine] = at[j] + d % per[j] * k
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    kept = [c for c in pieces.columns if c not in ("part", "row")]
    return ranked.withColumn("place", place("length", "rank")).select(*kept, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens; one row per piece."""
    return pack(materialize(cut_documents(docs, tokenizer_path, capacity, end_id)), capacity)
