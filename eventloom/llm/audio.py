"""Chroma audio fingerprints for a column of recordings, and their alignment.

A recording's spectrum is folded onto twelve pitch classes per frame; on the integral image of
those frames sixteen rectangle filters are evaluated at every step and quantised to two
(Gray-coded) bits each: one packed 32-bit integer per frame.  Two recordings align where many
equal keys (the integers' upper bits) fall on one offset; the bit error of the overlap at that
offset decides.

Searches run a stated query set against all recordings in blocks: fingerprints travel as
packed blocks of at most ``BLOCK_RECORDINGS``, block pairs are spread over tasks by salted
equi-joins, and nothing is gathered on the driver.  Recordings with one fingerprint sequence
are one class, which is searched once.

Recordings that are null or shorter than a filter have no fingerprint: they are a class of
their own and match nothing.  Odd trailing bytes are ignored.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

SAMPLE_RATE = 2000
FRAME, HOP = 512, 128
LOWEST, HIGHEST = 100.0, 950.0
SPAN = 16
KEY_BITS = 16
MIN_VOTES, MIN_OVERLAP, MAX_ERROR = 6, 24, 0.2
BLOCK_RECORDINGS = 2048
#: Expanded key matches that a task holds at a time.
PAIRS_AT_A_TIME = 2_000_000
#: Thresholds of a filter's log ratio.
LEVELS = np.array([-0.25, 0.0, 0.25])


def _filters() -> list[tuple[int, int, int, int]]:
    """``(kind, first class, classes, frames)`` of the sixteen filters, by rule."""
    return [(k % 4, (5 * k) % 9, 2 + 2 * (k // 4 % 2), (4, 8, 12, 16)[k // 4]) for k in range(16)]


FILTERS = _filters()


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy by pitch class and frame, each frame scaled to one."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.arange(power.shape[1]) * SAMPLE_RATE / FRAME
    used = (hz >= LOWEST) & (hz <= HIGHEST)
    fold = np.zeros((len(hz), 12))
    fold[np.flatnonzero(used), np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12] = 1
    out = power @ fold
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-9)


def fingerprint(pcm: bytes | None) -> np.ndarray:
    """Packed 32-bit integers of 16-bit little-endian samples."""
    samples = np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype(np.float32) if pcm else np.empty(0, np.float32)
    if len(samples) < FRAME + (SPAN - 1) * HOP:
        return np.empty(0, np.uint32)
    image = chroma(samples)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    n = len(image) - SPAN + 1
    t = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return whole[t + t1, c1] - whole[t + t0, c1] - whole[t + t1, c0] + whole[t + t0, c0]

    packed = np.zeros(n, np.uint32)
    for kind, c, h, w in FILTERS:
        c1, half_c, half_w = min(12, c + h), c + max(1, (min(12, c + h) - c) // 2), w // 2
        if kind == 0:
            a, b = area(0, w, c, half_c), area(0, w, half_c, c1)
        elif kind == 1:
            a, b = area(0, half_w, c, c1), area(half_w, w, c, c1)
        elif kind == 2:
            a, b = area(0, half_w, c, half_c) + area(half_w, w, half_c, c1), area(half_w, w, c, half_c) + area(0, half_w, half_c, c1)
        else:
            a, b = area(0, w, c, c1), area(0, w, 0, 12) * ((c1 - c) / 12)
        level = np.searchsorted(LEVELS, np.log((0.1 + a) / (0.1 + b))).astype(np.uint32)
        packed = packed << np.uint32(2) | (level ^ level >> np.uint32(1))
    return packed


def fingerprints(recordings: DataFrame) -> DataFrame:
    """``(rec_id, prints, digest)`` from ``(rec_id, pcm)``; the prints are packed little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [fingerprint(x).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
            digest = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(digest, pa.binary())], ["rec_id", "prints", "digest"])

    small_batches(recordings.sparkSession)
    return recordings.select("rec_id", "pcm").mapInArrow(run, "rec_id long, prints binary, digest binary")


BLOCKS = "ids binary, sizes binary, prints binary"


def blocks(prints: DataFrame) -> DataFrame:
    """Rows ``(rec_id, prints)`` packed by the task that holds them, ``BLOCK_RECORDINGS`` to a block."""

    def pack(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids, raw = np.array([i for i, _ in held], "<i8"), [x for _, x in held]
        sizes = np.array([len(x) // 4 for x in raw], "<i8")
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids.tobytes(), sizes.tobytes(), b"".join(raw))], ["ids", "sizes", "prints"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            while len(held) >= BLOCK_RECORDINGS:
                yield pack(held[:BLOCK_RECORDINGS])
                held = held[BLOCK_RECORDINGS:]
        if held:
            yield pack(held)

    small_batches(prints.sparkSession)
    return prints.select("rec_id", "prints").mapInArrow(run, BLOCKS)


def _unpacked(ids: bytes, sizes: bytes, prints: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(sizes, "<i8")
    return np.frombuffer(ids, "<i8"), np.concatenate([[0], np.cumsum(n)]), np.frombuffer(prints, "<u4")


def align(queries: tuple, items: tuple) -> list[tuple[int, int, int, int, float, int]]:
    """``(query, match, offset, votes, bit_error, overlap)`` of two unpacked blocks, best offset per pair."""
    (q_ids, q_at, q), (r_ids, r_at, r) = queries, items
    key = lambda x: x >> np.uint32(32 - KEY_BITS)
    order = np.argsort(key(q), kind="stable")
    q_key, q_of = key(q)[order], np.repeat(np.arange(len(q_ids)), np.diff(q_at))[order]
    q_pos = (np.arange(len(q)) - np.repeat(q_at[:-1], np.diff(q_at)))[order]
    r_of, r_pos = np.repeat(np.arange(len(r_ids)), np.diff(r_at)), np.arange(len(r)) - np.repeat(r_at[:-1], np.diff(r_at))
    low, high = np.searchsorted(q_key, key(r), "left"), np.searchsorted(q_key, key(r), "right")
    n = high - low
    done, out = np.cumsum(n), []
    wide = np.int64(2 * (max(np.diff(q_at).max(initial=0), np.diff(r_at).max(initial=0)) + 1))
    start = 0
    while start < len(r):
        # whole recordings at a time, as many as fit
        stop = np.searchsorted(done, (done[start - 1] if start else 0) + PAIRS_AT_A_TIME, "right")
        stop = min(len(r), int(r_at[np.searchsorted(r_at, max(stop, start + 1), "left")]))
        span = slice(start, stop)
        which = np.repeat(np.arange(start, stop), n[span])
        hit = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n[span]) - n[span], n[span])
        cell = (q_of[hit].astype(np.int64) * len(r_ids) + r_of[which]) * wide + (r_pos[which] - q_pos[hit] + wide // 2)
        cells, votes = np.unique(cell, return_counts=True)
        some = votes >= MIN_VOTES
        best: dict[int, tuple[int, int]] = {}
        for c, v in sorted(zip(cells[some].tolist(), votes[some].tolist()), key=lambda x: (-x[1], x[0])):
            best.setdefault(c // int(wide), (c % int(wide) - int(wide) // 2, v))
        for pair, (offset, v) in best.items():
            i, j = divmod(pair, len(r_ids))
            if q_ids[i] == r_ids[j]:
                continue
            a, b = q[q_at[i] : q_at[i + 1]], r[r_at[j] : r_at[j + 1]]
            a, b = (a, b[offset:]) if offset >= 0 else (a[-offset:], b)
            m = min(len(a), len(b))
            error = float(np.bitwise_count(a[:m] ^ b[:m]).sum()) / (32 * m) if m else 1.0
            if m >= MIN_OVERLAP and error <= MAX_ERROR:
                out.append((int(q_ids[i]), int(r_ids[j]), offset, v, error, m))
        start = stop
    return out


LINKS = "query_id long, match_id long, offset_frames int, votes int, bit_error double, overlap int"


def search(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Alignments of the query recordings with all others, both as ``(rec_id, prints)``.

    Every query block meets every item block in one cell of a grid of hashed slots, of which
    the driver knows the counts alone.
    """
    q = materialize(blocks(queries).withColumn("block", F.monotonically_increasing_id()))
    r = materialize(blocks(items).withColumn("salt", F.monotonically_increasing_id()))
    packed = ("ids", "sizes", "prints")

    def slots(df: DataFrame) -> int:
        return max(1, df.count())

    def slot(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n)).alias(name)

    def all_slots(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)

    n_q, n_r = slots(q), slots(r)
    left = r.select(slot("salt", n_r), all_slots("block", n_q), *[F.col(c).alias(f"r_{c}") for c in packed])
    right = q.select(slot("block", n_q), all_slots("salt", n_r), *packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
        for batch in batches:
            for x in batch.to_pylist():
                found = align(_unpacked(x["ids"], x["sizes"], x["prints"]), _unpacked(x["r_ids"], x["r_sizes"], x["r_prints"]))
                columns = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in LINKS.split(", ")])

    small_batches(q.sparkSession)
    pairs = left.join(right, ["salt", "block"]).select("ids", "sizes", "prints", "r_ids", "r_sizes", "r_prints")
    return pairs.mapInArrow(run, LINKS)


def find_recordings(recordings: DataFrame, is_query: Column) -> DataFrame:
    """One row per recording with its class, and one per alignment of each class that holds a query.

    ``is_query`` is a condition on ``rec_id``.  Copies share their class's alignments, which
    stand on the row of the class's least query.
    """
    rows = materialize(fingerprints(recordings))
    mine = F.coalesce(F.col("digest"), F.concat(F.lit("alone"), F.col("rec_id").cast("string")).cast("binary"))
    rows = rows.withColumn("class_key", mine)
    least_query = F.min(F.when(is_query, F.col("rec_id")))
    classes = materialize(rows.groupBy("class_key").agg(F.min("rec_id").alias("class_id"), least_query.alias("query_rec"), F.first("prints").alias("prints")))
    whole = classes.where(F.length("prints") > 0).select(F.col("class_id").alias("rec_id"), "prints", "query_rec")
    links = search(whole.where("query_rec is not null"), whole)
    members = rows.select("rec_id", "class_key").join(classes.drop("prints"), "class_key")
    found = links.withColumnRenamed("query_id", "of_class")
    is_rep = (F.col("rec_id") == F.col("query_rec")) & (F.col("class_id") == F.col("of_class"))
    return members.join(found, (F.col("class_id") == F.col("of_class")) & is_rep, "left").select("rec_id", "class_id", is_query.alias("is_query"), "match_id", "offset_frames", "votes", "bit_error", "overlap")


def rendered(vectors: DataFrame) -> DataFrame:
    """``(rec_id, pcm)``: each vector played as a melody, one note per component.

    The tables hold no media, so recordings are derived from the ``embeddings`` rows: near
    vectors give near recordings.
    """
    note = 2 * HOP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                v = np.array([c for c in x or [] if c is not None], float)
                pitch = np.clip(12 + 3 * v / (v.std() + 1e-9), 0, 24) if len(v) else v
                phase = np.cumsum(np.repeat(110.0 * 2 ** (pitch / 12), note)) * (2 * np.pi / SAMPLE_RATE)
                out.append((9000 * (np.sin(phase) + 0.4 * np.sin(2 * phase))).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rec_id", "pcm"])

    small_batches(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long").alias("rec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, "rec_id long, pcm binary")
