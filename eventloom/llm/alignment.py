"""Alignment of two tokenizers' tokens over one text, and how often their ids are linked.

The two lists of end offsets of a text are intersected by galloping: the shorter list's ends are
sought in the longer one by exponential, then binary search.  The common ends' ranks slice both
token lists into groups, and every pair of ids of a group is linked; of a long group only its
distinct pairs are kept, with their numbers, so repeated tokens are multiplied out by number and
not listed.  Texts are aligned in blocks of bounded size.  A longer one is cut where both
tokenizers surely end a token: before a space that follows a non-space (see
:mod:`eventloom.llm.chunks`; no piece of the second vocabulary holds a space behind another
character).

How many documents hold a pair is counted in Spark over every document.  Scores then go in two
tiers: the pairs of the greatest counts (``FREQUENT`` at most, a bound that the data don't
move) are broadcast, and the few links that they don't answer are joined to the counts by
shuffle, where no key is hot, since hot pairs are frequent ones.  Aligned documents are stored
in the shared folder between the two passes.

Null and empty texts, and those whose joined tokens differ from the text (the second vocabulary
writes U+2581 for a space, so a text that holds it can't be told back), have no tokens: zeros and
an empty digest, and no part in any count.  Repeated rows are a document each; an empty table gives
an empty result; a text without a space is aligned in one piece; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import _CUT, SPECIAL, PieceEncoder, _bytes_of_unit
from .common import doc_text, materialize, small_batches

#: Pairs that the broadcast tier holds at most.
FREQUENT = 1 << 18
#: Sixteen bins for each doubling of a pair's count.
BINS = 16
#: Text on which both byte-level libraries' character classes are known to agree (letters, digits, common signs, line ends).
_PLAIN_LINES = re.compile("[\t\n\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")
#: Characters that are aligned at a time.
BLOCK = 1 << 19
#: Pairs of a group that are listed one by one; of a group with more, distinct ones are numbered.
LISTED = 64
#: Every so manieth end is sought from the beginning of its stretch.
ANCHOR = 16
#: An id pair is one number: the first id, then the second in so many bits.
SHIFT = 20

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def galloped(short: np.ndarray, long: np.ndarray, low: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where the first number of ``long`` that is no less than each of ``short`` stands, from ``low`` on, before ``stop``.

    Steps double from ``low`` until they pass the number, then halve within the last one; all
    numbers go on side by side.  ``long`` ascends from each ``low`` to its ``stop``.
    """
    low, step = low.copy(), np.ones(len(short), np.int64)
    go = np.arange(len(short))
    while len(go):
        ahead = low[go] + step[go]
        go = go[ahead < stop[go]]
        go = go[long[low[go] + step[go]] < short[go]]
        low[go] += step[go]
        step[go] *= 2
    high = np.minimum(low + step, stop)
    go = np.arange(len(short))
    while len(go := go[low[go] < high[go]]):
        middle = (low[go] + high[go]) // 2
        less = long[middle] < short[go]
        low[go] = np.where(less, middle + 1, low[go])
        high[go] = np.where(less, high[go], middle)
    return low


def positions(short: np.ndarray, long: np.ndarray, low: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where each of ``short`` stands in ``long``, or -1.

    Every ``ANCHOR``-th number is sought from the beginning of its stretch, the others from where the
    one before them was, so that their steps stay few.
    """
    if not len(short) or not len(long):
        return np.full(len(short), -1, np.int64)
    anchor = np.arange(0, len(short), ANCHOR)
    near = np.repeat(galloped(short[anchor], long, low[anchor], stop[anchor]), ANCHOR)[: len(short)]
    at = galloped(short, long, np.maximum(low, np.minimum(near, stop)), stop)
    return np.where((at < stop) & (long[np.minimum(at, len(long) - 1)] == short), at, -1)


def common_ends(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and in ``b`` of the ends that both have, stretch by stretch.

    ``a_from`` and ``b_from`` are where each stretch begins in them, and their lengths.  In each
    stretch the side of fewer ends is sought in the other.
    """
    n_a, n_b = np.diff(a_from), np.diff(b_from)
    ranks = []
    for short, long, s_from, l_from, drives in ((a, b, a_from, b_from, n_a <= n_b), (b, a, b_from, a_from, n_a > n_b)):
        of = np.repeat(np.arange(len(n_a)), np.diff(s_from))
        mine = np.flatnonzero(drives[of])
        at = positions(short[mine], long, l_from[of[mine]], l_from[of[mine] + 1])
        ranks.append((mine[at >= 0], at[at >= 0]))
    (i, j), (y, x) = ranks
    order = np.argsort(np.concatenate([i, x]), kind="stable")
    return np.concatenate([i, x])[order], np.concatenate([j, y])[order]


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes put together, ascending, their times added."""
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(times, first) if len(first) else times


class Stretches:
    """The alignments of stretches whose tokens and ends stand one after another in ``a`` and ``b``.

    The ranks of common ends slice both lists into groups.  A group's pairs are listed, or, where
    they would be many, its distinct ids are paired with the products of their numbers.
    ``written`` holds each id followed by a comma, a bar and a semicolon.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, written: list[str]):
        i, j = common_ends(a_ends, b_ends, a_from, b_from)
        a0, b0 = (np.concatenate([[0], v + 1])[:-1] for v in (i, j))
        n_a, n_b = i + 1 - a0, j + 1 - b0
        n = n_a * n_b
        listed = np.where(n <= LISTED, n, 0)
        group = np.repeat(np.arange(len(n)), listed)
        k = np.arange(len(group)) - np.repeat(np.cumsum(listed) - listed, listed)
        codes = a[a0[group] + k // n_b[group]] << SHIFT | b[b0[group] + k % n_b[group]]
        signs = np.zeros(len(a) + len(b), np.int64)
        place_a, place_b = np.arange(len(a)) + np.repeat(b0, n_a), np.arange(len(b)) + np.repeat(a0 + n_a, n_b)
        signs[place_a], signs[place_b] = 3 * a, 3 * b
        signs[place_a[i]] += 1
        signs[place_b[j]] += 2
        texts, at = list(map(written.__getitem__, signs.tolist())), (a_from + b_from).tolist()
        self.texts = ["".join(texts[x:y])[:-1] for x, y in zip(at, at[1:])]
        m = len(a_from) - 1
        of = np.searchsorted(a_from, i, side="right") - 1
        links, pairs = np.zeros(m, np.int64), np.zeros(m, np.int64)
        np.add.at(links, of, n)
        np.add.at(pairs, of, listed)
        self.counts = np.stack([np.diff(a_from), np.diff(b_from), np.bincount(of, minlength=m), links], 1)
        self.codes = np.split(codes, np.cumsum(pairs)[:-1])
        self.times = [np.ones(len(c), np.int64) for c in self.codes]
        for g in np.flatnonzero(n > LISTED).tolist():
            x, y = (np.unique(v, return_counts=True) for v in (a[a0[g] : i[g] + 1], b[b0[g] : j[g] + 1]))
            self.codes[of[g]] = np.concatenate([self.codes[of[g]], (x[0][:, None] << SHIFT | y[0]).ravel()])
            self.times[of[g]] = np.concatenate([self.times[of[g]], np.outer(x[1], y[1]).ravel()])


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes put together, ascending, their times added."""
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(times, first) if len(first) else times


#: A stretch: its counts, pairs and times as the bytes of 64-bit numbers, and its groups as they are written.
Stretch = tuple[bytes, bytes, bytes, str]


def stretches(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, written: list[str]) -> list[Stretch]:
    """The alignments of stretches whose tokens and ends stand one after another in ``a`` and ``b``.

    The ranks of common ends slice both lists into groups.  A group's pairs are listed, or, where
    they would be many, its distinct ids are paired with the products of their numbers.
    ``written`` holds each id followed by a comma, a bar and a semicolon.
    """
    i, j = common_ends(a_ends, b_ends, a_from, b_from)
    a0, b0 = np.concatenate([[0], i[:-1] + 1]), np.concatenate([[0], j[:-1] + 1])
    n_a, n_b = i + 1 - a0, j + 1 - b0
    n = n_a * n_b
    listed = np.where(n <= LISTED, n, 0)
    group = np.repeat(np.arange(len(n)), listed)
    k = np.arange(len(group)) - np.repeat(np.cumsum(listed) - listed, listed)
    codes = a[a0[group] + k // n_b[group]] << SHIFT | b[b0[group] + k % n_b[group]]
    signs = np.zeros(len(a) + len(b), np.int64)
    place_a = np.arange(len(a)) + np.repeat(b0, n_a)
    place_b = np.arange(len(b)) + np.repeat(a0 + n_a, n_b)
    signs[place_a], signs[place_b] = 3 * a, 3 * b
    signs[place_a[i]] += 1
    signs[place_b[j]] += 2
    texts = list(map(written.__getitem__, signs.tolist()))
    of = np.searchsorted(a_from, i, side="right") - 1
    m = len(a_from) - 1
    groups, links = np.bincount(of, minlength=m), np.zeros(m, np.int64)
    np.add.at(links, of, n)
    counts = np.stack([np.diff(a_from), np.diff(b_from), groups, links], 1).astype(np.int64).tobytes()
    pairs = np.zeros(m, np.int64)
    np.add.at(pairs, of, listed)
    ends = np.concatenate([[0], np.cumsum(pairs)])
    raw, cut, at = codes.tobytes(), (8 * ends).tolist(), (a_from + b_from).tolist()
    out = [(counts[32 * s : 32 * s + 32], raw[cut[s] : cut[s + 1]], _ONE * ((cut[s + 1] - cut[s]) // 8), "".join(texts[at[s] : at[s + 1]])[:-1]) for s in range(m)]
    for g in np.flatnonzero(n > LISTED).tolist():
        x, y = (Counter(v.tolist()).items() for v in (a[a0[g] : i[g] + 1], b[b0[g] : j[g] + 1]))
        s = int(of[g])
        more, times = array("q", [p << SHIFT | q for p, _ in x for q, _ in y]).tobytes(), array("q", [u * v for _, u in x for _, v in y]).tobytes()
        out[s] = (out[s][0], out[s][1] + more, out[s][2] + times, out[s][3])
    return out


class Aligner:
    """Aligns texts under a byte-level vocabulary and a piece vocabulary with byte fallback."""

    def __init__(self, byte_level: str, piece_model: str):
        import sentencepiece

        self.a = PieceEncoder(byte_level)
        self.a.tok.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        unit = _bytes_of_unit()
        named = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for _, p in named):
            raise ValueError("a piece goes on behind a space: texts can't be cut before spaces")
        vocab = self.a.tok.get_vocab(with_added_tokens=False)
        a_bytes = {i: bytes(unit.get(c, 0) for c in t) for t, i in vocab.items()}
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in named}
        self.a_size, self.b_size = (np.array([len(held.get(i, b"")) for i in range(max(held) + 1)], np.int64) for held in (a_bytes, self.b_bytes))
        self.written = [f"{i}{sign}" for i in range(max(len(self.a_size), len(self.b_size))) for sign in ",|;"]
        self.space = [self.b.piece_to_id("▁")]

    def tokens(self, whole: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids of a stretch that begins with a space; None where a side's bytes aren't the stretch's."""
        raw = whole.encode("utf-8", "surrogatepass")
        if _PLAIN_LINES.fullmatch(whole):
            a = np.array(self.a.merge(whole), np.int64)
        else:
            parts = [self.a.library(whole)] if SPECIAL in whole else self.a.parts(whole)
            a = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
        b = self.b.encode(whole[1:], num_threads=1) if len(whole) > 1 else self.space
        # A byte-level vocabulary spells every byte, so its tokens could only be too few; pieces are compared.
        if self.a_size[a].sum() != len(raw) or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return a, np.array(b, np.int64)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """``(n_a, n_b, n_groups, n_links, digest, pairs, times)`` of whole texts, block by block."""
        found = [Found() if t else None for t in texts]
        for block in blocks(texts):
            held = []
            for k, whole in block:
                both = self.tokens(whole) if found[k].whole else None
                found[k].whole = both is not None
                held += [(k, *both)] if both else []
            if not held:
                continue
            which, *sides = zip(*held)
            a, b = (np.concatenate(side) for side in sides)
            done = Stretches(a, b, np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), *(np.cumsum([0, *map(len, side)]) for side in sides), self.written)
            for s, k in enumerate(which):
                found[k].add(done, s)
        return [f.result() if f else Found.NOTHING for f in found]


class Found:
    """What the stretches of one text add up to."""

    NOTHING = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))

    def __init__(self):
        self.whole, self.digest, self.counts = True, None, np.zeros(4, np.int64)
        self.pairs = self.times = np.empty(0, np.int64)

    def add(self, done: Stretches, s: int) -> None:
        self.counts = self.counts + done.counts[s]
        self.pairs, self.times = summed(np.concatenate([self.pairs, done.codes[s]]), np.concatenate([self.times, done.times[s]]))
        text = done.texts[s].encode()
        if self.digest:
            self.digest.update(b";" + text)
        else:
            self.digest = hashlib.sha256(text)

    def result(self) -> tuple:
        return (*self.counts.tolist(), self.digest.hexdigest(), self.pairs, self.times) if self.whole else self.NOTHING


def blocks(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Texts with a space in front, by number, ``BLOCK`` characters at a time; a longer one is cut before a space that follows a non-space."""
    block, size = [], 0
    for k, text in enumerate(texts):
        whole, at = " " + text if text else "", 0
        while at < len(whole):
            cut = _CUT.search(whole, at + BLOCK) if len(whole) - at > BLOCK else None
            stop = cut.start() if cut else len(whole)
            block.append((k, whole[at:stop]))
            size, at = size + stop - at, stop
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def _kept(cache: dict[str, Stretch | None], made: dict[str, Stretch | None], most: int) -> dict[str, Stretch | None]:
    """The cache with new stretches that are short, begun anew where it is full."""
    if len(cache) + len(made) > most:
        cache = {}
    cache.update((w, s) for w, s in made.items() if len(w) <= LONGEST_KEPT)
    return cache


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*values, np.empty(0, np.int64)]), pa.int64()))


def _batch(columns: list[pa.Array], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])


def aligned(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """Every document's counts and distinct linked pairs; ``row`` numbers the rows as they were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level, piece_model)
        for batch in batches:
            out = aligner.align(batch.column(2).to_pylist())
            *counts, digest, pairs, times = list(zip(*out)) or [()] * 7
            yield _batch([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), _lists(list(pairs)), _lists(list(times))], ALIGNED)

    small_batches(docs.sparkSession)
    rows = doc_text(docs)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, n, best)``: documents that hold a pair, and whether no pair of its first id is held by more.

    There are at most as many best counts as ids in the first vocabulary.
    """
    counts = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    first = F.shiftright("pair", SHIFT).alias("a")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", SHIFT)).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_pairs(counts: DataFrame, most: int = FREQUENT) -> tuple[int, DataFrame]:
    """The least bin of counts that is frequent, and its pairs and those above: ``most`` at most, whatever the table."""
    step = F.floor(F.log2("n") * BINS).cast("int")
    least, total = 64 * BINS, 0
    for r in counts.groupBy(step.alias("bin")).agg(F.count("*").alias("pairs")).orderBy(F.desc("bin")).collect():
        total += r["pairs"]
        if total > most:
            break
        least = r["bin"]
    return least, counts.where(step >= least)


SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>, rest_times array<long>"


def scored_by_frequent(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """Sums over the links that the frequent pairs answer; the links left over are handed on."""
    table = frequent.orderBy("pair").toArrow()
    held = rows.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = held.value
        for batch in batches:
            pairs, times = batch.column(7), batch.column(8)
            flat, by = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(codes, flat), max(len(codes) - 1, 0))
            hit = codes[at] == flat if len(codes) else np.zeros(len(flat), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], doc[hit], by[hit] * best[at[hit]])
            np.add.at(sums[1], doc[hit], by[hit] * n[at[hit]])
            left = np.cumsum([0, *np.bincount(doc[~hit], minlength=batch.num_rows)])
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~hit], pa.int64())) for x in (flat, by)]
            yield _batch([*batch.columns[:7], *[pa.array(s, pa.int64()) for s in sums], *rest], SCORED)

    return rows.mapInArrow(run, SCORED)


def align_tokens(docs: DataFrame, byte_level: str, piece_model: str, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: tokens of both sides, groups, links and their corpus-wide counts."""
    rows = materialize(aligned(docs, byte_level, piece_model))
    counts = pair_counts(rows)
    least, known = frequent_pairs(counts, frequent)
    scored = scored_by_frequent(rows, known)
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r")).select("row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
    rare = counts.where(F.floor(F.log2("n") * BINS).cast("int") < least)
    more = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = scored.drop("rest", "rest_times").join(more, "row", "left")
    add = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0).cast("long"))).alias(c)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "more_best"), add("count_sum", "more_sum"), "groups_sha256")
