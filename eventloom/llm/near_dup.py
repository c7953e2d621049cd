"""Near-duplicate documents by MinHash, exact confirmation and star components.

1. Every whole text becomes the set of its five-word shingles (64-bit hashes), a fingerprint
   of that set, many universal-hash minima and, from them, band keys.
2. Rows with one fingerprint are one class; only classes go on, so copies cost one row each.
3. In each band bucket every class is tied to the bucket's two centres, its least and its
   greatest class, so one odd centre does not keep a family apart; the ties are screened by
   signature and confirmed on the full sets; components join what is confirmed.
4. Whatever links remain are found exactly, without pairing buckets.  Two members of a bucket
   differ by the symmetric difference of their differences from its least class.  If they are
   linked but not through that one, those differences must overlap, by a number that
   follows from their sizes.  Differences are short, and what is a document's own stands first
   in them (rarest first, by exact counts), so a join of their beginnings with a position filter
   leaves few pairs.  Only pairs across components are made, and all of them are confirmed.

The threshold is an argument, in hundredths; bands, screen, beginnings and position filters
follow from it.  A pair at the threshold shares a bucket with probability over 1 - 1e-9
(``ROWS`` = 5; 36 bands for 85, 53 for 80), and passes the screen as surely; confirmation is exact.

Null and blank texts have no shingles: they link with nothing.  A text of fewer than five
words is one shingle, the whole sequence.  Rows repeated or with one id twice are handled by
their sets; a row without an id is kept; extra columns are ignored; an empty table gives an
empty result.  A very long text costs memory in proportion to its own length alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType

from .common import Scratch, WordHashes, bounded_broadcast, doc_text, gram_hashes, mix64, small_batches
from .components import components

ROWS = 5
#: Probability that a pair at the threshold shares no bucket, at most.
MISSED = 1e-9
#: Deviations below the threshold at which the screen stands.
DEVIATIONS = 5.6
#: Ids that a broadcast semi-join may hold (8 bytes each); beyond it a shuffle join runs.
BROADCAST_IDS = 1_000_000
SHINGLE = 5

FEATURES = "doc_id long, text_key long, n_shingles long, fp binary, bands array<long>, sig binary"
#: The default threshold (exact, in hundredths); sizes of two linked sets differ by this factor at most.
PERCENT = 85


def bands_for(percent: int) -> int:
    """Bands that a pair at the threshold needs to share a bucket."""
    return math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))


def screen_for(percent: int) -> int:
    """Minima that must agree, of all, for a pair to be confirmed."""
    n, p = ROWS * bands_for(percent), percent / 100
    return math.floor(n * p - DEVIATIONS * math.sqrt(n * p * (1 - p)))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    if len(h) < SHINGLE:
        return mix64(np.array([len(h)], np.uint64) + np.bitwise_xor.reduce(mix64(h + np.arange(len(h), dtype=np.uint64)))).astype(np.uint64)
    return np.unique(gram_hashes(h, SHINGLE))


class MinHash:
    """``ROWS`` minima a band of 32-bit universal hashes, and keys of their bands."""

    def __init__(self, bands: int) -> None:
        rng = np.random.default_rng(20240229)
        n = ROWS * bands
        self.a = (rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n, np.uint32)[:, None]
        self.place = rng.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def minima(self, shingles: np.ndarray, block: int = 128) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(x), block):
            np.minimum(low, (self.a * x[None, i : i + block] + self.b).min(axis=1), out=low)
        return low

    def keys(self, low: np.ndarray) -> np.ndarray:
        by_band = low.reshape(-1, ROWS).astype(np.uint64)
        return mix64((mix64(by_band) * self.place).sum(axis=1) + self.band).view(np.int64)


def features(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: set size, fingerprint, band keys and the minima's low bytes (null keys for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHashes(), MinHash(bands_for(percent))
        for batch in batches:
            n, fp, bands, sig = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, hashes)
                n.append(len(s))
                if not len(s):
                    fp.append(None), bands.append(None), sig.append(None)
                    continue
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low = minhash.minima(s)
                bands.append(minhash.keys(low))
                sig.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "text_key", "n_shingles", "fp", "bands", "sig"])

    small_batches(docs.sparkSession)
    return doc_text(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, FEATURES)


def full_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """``(cid, members)``: the full shingle sets of the wanted classes ``(cid, fp, rep)``, made from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes).tobytes() for t in batch.column(1).to_pylist()]
            fp = [hashlib.blake2b(s, digest_size=16).digest() if s else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(sets, pa.binary())], ["fp", "members"])

    small_batches(docs.sparkSession)
    ids = wanted.select(F.col("rep").alias("want")).distinct()
    texts = doc_text(docs).join(bounded_broadcast(ids, n_wanted, BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("want")), "left_semi")
    made = texts.mapInArrow(run, "fp binary, members binary")
    keys = bounded_broadcast(wanted.select("fp", "cid"), n_wanted, BROADCAST_IDS // 2)
    return made.join(keys, "fp").groupBy("cid").agg(F.first("members").alias("members"))


@F.pandas_udf(IntegerType())
def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """Minima that two signatures have in common."""
    return pd.Series([np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) for x, y in zip(a, b)], dtype="int32")


def linked(percent: int):
    """Whether two full sets overlap by the threshold: exact integers."""

    def one(x: bytes, y: bytes) -> bool:
        s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(s, t, assume_unique=True))
        return 100 * both >= percent * (len(s) + len(t) - both)

    @F.pandas_udf(BooleanType())
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    return of


def _side(df: DataFrame, of: str, *columns: str) -> DataFrame:
    return df.select(F.col("cid").alias(of), *[F.col(c).alias(f"{c}_{of}") for c in columns])


def screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` of classes whose sizes and signatures allow a link."""
    near = pairs.join(_side(classes, "u", "n_shingles", "sig"), "u").join(_side(classes, "v", "n_shingles", "sig"), "v")
    sizes = F.least("n_shingles_u", "n_shingles_v") * 100 >= F.greatest("n_shingles_u", "n_shingles_v") * percent
    return near.where(sizes).where(agreeing("sig_u", "sig_v") >= screen_for(percent)).select("u", "v")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` that are linked on their full sets."""
    held = pairs.join(_side(sets, "u", "members"), "u").join(_side(sets, "v", "members"), "v")
    return held.where(linked(percent)("members_u", "members_v")).select("u", "v")


@F.pandas_udf(ArrayType(LongType()))
def differing(a: pd.Series, b: pd.Series) -> pd.Series:
    """The shingles that only one of two sets holds."""
    return pd.Series([np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).view(np.int64) for x, y in zip(a, b)], dtype=object)


def held_across(parted: DataFrame) -> DataFrame:
    """``(c, s, n)``: how many differences of a centre hold a shingle, for shingles that several roots hold.  Counted exactly, combined map-side."""
    counted = parted.select("centre", "root", F.explode("apart").alias("shingle")).groupBy("centre", "shingle").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"))
    return counted.where("a <> b").select(F.col("centre").alias("c"), F.col("shingle").alias("s"), "n")


def beginnings(parted: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Each difference's first shingles, rarest first, with their places.

    A document of ``size`` shingles is linked with none that differs from it in more than
    ``size * (100 - percent) / percent`` of them, so one more than that is enough.  Shingles
    that one root alone holds tie nothing together: they take the first places and are not handed
    on.  ``held`` is stored, so that both sides of the join are plain exchanges and a shingle of
    very many differences is split over tasks.
    """
    own = parted.select("centre", "cid", F.col("n_shingles").alias("size"), F.size("apart").alias("n_apart"), F.explode("apart").alias("shingle"))
    met = own.join(held, (F.col("centre") == F.col("c")) & (F.col("shingle") == F.col("s"))).drop("c", "s")
    whole = Window.partitionBy("centre", "cid")
    place = F.col("n_apart") - F.count("*").over(whole) + F.row_number().over(whole.orderBy("n", "shingle")) - 1
    first = met.withColumn("place", place).drop("n").where(F.col("place") * percent <= F.col("size") * (100 - percent))
    return first.join(parted.select("centre", "cid", "root", "centre_root"), ["centre", "cid"])


def across(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)`` of one centre from different roots whose differences can still overlap enough."""
    by = ["centre", "shingle"]
    several = postings.groupBy(*by).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select(F.col("centre").alias("c"), F.col("shingle").alias("s"))
    held = postings.join(several, (F.col("centre") == F.col("c")) & (F.col("shingle") == F.col("s")), "left_semi")
    u, v = (held.select(*by, *[F.col(c).alias(f"{c}_{x}") for c in ("cid", "root", "centre_root", "size", "n_apart", "place")]) for x in "uv")
    # one of the two lies outside the centre's component; two such pair in one order
    u = u.where("root_u <> centre_root_u")
    other = (F.col("root_u") != F.col("root_v")) & ((F.col("root_v") == F.col("centre_root_v")) | (F.col("cid_u") < F.col("cid_v")))
    room = F.least(F.col("n_apart_u") - F.col("place_u"), F.col("n_apart_v") - F.col("place_v"))
    enough = (F.col("n_apart_u") + F.col("n_apart_v") - 2 * room) * (100 + percent) <= (F.col("size_u") + F.col("size_v")) * (100 - percent)
    v = v.select(F.col("centre").alias("c"), F.col("shingle").alias("s"), "cid_v", "root_v", "centre_root_v", "size_v", "n_apart_v", "place_v")
    pairs = u.join(v, (F.col("centre") == F.col("c")) & (F.col("shingle") == F.col("s")) & other & enough)
    return pairs.select(F.least("cid_u", "cid_v").alias("u"), F.greatest("cid_u", "cid_v").alias("v")).distinct()


class Linking:
    """The ties to centres (step 3) and the exact rest (step 4) over one table's classes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int) -> None:
        self.docs, self.classes, self.percent = docs, classes, percent
        self.steps = Scratch(docs.sparkSession)
        buckets = classes.select("cid", F.explode("bands").alias("key"))
        centres = buckets.groupBy("key").agg(F.min("cid").alias("centre"), F.max("cid").alias("other")).where("centre < other")
        self.shared = self.steps.put("shared", buckets.join(centres, "key").select("key", "centre", "other", "cid"))

    def sets_of(self, cids: DataFrame) -> DataFrame:
        wanted = self.steps.put("wanted", self.classes.select("cid", "fp", "rep").join(cids.select("cid").distinct(), "cid", "left_semi"))
        return self.steps.put("sets", full_sets(self.docs, wanted, wanted.count()))

    def first_links(self) -> DataFrame:
        """Links with the buckets' least and greatest classes."""
        ends = F.explode(F.array(F.struct(F.col("centre").alias("u"), F.col("cid").alias("v")), F.struct(F.col("cid").alias("u"), F.col("other").alias("v"))))
        ties = self.shared.select(ends.alias("tie")).select("tie.*").where("u <> v").distinct()
        near = self.steps.put("near", screened(ties, self.classes, self.percent))
        sets = self.sets_of(near.select(F.col("u").alias("cid")).union(near.select("v")))
        links = self.steps.put("links", confirmed(near, sets, self.percent))
        self.steps.drop("near", "sets", "wanted")
        return links

    def placed(self, found: DataFrame) -> DataFrame:
        """Members, other than the centre, of buckets where those lie in several components; with roots."""
        member = found.select(F.col("node").alias("cid"), "root")
        middle = found.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
        rows = self.shared.where("cid <> centre").join(member, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        split = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        rows = rows.join(split, "key", "left_semi").join(middle, "centre", "left")
        return self.steps.put("open", rows.select("key", "centre", "cid", "root", F.coalesce("centre_root", "centre").alias("centre_root")))

    def links(self) -> DataFrame:
        """All links that tie components together, as ``(node, root)``."""
        links = self.first_links()
        found = components(links)
        rows = self.placed(found)
        rest = self.rest(rows) if rows.take(1) else None
        if rest is not None:
            found = components(links.union(rest))
        self.steps.drop(*list(self.steps.paths))
        return found

    def rest(self, rows: DataFrame) -> DataFrame | None:
        """Links that no tie to a centre showed."""
        sets = self.sets_of(rows.select("cid").union(rows.select("centre")))
        ties = rows.select("centre", "cid", "root", "centre_root").distinct()
        parted = ties.join(sets.select(F.col("cid").alias("centre"), F.col("members").alias("middle")), "centre").join(sets, "cid").join(self.classes.select("cid", "n_shingles"), "cid")
        parted = self.steps.put("parted", parted.select("centre", "cid", "root", "centre_root", "n_shingles", differing("members", "middle").alias("apart")))
        held = self.steps.put("held", held_across(parted))
        postings = self.steps.put("postings", beginnings(parted, held, self.percent))
        pairs = self.steps.put("pairs", across(postings, self.percent))
        near = self.steps.put("near", screened(pairs, self.classes, self.percent))
        new = self.steps.put("new", confirmed(near, sets, self.percent))
        return new if new.take(1) else None


def labelled(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, text_key, n_shingles, root, component_id)`` per row; rows of one group share a root."""
    steps = Scratch(docs.sparkSession)
    whole = steps.put("features", features(docs, percent))
    first = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")]
    by_set = whole.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), *first)
    classes = steps.put("classes", by_set.withColumn("cid", F.monotonically_increasing_id()))
    rows = steps.put("rows", whole.select("doc_id", "text_key", "n_shingles", "fp"))
    steps.drop("features")
    found = Linking(docs, classes, percent).links()
    least = classes.select("fp", "cid", "rep").join(found, F.col("cid") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "cid").alias("root"))
    top = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = steps.put("labels", least.join(top, "root").select("fp", "root", "component_id"))
    steps.drop("classes")
    out = rows.join(label, "fp", "left")
    return out.select("doc_id", "text_key", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``, linked from ``percent`` hundredths on."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return labelled(docs, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of least id stays, once.

    Rows are told apart by id and text, so an id that is used twice is judged by row; of rows
    equal in both one stays.  Rows without shingles stay, each once.
    """
    rows = labelled(docs, percent)
    each = rows.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n")).alias("best")
    best = each.where("root is not null").groupBy("root").agg(first).select("best.doc_id", "best.text_key", "best.n")
    best = best.union(each.where("root is null").select("doc_id", "text_key", "n"))
    chosen = Scratch(docs.sparkSession).put("chosen", best.select(F.col("doc_id").alias("want"), F.col("text_key").alias("want_key"), "n"))
    held = docs.select(F.struct(docs["*"]).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("want")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("want_key"))
    some = bounded_broadcast(chosen, chosen.count(), BROADCAST_IDS)
    out = held.join(some.where("n = 1"), same, "left_semi")
    if chosen.where("n > 1").take(1):
        twice = held.join(some.where("n > 1"), same).dropDuplicates(["want", "want_key"])
        out = out.union(twice.select("row"))
    return out.select("row.*")
