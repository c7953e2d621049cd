"""What the training-data operators share: reading, shared-folder tables, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold; texts differ in length by orders of magnitude.
BATCH_ROWS = 512
#: Words kept by a worker's word-hash cache before it starts anew.
CACHE_WORDS = 300_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the table holds."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the plans made next."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Where none is set, a session of one
    machine takes a temporary one and sets it; on a cluster that is an error, since executors
    would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read again.

    Files there outlive a lost executor, unlike cached blocks or local checkpoints.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Named steps in the shared folder; a step that has been replaced or used up is deleted there."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Store ``df`` under ``name`` and read it again; the former step of that name goes."""
        path = shared_folder(self.spark)
        df.write.parquet(path)
        if name in self.paths:
            self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete steps that no later plan reads."""
        for name in names:
            if path := self.paths.pop(name, None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast ``df`` only where its counted ``rows`` stay within ``most``; else leave it to a shuffle join."""
    return F.broadcast(df) if rows <= most else df


def crc_of_id(docs: DataFrame, mod: int):
    """crc32 of the id's decimal text, modulo ``mod`` (a null id counts as remainder 0)."""
    return F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(mod)), F.lit(0))


class WordHashes(dict):
    """64-bit hashes of byte words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers that place a word within a k-gram (fixed values).
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xE7037ED1A0B428DB)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all ``k``-word runs (``k`` at most 5) from word hashes, in text order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += mix64(h[j : j + n] + np.uint64(j)) * _PLACE[j]
    return mix64(out)
