"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table from frequent pre-tokens (runs between safe cuts, see
:mod:`eventloom.llm.chunks`) to their token lengths; it holds at most ``TABLE_ROWS`` entries
whatever the corpus size, taken from about ``SAMPLE`` texts that a hash of the id picks.  Tier
two encodes the rest with the library, behind a bounded cache in each Python worker.  Pre-tokens
are never shuffled: the sample's counts go to the driver, and the table only saves work, so
what it holds decides no count.

Nulls count as empty text (0 bytes, 0 tokens); rows repeat as they come; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import LONGEST_KEPT, PieceEncoder
from .common import doc_text, small_batches

#: Entries of the broadcast table: its size is fixed by this, not by the data.
TABLE_ROWS = 65_536
#: Texts whose pre-tokens fill the table, about.
SAMPLE = 4_000
#: Pre-tokens that a partition of the sample reports.
PARTITION_ROWS = 16_384

COUNTS = "doc_id long, n_bytes long, n_tokens long"


def frequent_pretokens(docs: DataFrame, rows: int = TABLE_ROWS) -> list[str]:
    """The most frequent pre-tokens of the sampled texts."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update((text or "").split(" ")[1:])
        top = [(w, n) for w, n in seen.most_common(PARTITION_ROWS) if n > 1 and len(w) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    small_batches(docs.sparkSession)
    share = min(1.0, SAMPLE / max(1, docs.count()))
    draw = F.pmod(F.xxhash64(docs["doc_id"].cast("string"), F.lit("tokens")), F.lit(1_000_000)) < share * 1_000_000
    parts = docs.where(draw).select(docs["text"].cast("string").alias("text")).mapInArrow(summary, "piece string, n long")
    total: Counter[str] = Counter()
    for r in parts.collect():
        total[r["piece"]] += r["n"]
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:rows]]


def count_tokens(docs: DataFrame, tokenizer_path: str, table_rows: int = TABLE_ROWS) -> DataFrame:
    """One row ``(doc_id, n_bytes, n_tokens)`` per row of ``docs``, whole texts, no added tokens."""
    spark = docs.sparkSession
    words = frequent_pretokens(docs, table_rows)
    own = PieceEncoder(tokenizer_path)
    table = spark.sparkContext.broadcast({w: len(own.library(" " + w)) // 4 for w in words})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = PieceEncoder(tokenizer_path), table.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [encoder.count(t, lengths) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    small_batches(spark)
    return doc_text(docs).mapInArrow(count, COUNTS)


def with_limit(counts: DataFrame, limit: int = 1024) -> DataFrame:
    """Flag documents of more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
