"""Approximate neighbours: a coarse quantiser, short codes, several probes, and exact scores of a short list.

Centroids and code books are trained by k-means on a bounded sample of the items.  An index holds
each item's cell (its nearest centroid) and its code: one byte for every few dimensions.  A query
probes its nearest cells, scores their codes by table look-up, and re-scores exactly only the
items of the best codes.  A scan therefore reads codes, a sixteenth or less of the vectors.

How many cells a query must probe depends on the data: where items lie in clusters a few hold
all neighbours, where they don't almost every cell must be read.  It is measured on the sample.

Vectors without length, with a null, or of another size than the most common one have no cell and
are found by nothing; ties are ordered by id; an empty table, or no query, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions.columns import cosine

#: Items that the quantiser is trained on at most.
SAMPLE = 4096
#: Dimensions to a code byte, centroids of a code book, and rounds of k-means.
WIDTH, BOOK, ROUNDS = 4, 256, 12
#: Share of the sample's own neighbours that lie in the cells probed.
PROBED = 0.99
#: Items re-scored for each neighbour asked for, and the largest share of all items.
LISTED, SHARE = 100, 0.1
#: Bytes of query vectors that go to every task at once; more are searched part by part.
QUERY_BYTES = 64 * 2**20
#: Queries and items that a task scores at a time.
ASKS, ITEMS = 256, 4096
#: Pairs of query and item that are broadcast for their exact scores at most.
PAIRS = 2_000_000


def _means(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    """``k`` centroids of the rows of ``x`` (fewer if there are fewer rows); of unit length if asked."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T - (0 if unit else (centres**2).sum(1) / 2), axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def unit_rows(vectors: list[list | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be scored, and those at length 1."""
    at = [i for i, v in enumerate(vectors) if v and len(v) == size and None not in v]
    x = np.array([vectors[i] for i in at], float).reshape(-1, size)
    norm = np.linalg.norm(x, axis=1)
    good = (norm > 0) & np.isfinite(norm)
    return np.array(at, np.int64)[good], x[good] / norm[good, None]


@dataclass(frozen=True)
class Quantiser:
    """Cells, code books, and what the sample says of both."""

    size: int
    cells: np.ndarray
    books: list[np.ndarray]
    probes: int
    sample_cells: np.ndarray
    sample_codes: np.ndarray

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.cells.T, axis=1)

    def coded(self, x: np.ndarray) -> np.ndarray:
        """A byte for each part of the dimensions: its nearest entry in the part's code book."""
        parts = np.split(x, range(WIDTH, self.size, WIDTH), axis=1)
        return np.stack([np.argmax(p @ b.T - (b**2).sum(1) / 2, axis=1) for p, b in zip(parts, self.books)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Each part's products of code book entries and queries: a code's score is a sum over parts."""
        parts = np.split(queries, range(WIDTH, self.size, WIDTH), axis=1)
        return [b @ p.T for p, b in zip(parts, self.books)]

    def scores(self, tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        """Approximate scores, items by queries."""
        out = tables[0][codes[:, 0]]
        for m in range(1, len(tables)):
            out = out + tables[m][codes[:, m]]
        return out

    def probed(self, queries: np.ndarray) -> np.ndarray:
        """Cells by queries: whether a query probes a cell."""
        order = np.argsort(-(queries @ self.cells.T), axis=1, kind="stable")
        out = np.zeros((len(self.cells), len(queries)), bool)
        out[order[:, : self.probes], np.arange(len(queries))[:, None]] = True
        return out


def train(items: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 17) -> Quantiser | None:
    """A quantiser from at most ``sample`` items, those of the least hashes of their ids; None without usable vectors."""
    rng = np.random.default_rng(seed)
    some = items.where(F.size("embedding") > 0).select("id", F.col("embedding").cast("array<double>").alias("v"))
    drawn = some.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    sizes = [len(r["v"]) for r in drawn]
    if not sizes:
        return None
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    _, x = unit_rows([r["v"] for r in drawn], size)
    if not len(x):
        return None
    centres = _means(x, cells or max(1, int(np.sqrt(len(x)))), rng, unit=True)
    books = [_means(p, BOOK, rng) for p in np.split(x, range(WIDTH, size, WIDTH), axis=1)]
    first = Quantiser(size, centres, books, len(centres), np.empty(0), np.empty((0, 0)))
    own = first.cell_of(x)
    near = np.argsort(-(x[:256] @ x.T), axis=1, kind="stable")[:, 1:11]
    order = np.argsort(-(x[:256] @ centres.T), axis=1, kind="stable")
    depth = np.argsort(order, axis=1)[np.arange(len(near))[:, None], own[near]]
    probes = int(np.quantile(depth, PROBED, method="higher")) + 1 if near.size else len(centres)
    return Quantiser(size, centres, books, probes, own, first.coded(x))


def index(items: DataFrame, quantiser: Quantiser) -> DataFrame:
    """``(id, cell, code)`` of every item that can be scored."""
    schema = StructType([items.schema["id"], StructField("cell", IntegerType()), StructField("code", BinaryType())])
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit_rows(batch.column(1).to_pylist(), quantiser.size)
            codes = [c.tobytes() for c in quantiser.coded(x)] if len(x) else []
            cells = quantiser.cell_of(x) if len(x) else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).cast(shape.types[0]), pa.array(cells, pa.int32()), pa.array(codes, pa.binary())], shape.names)

    return items.select("id", F.col("embedding").cast("array<double>")).mapInArrow(run, schema)


def _asked(queries: DataFrame, quantiser: Quantiser, share: float) -> pa.Table:
    """``(queryId, v, least)``: queries that can be scored, at length 1, and the code score of the best ``share`` of the sample."""
    schema = StructType([queries.schema["queryId"], StructField("v", ArrayType(DoubleType())), StructField("least", DoubleType())])
    shape = to_arrow_schema(schema)
    # twice the share, so that a sample that is richer than all items leaves no query short; no more than probed cells hold
    n = len(quantiser.sample_codes)
    keep = min(n, int(np.ceil(2 * share * n)) + 10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit_rows(batch.column(1).to_pylist(), quantiser.size)
            for a in range(0, len(at), ASKS):
                some = x[a : a + ASKS]
                scores = quantiser.scores(quantiser.tables(some), quantiser.sample_codes)
                least = -np.sort(-np.where(quantiser.probed(some)[quantiser.sample_cells], scores, -np.inf), axis=0)[keep - 1]
                names = batch.column(0).take(pa.array(at[a : a + ASKS])).cast(shape.types[0])
                yield pa.RecordBatch.from_arrays([names, pa.array(list(some), shape.types[1]), pa.array(least)], shape.names)

    return queries.select("queryId", F.col("queryVector").cast("array<double>").alias("v")).mapInArrow(run, schema).toArrow()


def _listed(indexed: DataFrame, queries: DataFrame, quantiser: Quantiser, share: float) -> DataFrame:
    """``(queryId, id, near)`` of the items in probed cells whose code scores as one of the best ``share`` of the sample.

    A task holds the queries' vectors, and the tables and scores of ``ASKS`` of them at a time.
    """
    schema = StructType([queries.schema["queryId"], indexed.schema["id"], StructField("near", DoubleType())])
    shape = to_arrow_schema(schema)
    asked = _asked(queries, quantiser, share)
    names, least = asked.column(0).combine_chunks(), asked.column(2).to_numpy()
    x = asked.column(1).combine_chunks().flatten().to_numpy().reshape(-1, quantiser.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cells), -1)
            for q in range(0, len(x), ASKS):
                some = x[q : q + ASKS]
                probed, tables = quantiser.probed(some), quantiser.tables(some)
                for a in range(0, len(cells), ITEMS):
                    scores = quantiser.scores(tables, codes[a : a + ITEMS])
                    row, ask = np.nonzero((scores >= least[q : q + ASKS]) & probed[cells[a : a + ITEMS]])
                    ids = batch.column(0).take(pa.array(row + a)).cast(shape.types[1])
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(ask + q)).cast(shape.types[0]), ids, pa.array(scores[row, ask])], shape.names)

    return indexed.mapInArrow(run, schema) if len(names) else indexed.sparkSession.createDataFrame([], schema)


def shortlist(items: DataFrame, queries: DataFrame, k: int, quantiser: Quantiser | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """``(queryId, id)``: for each query the ``LISTED * k`` items of the best codes, at most ``SHARE`` of all items.

    Queries are a stated set; they are searched in parts of about ``QUERY_BYTES``.
    """
    quantiser = quantiser or train(items)
    if quantiser is None:
        return items.select(F.lit(None).cast(queries.schema["queryId"].dataType).alias("queryId"), "id").limit(0)
    indexed = index(items, quantiser) if indexed is None else indexed
    n = items.count()
    most = min(LISTED * k, max(k, int(SHARE * n)))
    parts = max(1, -(-queries.count() * quantiser.size * 8 // QUERY_BYTES))
    found = None
    for part in range(parts):
        some = queries.where(F.pmod(F.xxhash64("queryId"), F.lit(parts)) == part) if parts > 1 else queries
        one = _listed(indexed, some, quantiser, most / max(n, 1))
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy("queryId").orderBy(F.desc("near"), "id")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).select("queryId", "id")


def ann(items: DataFrame, queries: DataFrame, k: int, quantiser: Quantiser | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """Approximate cosine top-k of ``(id, embedding)`` for each ``(queryId, queryVector)``.

    An index that was stored (``index``, with its quantiser) is searched as it is; without one, one
    is made.  The short list goes to the items, or is joined to them where it is too long for that.
    """
    pairs = shortlist(items, queries, k, quantiser, indexed)
    few = queries.count() * LISTED * k <= PAIRS
    scored = items.select("id", "embedding").join(F.broadcast(pairs) if few else pairs, "id").join(queries.select("queryId", "queryVector"), "queryId")
    scored = scored.select("queryId", "id", F.round(cosine(F.col("embedding"), F.col("queryVector")), 12).alias("score")).where("score is not null")
    order = Window.partitionBy("queryId").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
