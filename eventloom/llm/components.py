"""Connected components by alternating large-star and small-star steps.

Edges ``(u, v)`` of any ordered type.  Each step is a grouped minimum, combined map-side, then
joined back to the edges.  In a large star a vertex may have very many neighbours; there the
minima are stored first, so the join's two sides are plain exchanges and such a vertex's edges
are split over tasks (adaptive skew joins).  In a small star, which follows one, a vertex has
few smaller neighbours.  No neighbourhood is gathered in one task.

An edge with a null end, or from a vertex to itself, links nothing and is left out; repeated
edges count once; without edges the result is empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize


def _large_star(edges: DataFrame, steps: Scratch) -> DataFrame:
    """Each vertex's larger neighbours are tied to the least of the vertex and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = steps.put("least", both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    far = both.where("v > u").join(least, F.col("u") == F.col("k"))
    return far.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    tied = down.join(least, F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every vertex of ``edges``; the root is its component's least vertex."""
    steps = Scratch(edges.sparkSession)
    edges = steps.put("edges", edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        total = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (total["n"], total["x"]) == state:
            break
        state = (total["n"], total["x"])
        edges = steps.put("edges", _small_star(_large_star(edges, steps)))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    found = materialize(found)
    steps.drop("edges", "least")
    return found
