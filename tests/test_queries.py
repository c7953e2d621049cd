"""Every registered query of the library proper against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from pyspark.sql import functions as F

from eventloom.operators import neighbours
from eventloom.plans import derive, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v) -> str:
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.8g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_postings_are_asked_every_benchmark_item(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()
    hits = registry.queries()["v3_postings_index"](spark, SF)
    assert {r["queryId"] for r in hits.select("queryId").distinct().collect()} == {r["item_id"] for r in items}


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_approximate_search_recall_and_work(spark, sf):
    """Recall of at least 0.95 at ten, from exact scores of at most a tenth of all pairs."""
    folder = f"/root/testdata/{sf}"
    recall = [r["recall"] for r in registry.queries()["v17_ann_fidelity"](spark, folder).collect()]
    items = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asks = items.where("id % 20 = 0").select(F.col("id").alias("queryId"), F.col("embedding").alias("queryVector"))
    assert len(recall) == asks.count() and sum(recall) / len(recall) >= 0.95 and min(recall) >= 0.7, (sum(recall) / len(recall), min(recall))
    assert neighbours.shortlist(items, asks, 10).count() <= 0.1 * items.count() * asks.count()


def exchanges(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in x]


@pytest.fixture()
def many_rows(spark, monkeypatch):
    """Tables that look large: few rows a task, none broadcast by its size."""
    monkeypatch.setattr(derive, "ROWS_PER_TASK", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt_once(spark, name: str, most: int) -> None:
    """Line items are dealt by order over tasks that follow their number; nothing after it is shuffled."""
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    found = exchanges(registry.queries()[name](spark, SF))
    assert 0 < len(found) <= most and all(f", {tasks})" in x and "REPARTITION_BY_NUM" in x for x in found), found


def test_assessment_is_dealt_once_by_pair(spark, many_rows):
    dealt_once(spark, "v18_paired_assessment", 5)


@pytest.mark.parametrize("name, most", [("v4_rrf", 1), ("v6_rank_fusion", 1), ("v6_score_fusion", 1), ("v5_hybrid_candidates", 2), ("v5_hybrid_jobs", 2), ("v7_skill_evidence_rank", 1), ("v9_fit_reasons", 1), ("v11_search_or_fallback", 5)])
def test_ranked_hits_are_dealt_once_by_query(spark, many_rows, name, most):
    dealt_once(spark, name, most)
