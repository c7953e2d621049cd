"""Offline relevance evaluation and discovery KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels whose sizes are broadcast at most.
FEW_LABELS = 100_000


def _first(ranked: DataFrame) -> DataFrame:
    first = ranked.groupBy("queryId", "id").agg(F.min("rank").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("queryId").orderBy("at", "id"))).select("queryId", "id", "place")


def recall_at_k(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Share of the relevant ids among the first ``k`` distinct ones; null without relevant ids."""
    hits = _first(ranked).where(F.col("place") <= k).select("queryId", "id").withColumn("hit", F.lit(1))
    both = relevant.select("queryId", "id").distinct().join(hits, ["queryId", "id"], "left")
    return both.groupBy("queryId").agg((F.count("hit") / F.count("*")).alias("recall"))


def ndcg_at_k(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Binary gains 1/log2(place + 1) over the ideal order's."""
    hits = _first(ranked).where(F.col("place") <= k)
    both = relevant.select("queryId", "id").distinct().join(hits, ["queryId", "id"], "left")
    return _ndcg(both, k, F.count("*"))


def _ndcg(both: DataFrame, k: int, relevant: Column) -> DataFrame:
    """From ``(queryId, place)`` of relevant ids, null where they were not found, and how many there are."""
    gain = 1 / F.log2(F.col("place") + F.lit(1.0))
    sums = both.groupBy("queryId").agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"), relevant.alias("n"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + F.lit(1.0))), F.lit(0.0), lambda a, x: a + x)
    return sums.select("queryId", (F.col("dcg") / ideal).alias("ndcg"))


def _in_group(ranked: DataFrame, items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(queryId, n, place)``: each query's number of relevant items, and the places of those among the first ``k``.

    Relevant to a query ``(queryId, label)`` are all items ``(id, label)`` of its label, which are
    counted by label and looked up by id, but not paired with the queries; ids are unique.
    """
    sizes = items.groupBy("label").agg(F.count("*").alias("n"))
    asked = queries.select("queryId", "label").distinct().join(F.broadcast(sizes) if sizes.limit(FEW_LABELS + 1).count() <= FEW_LABELS else sizes, "label")
    first = _first(ranked).where(F.col("place") <= k)
    hits = first.join(items.select("id", F.col("label").alias("found")), "id").select("queryId", "found", "place")
    return asked.join(hits, (asked["queryId"] == hits["queryId"]) & (asked["label"] == hits["found"]), "left").select(asked["queryId"], "n", "place")


def recall_in_group(ranked: DataFrame, items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``recall_at_k`` where a query's label makes all items of that label relevant."""
    return _in_group(ranked, items, queries, k).groupBy("queryId").agg((F.count("place") / F.max("n")).alias("recall"))


def ndcg_in_group(ranked: DataFrame, items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``ndcg_at_k`` where a query's label makes all items of that label relevant."""
    return _ndcg(_in_group(ranked, items, queries, k), k, F.max("n"))


def ann_fidelity(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Recall of an approximate ranking against the exact neighbours."""
    return recall_at_k(approximate, exact.where(F.col("rank") <= k), k)


def retrieval_verdict(observations: DataFrame, least_recall: float = 0.95, slower: float = 1.10) -> DataFrame:
    """``violations`` and ``passed`` by filter bucket ``(bucket, recall, annReturnedHits, p95, baselineP95)``.

    A measurement that cannot be true (not finite, negative, recall over 1, no baseline) is the
    only violation then.  Recall is null where the exact search found nothing: the approximate
    one must have found nothing either.
    """
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) >= 0), F.lit(False))
    sound = finite("p95") & finite("baselineP95") & (F.col("baselineP95") > 0) & (F.col("recall").isNull() | (finite("recall") & (F.col("recall") <= 1)))
    hits = F.coalesce("annReturnedHits", F.lit(False))
    found = F.array_compact(
        F.array(
            F.when(F.col("recall") < least_recall, "RecallBelowMinimum"),
            F.when(F.col("recall").isNull() & hits, "RecallUndefinedButAnnReturnedHits"),
            F.when(F.col("p95") > F.col("baselineP95") * slower, "P95AboveLimit"),
        )
    )
    violations = F.when(sound, found).otherwise(F.array(F.lit("InvalidMeasurement")))
    return observations.withColumn("violations", violations).withColumn("passed", F.size("violations") == 0)


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Attempts, outcomes, means, percentiles and throughput by use case, filter group and split, and overall."""
    ok = F.col("outcome") == "Succeeded"
    ms = F.col("latencyMillis")
    return results.groupingSets([["useCase", "filterGroup", "split"], []], "useCase", "filterGroup", "split").agg(
        F.count("*").alias("attempts"),
        F.count(F.when(ok, 1)).alias("successes"),
        F.count(F.when(F.col("outcome") == "Failed", 1)).alias("failures"),
        F.count(F.when(F.col("outcome") == "Unavailable", 1)).alias("unavailable"),
        F.avg(F.when(ok, F.col("recall"))).alias("meanRecall"),
        F.avg(F.when(ok, F.col("ndcg"))).alias("meanNdcg"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latencyMillis)").alias("p50Millis"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latencyMillis)").alias("p95Millis"),
        (F.count("*") * 1000.0 / F.sum(ms)).alias("perSecond"),
    )


#: Reasons of a paired assessment (names and order are fixed values) and what raises each: a condition over a pair's terms
#: (``b_`` baseline, ``c_`` candidate) and what was gathered from its queries and costs.
REASONS: dict[str, str] = {
    "PolicyProposed": "agreed IS NOT TRUE",
    "LabelsUnreviewed": "rubricApproved IS NOT TRUE OR unreviewed",
    "MissingLabelAttestation": "attested IS NOT TRUE",
    "FixtureRankings": "b_rankings = 'AuthoredFixture' OR c_rankings = 'AuthoredFixture'",
    "FixtureEmbeddings": "(b_generated AND c_generated) IS NOT TRUE",
    "MissingObservedEvidence": "b_privacy IS NULL OR c_privacy IS NULL",
    "PrivacyFailure": "b_privacy = 'Failed' OR c_privacy = 'Failed'",
    "EligibilityFailure": "b_eligibility = 'Failed' OR c_eligibility = 'Failed'",
    "IncompleteCoverage": "missed OR testedUseCases <> supportedUseCases",
    "RetrievalFailure": "failed",
    "MissingRelevance": "noRelevance",
    "RelevanceRegression": "lessRelevant",
    "MissingLatency": "noLatency",
    "LatencyRegression": "slower > noiseMillis",
    "AbsoluteLatencyBudgetExceeded": "(b_generated OR c_generated) AND slowest > budgetMillis",
    "MissingProviderMeasurements": "b_requests IS NULL OR c_requests IS NULL",
    "ProviderRequestRegression": "c_requests > b_requests",
    "MissingComparableBilling": "NOT comparable",
    "CostLimitExceeded": "comparable AND dearer",
}
#: Reasons that reject; any other one defers.
REJECTING = ("PrivacyFailure", "EligibilityFailure", "RetrievalFailure", "RelevanceRegression", "LatencyRegression", "ProviderRequestRegression", "CostLimitExceeded")
_COMPARABLE = "b_privacy IS NOT NULL AND c_privacy IS NOT NULL AND trim(b_billing) <> '' AND b_billing = c_billing AND trim(b_currency) <> '' AND b_currency = c_currency AND costsKnown"
_SOUND = "supportedUseCases > 0 AND supportedUseCases = presentUseCases AND costsSound AND noiseMillis >= 0 AND noiseMillis < double('infinity') AND (budgetMillis > 0 OR (budgetMillis IS NULL AND NOT b_generated AND NOT c_generated))"


def _pair_queries(measured: DataFrame, terms: DataFrame, costs: DataFrame) -> DataFrame:
    """What a pair's queries show: per use case and filter group first, then per pair."""
    # a pair's use cases are a few names, so they are held with its terms: every join is by pair alone
    policy = costs.where("supported").groupBy("pairId").agg(F.collect_set("useCase").alias("policy"))
    rows = measured.join(terms.select("pairId", "b_vector", "c_vector").join(policy, "pairId", "left"), "pairId")
    rows = rows.withColumn("inPolicy", F.coalesce(F.array_contains("policy", F.col("useCase")), F.lit(False)))
    rows = rows.withColumn("counts", F.expr("inPolicy AND (useCase <> 'Recommendations' OR coalesce(filterGroup = 'Broad' AND b_vector AND c_vector, false))"))
    rows = rows.withColumn("test", F.expr("counts AND split = 'HeldOut'"))
    facts = {
        "inPolicy": "bool_or(inPolicy)",
        "unreviewed": "bool_or(inPolicy AND reviewed IS NOT TRUE)",
        "tests": "count_if(test)",
        "missed": " OR ".join(f"bool_or({s}_outcome IS NULL OR (counts AND {s}_outcome NOT IN ('Succeeded', 'Failed')))" for s in "bc"),
        "failed": " OR ".join(f"bool_or(counts AND {s}_outcome <=> 'Failed')" for s in "bc"),
        "noLatency": " OR ".join(f"bool_or(counts AND {s}_outcome <=> 'Succeeded' AND {s}_latencyMillis IS NULL)" for s in "bc"),
    }
    for s in "bc":
        mine = f"CASE WHEN test AND {s}_outcome = 'Succeeded' THEN {s}_"
        facts |= {f"{s}_seen": f"count_if(test AND {s}_outcome IS NOT NULL) > 0", f"{s}_recall": f"avg({mine}recall END)", f"{s}_ndcg": f"avg({mine}ndcg END)"}
        facts[f"{s}_p95"] = f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {mine}latencyMillis END)"
    groups = rows.groupBy("pairId", "useCase", "filterGroup").agg(*[F.expr(e).alias(n) for n, e in facts.items()])
    both = "tests > 0 AND b_seen AND c_seen AND "
    any_of = {
        **{c: c for c in ("inPolicy", "unreviewed", "missed", "failed", "noLatency")},
        "tested": "tests > 0",
        "noRelevance": f"{both}(b_recall IS NULL OR c_recall IS NULL OR b_ndcg IS NULL OR c_ndcg IS NULL)",
        "lessRelevant": f"coalesce({both}(c_recall < b_recall OR c_ndcg < b_ndcg), false)",
    }
    most = {"slower": f"CASE WHEN {both}true THEN c_p95 - b_p95 END", "slowest": f"CASE WHEN {both}true THEN greatest(b_p95, c_p95) END"}
    # by use case first: distinct ones are counted without a shuffle by use case
    uses = groups.groupBy("pairId", "useCase").agg(*[F.expr(f"bool_or({e})").alias(n) for n, e in any_of.items()], *[F.expr(f"max({e})").alias(n) for n, e in most.items()])
    return uses.groupBy("pairId").agg(
        *[F.expr(f"bool_or({n})").alias(n) for n in any_of if n not in ("inPolicy", "tested")],
        *[F.max(n).alias(n) for n in most],
        F.expr("count_if(inPolicy AND useCase IS NOT NULL)").alias("presentUseCases"),
        F.expr("count_if(tested AND useCase IS NOT NULL)").alias("testedUseCases"),
    )


def assess(measured: DataFrame, terms: DataFrame, costs: DataFrame) -> DataFrame:
    """``pairId, decision, reasons`` of pairs of a baseline and a candidate run, all pairs at once.

    ``measured``: a row per pair and query of the corpus ``(pairId, queryId, useCase, filterGroup,
    split, reviewed)`` with ``outcome, recall, ndcg, latencyMillis`` under ``b_`` and ``c_``; a null
    outcome is a query that the run does not have.  ``terms``: a row per pair ``(agreed,
    rubricApproved, attested, noiseMillis, budgetMillis)`` with ``rankings, embeddings, vector,
    requests, privacy, eligibility, billing, currency`` under ``b_`` and ``c_``; a null privacy
    is missing evidence.  ``costs``: a row per pair and use case ``(supported, maximumCost, b_cost,
    c_cost)``.  Relevance and latency are judged on held-out queries of supported use cases, by
    use case and filter group; recommendations only with broad filters and vector search on both
    sides.  A policy that cannot be applied gives ``Invalid`` and no reasons.  Inputs that were
    dealt by ``pairId`` over one number of tasks are not shuffled again.
    """
    spent = costs.groupBy("pairId", "useCase").agg(
        F.expr("bool_or(supported AND useCase IS NOT NULL)").alias("used"),
        F.expr("bool_and(CASE WHEN supported THEN b_cost IS NOT NULL AND c_cost IS NOT NULL ELSE b_cost IS NULL AND c_cost IS NULL END)").alias("costsKnown"),
        F.expr("bool_or(coalesce(c_cost > maximumCost, false) OR coalesce(c_cost > b_cost, false))").alias("dearer"),
        F.expr("bool_and(coalesce(least(maximumCost, b_cost, c_cost) >= 0, true))").alias("costsSound"),
    )
    spent = spent.groupBy("pairId").agg(F.expr("count_if(used)").alias("supportedUseCases"), *[F.expr(f"{f}({n})").alias(n) for f, n in (("bool_and", "costsKnown"), ("bool_or", "dearer"), ("bool_and", "costsSound"))])
    pairs = terms.join(_pair_queries(measured, terms, costs), "pairId", "left").join(spent, "pairId", "left")
    pairs = pairs.withColumns({f"{s}_generated": F.expr(f"coalesce({s}_embeddings = 'ProviderGenerated', false)") for s in "bc"})
    pairs = pairs.withColumn("comparable", F.coalesce(F.expr(_COMPARABLE), F.lit(False)))
    raised = F.array_compact(F.array(*[F.when(F.expr(f"({e})"), F.lit(n)) for n, e in REASONS.items()]))
    sound = F.coalesce(F.expr(_SOUND), F.lit(False))
    out = pairs.select("pairId", F.when(sound, raised).otherwise(F.array().cast("array<string>")).alias("reasons"), sound.alias("sound"))
    rejects = F.arrays_overlap("reasons", F.array(*map(F.lit, REJECTING)))
    decision = F.when(~F.col("sound"), "Invalid").when(F.size("reasons") == 0, "Recommend").when(rejects, "Reject").otherwise("Defer")
    return out.select("pairId", decision.alias("decision"), "reasons")


def evaluation_violations(runs: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Ranked ids that are unknown, repeated, or not eligible for their query ``(queryId, eligibleIds)``."""
    n = F.count("*").over(Window.partitionBy("queryId", "id"))
    known = corpus.select("id").distinct().withColumn("known", F.lit(True))
    rows = runs.withColumn("n", n).join(known, "id", "left").join(queries.select("queryId", "eligibleIds"), "queryId", "left")
    reason = F.when(F.col("known").isNull(), "UNKNOWN_ID").when(F.col("eligibleIds").isNull(), "UNKNOWN_QUERY").when(F.col("n") > 1, "DUPLICATE_ID").when(~F.array_contains("eligibleIds", F.col("id")), "INELIGIBLE_ID")
    return rows.withColumn("violation", reason).where("violation is not null").select("queryId", "id", "rank", "violation")


def search_observations(events: DataFrame) -> DataFrame:
    """Searches ``(searchId, resultCount, firstClickRank)`` from search and click events."""
    searches = events.where("eventType = 'SEARCH_PERFORMED'").groupBy("searchId").agg(F.max(F.size("results")).alias("resultCount"))
    clicks = events.where("eventType = 'SEARCH_RESULT_CLICKED'").groupBy("searchId").agg(F.min(F.struct("occurredAt", "rank")).alias("c"))
    return searches.join(clicks, "searchId", "left").select("searchId", "resultCount", F.col("c.rank").alias("firstClickRank"))


def discovery_baseline(searches: DataFrame, followups: DataFrame) -> DataFrame:
    """KPIs of searches and of applications' first status changes; an empty population gives null."""
    s = searches.agg(
        F.avg((F.col("resultCount") == 0).cast("double")).alias("zeroResultRate"),
        F.avg(F.col("firstClickRank").isNotNull().cast("double")).alias("clickShare"),
        F.avg("firstClickRank").alias("meanFirstClickRank"),
        F.expr("percentile(firstClickRank, 0.5)").alias("medianFirstClickRank"),
    )
    hours = (F.unix_micros("firstStatusChangeAt") - F.unix_micros("appliedAt")) / 3.6e9
    f = followups.withColumn("hours", hours).agg(F.avg("hours").alias("meanReviewHours"), F.expr("percentile(hours, 0.5)").alias("medianReviewHours"), F.count(F.when(F.col("firstStatusChangeAt").isNull(), 1)).alias("unreviewed"))
    return s.withColumn("k", F.lit(1)).join(f.withColumn("k", F.lit(1)), "k").drop("k")
