"""Vector, lexical and fused retrieval as batch joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import canonical_set, cosine
from ..sources.shared import shared_path

RRF = 60
MAX_TEXT = 12_000
#: Bytes of query vectors that may go to every task at once.
BROADCAST_BYTES = 64 * 2**20
#: Query terms that may be broadcast (short strings).
BROADCAST_TERMS = 100_000
#: Query terms that may stand in a plan as a list.
PLAN_TERMS = 5_000
#: Scores that a task holds at a time, and queries whose hits it hands on at a time.
SCORES_AT_A_TIME, ASKS_AT_A_TIME = 4_000_000, 4096


def _top(df: DataFrame, k: int, order: list, by: str = "queryId") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _scorer(asked: pa.Table, k: int, shape: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part of ``knn``: its items, ordered by id, against all ``(queryId, vector)``, in matrix blocks.

    Each query keeps the ``k`` best items so far; of equal ones the first in order stay, so a task
    hands on ``k`` rows a query, however many items it reads and however many of them are alike.
    """
    import numpy as np

    by_size: dict[int, list[int]] = {}
    vectors = asked.column(1).combine_chunks()
    for i, v in enumerate(vectors):
        if v.is_valid and len(v) and not v.values.null_count and np.any(v.values.to_numpy()):
            by_size.setdefault(len(v), []).append(i)
    units = []
    for some in by_size.values():
        m = np.stack([vectors[i].values.to_numpy() for i in some])
        units.append((asked.column(0).combine_chunks().take(pa.array(some)), m / np.linalg.norm(m, axis=1, keepdims=True)))

    def kept(best: np.ndarray, places: np.ndarray, scores: np.ndarray, at: np.ndarray) -> None:
        """Merge a block of scores, queries by items, into the best ones and their places."""
        better = scores > best[:, -1:]
        if scores.shape[1] > k and np.count_nonzero(better) > k * len(scores):
            better &= scores >= np.partition(scores, -k, axis=1)[:, -k, None]
        of, item = np.nonzero(better)
        hit = np.unique(of)
        if not len(hit):
            return
        query = np.concatenate([np.repeat(hit, k), of])
        score = np.concatenate([best[hit].ravel(), scores[of, item]])
        place = np.concatenate([places[hit].ravel(), at[item]])
        order = np.lexsort((place, -score, query))
        ends = np.flatnonzero(np.diff(query[order], prepend=-1))
        top = order[(ends[:, None] + np.arange(k)).ravel()]
        best[hit], places[hit] = score[top].reshape(-1, k), place[top].reshape(-1, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.full((len(unit), k), -np.inf), np.full((len(unit), k), -1)) for _, unit in units]
        ids, read = [], 0
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            for (_, unit), (best, places) in zip(units, found):
                rows = np.array([i for i, v in enumerate(vectors) if v and len(v) == unit.shape[1] and None not in v], np.int64)
                m = np.array([vectors[i] for i in rows], float).reshape(-1, unit.shape[1])
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                rows, m = rows[norm[:, 0] > 0], (m / np.where(norm > 0, norm, 1))[norm[:, 0] > 0]
                step = max(1, SCORES_AT_A_TIME // max(1, len(rows)))
                for a in range(0, len(unit) if len(rows) else 0, step):
                    # rounded, so that equal vectors tie whatever block they are in
                    kept(best[a : a + step], places[a : a + step], np.round(unit[a : a + step] @ m.T, 12), rows + read)
            ids.append(batch.column(0))
            read += batch.num_rows
        for (asks, _), (best, places) in zip(units, found):
            for a in range(0, len(best) if ids else 0, ASKS_AT_A_TIME):
                of, n = np.nonzero(places[a : a + ASKS_AT_A_TIME] >= 0)
                hits = pa.chunked_array(ids).take(pa.array(places[a + of, n])).combine_chunks()
                yield pa.RecordBatch.from_arrays([asks.take(pa.array(a + of)).cast(shape.types[0]), hits.cast(shape.types[1]), pa.array(best[a + of, n])], shape.names)

    return run


def knn(items: DataFrame, queries: DataFrame, k: int, where: Column | None = None, blocks: int = 16) -> DataFrame:
    """Exact cosine top-k of ``(id, embedding)`` for each ``(queryId, queryVector)``; filters come first.

    A stated query set is scored against all items in blocks: each task keeps its own top k per
    query before anything is shuffled, and a second top-k merges the tasks'.  Queries of up to
    ``BROADCAST_BYTES`` go to the tasks as one matrix; more are joined to item blocks.  Vectors
    without length, with a null or of another size than the query's have no score.
    """
    base = items if where is None else items.where(where)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("queryVector")).alias("width")).first()
    order = [F.desc("score"), F.asc("id")]
    if size["n"] * max(1, size["width"] or 0) * 8 <= BROADCAST_BYTES:
        asked = queries.select("queryId", F.col("queryVector").cast("array<double>")).toArrow()
        schema = StructType([queries.schema["queryId"], items.schema["id"], StructField("score", DoubleType())])
        read = base.select("id", F.col("embedding").cast("array<double>")).sortWithinPartitions("id")
        return _top(read.mapInArrow(_scorer(asked, k, to_arrow_schema(schema)), schema), k, order)
    left = base.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    right = queries.select("queryId", "queryVector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    scored = left.join(right, "block").select("queryId", "block", "id", cosine(F.col("embedding"), F.col("queryVector")).alias("score")).where("score is not null")
    per_block = scored.withColumn("r", F.row_number().over(Window.partitionBy("queryId", "block").orderBy(*order))).where(F.col("r") <= k)
    return _top(per_block.select("queryId", "id", "score"), k, order)


def terms(text: Column | str) -> Column:
    """Lower-cased words of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _weighed(weight: float) -> Callable[[Column], Column]:
    return lambda term: F.struct(term.alias("term"), F.lit(weight).alias("weight"))


def _worded(docs: DataFrame, fields: dict[str, float], keep: Callable[[Column], Column] = lambda words: words) -> DataFrame:
    """``(id, dl, hits)``: a document's weighted length, and its words that ``keep`` leaves with their fields' weights.  One cut of each text."""
    words = docs.select("id", *[terms(F.coalesce(name, F.lit(""))).alias(f"t{i}") for i, name in enumerate(fields)])
    lengths = [F.size(f"t{i}") * F.lit(weight) for i, weight in enumerate(fields.values())]
    weighed = [F.transform(keep(F.col(f"t{i}")), _weighed(weight)) for i, weight in enumerate(fields.values())]
    return words.select("id", sum(lengths[1:], lengths[0]).alias("dl"), F.concat(*weighed).alias("hits"))


def _frequencies(worded: DataFrame) -> DataFrame:
    """``(term, id, dl, tf)``: a document's weighted count of each of its words."""
    return worded.select("id", "dl", F.explode("hits").alias("hit")).groupBy(F.col("hit.term").alias("term"), "id", "dl").agg(F.sum("hit.weight").alias("tf"))


def _bm25(tf: DataFrame, wanted: DataFrame, n: int, avgdl: float, k: int, k1: float, b: float, counted: DataFrame | None = None) -> DataFrame:
    """Top-k by query from the frequencies of wanted terms.  Scores are rounded, so that equal texts tie in whatever order their parts are added.

    ``counted`` are the same rows before a shuffle that counting the terms' documents doesn't need.
    """
    sent = F.broadcast if wanted.count() <= BROADCAST_TERMS else lambda df: df
    # counts a column of tf, so that the plan's exchange below it is the same and is used twice
    df = (tf if counted is None else counted).groupBy("term").agg(F.count("tf").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    parts = tf.join(sent(df), "term").select("id", "term", part.alias("part"))
    scores = parts.join(sent(wanted), "term").groupBy("queryId", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return _top(scores, k, [F.desc("score"), F.asc("id")])


def _wanted(queries: DataFrame) -> DataFrame:
    return queries.select("queryId", F.explode(F.array_distinct(terms("query"))).alias("term"))


def _few_terms(wanted: DataFrame) -> list[str] | None:
    """The distinct terms of the queries, where they are few enough to stand in a plan."""
    found = [r["term"] for r in wanted.select("term").distinct().limit(PLAN_TERMS + 1).collect()]
    return sorted(found) if len(found) <= PLAN_TERMS else None


def lexical(docs: DataFrame, queries: DataFrame, fields: dict[str, float], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over weighted text fields for ``(queryId, query)``, in one scan of the texts; ``id`` is unique.

    Texts are cut once, and only words that a query has leave the scan: they are dropped from the
    word lists before those are unfolded (for more than ``PLAN_TERMS`` query terms, by a semi-join).
    Lengths and words are stored for the passes over them.  Use ``build_postings`` and
    ``search_postings`` for many query sets over the same texts.
    """
    wanted = _wanted(queries)
    few = _few_terms(wanted)
    kept = _worded(docs, fields, (lambda words: F.filter(words, lambda w: w.isin(few))) if few is not None else lambda words: words)
    path = shared_path(docs.sparkSession)
    kept.write.parquet(path)
    stored = docs.sparkSession.read.schema(kept.schema).parquet(path)
    stats = stored.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    tf = _frequencies(stored)
    if few is None:
        tf = tf.join(wanted.select("term").distinct(), "term", "left_semi")
    return _bm25(tf, wanted, stats["n"], stats["avgdl"] or 1.0, k, k1, b)


#: Folders of a postings table by default, and the folder of document lengths, which stand under no term.
POSTING_PARTS, LENGTHS = 64, -1
#: Pairs of a document and a query that a task of a postings search scores: sums and their order take some 300 MB.
PAIRS_PER_TASK = 1_000_000


def build_postings(docs: DataFrame, fields: dict[str, float], path: str, parts: int = POSTING_PARTS) -> None:
    """Store ``(term, id, dl, tf)`` in folders by a hash of the term, sorted by term, from one scan of the texts.

    Each document adds one row without a term, so that lengths are counted from the same table.  A
    term of very many documents is spread over several files.  Texts are dealt by id before they are
    cut, which is less than their words: words are then counted where they are, and only the postings
    are shuffled, to their folders.
    """
    dealt = docs.select("id", *fields).repartition("id")
    marked = _worded(dealt, fields).withColumn("hits", F.concat("hits", F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("weight")))))
    part = F.when(F.col("term") == "", F.lit(LENGTHS)).otherwise(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    rows = _frequencies(marked).withColumn("part", part).hint("rebalance", "part")
    rows.sortWithinPartitions("part", "term", "id").write.partitionBy("part").parquet(path)


def search_postings(spark: SparkSession, path: str, queries: DataFrame, k: int, parts: int = POSTING_PARTS, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The same rows as ``lexical``, from stored postings: only folders and row groups of the queries' terms are read.

    Read postings are dealt by id, over as many tasks as documents times queries need, before they are
    scored: they are fewer than the pairs with a query that come of them, which are summed up, and cut
    to each query's best ``k``, where they are.
    """
    stored, wanted = spark.read.parquet(path), _wanted(queries)
    stats = stored.where(F.col("part") == LENGTHS).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    few = _few_terms(wanted)
    if few is None:
        tf = stored.where(F.col("part") != LENGTHS).join(wanted.select("term").distinct(), "term", "left_semi")
    else:
        folders = [r["part"] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")).distinct().collect()]
        tf = stored.where((F.col("part").isin(folders) & F.col("term").isin(few)) if few else F.lit(False))
    pairs = stats["n"] * wanted.select("queryId").distinct().count()
    dealt = tf.select("term", "id", "dl", "tf").repartition(max(spark.sparkContext.defaultParallelism, -(-pairs // PAIRS_PER_TASK)), "id")
    return _bm25(dealt, wanted, stats["n"], stats["avgdl"] or 1.0, k, k1, b, tf)


def lexical_window(scores: DataFrame, n: int) -> DataFrame:
    """Top ``n`` by score, with whether they are all matches."""
    w = Window.partitionBy("queryId")
    top = _top(scores.drop("rank"), n + 1, [F.desc("score"), F.asc("id")])
    return top.withColumn("coverage", F.when(F.max("rank").over(w) > n, "TopMatches").otherwise("AllMatches")).where(F.col("rank") <= n)


def first_ranks(hits: DataFrame) -> DataFrame:
    """Each id's first place in its branch, renumbered without gaps."""
    first = hits.groupBy("queryId", "branch", "id").agg(F.min("rank").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("queryId", "branch").orderBy("at", "id"))).drop("at")


def rrf(hits: DataFrame, branches: list[str], limit: int) -> DataFrame:
    """Reciprocal-rank fusion of ``(queryId, branch, id, rank)``; ties by branch places, missing ones last."""
    placed = first_ranks(hits)
    places = [F.min(F.when(F.col("branch") == x, F.col("place"))).alias(f"{x}Rank") for x in branches]
    fused = placed.groupBy("queryId", "id").agg(F.sum(1.0 / (RRF + F.col("place"))).alias("score"), *places)
    order = [F.desc("score"), *[F.asc_nulls_last(f"{x}Rank") for x in branches], F.asc("id")]
    return _top(fused, limit, order)


def hybrid(branches: dict[str, DataFrame | None], limit: int) -> DataFrame:
    """Fuse named branches of ``(queryId, id, rank)``; a branch that failed (None) fails the fusion."""
    if failed := [n for n, df in branches.items() if df is None]:
        raise ValueError(f"branches failed: {', '.join(failed)}")
    union = None
    for name, df in branches.items():
        one = df.select("queryId", F.lit(name).alias("branch"), "id", "rank")
        union = one if union is None else union.unionByName(one)
    return rrf(union, list(branches), limit)


def hybrid_jobs(vector: DataFrame | None, lexical_hits: DataFrame | None, limit: int) -> DataFrame:
    return hybrid({"vector": vector, "lexical": lexical_hits}, limit)


def hybrid_candidates(job_vector: DataFrame | None, query_vector: DataFrame | None, lexical_hits: DataFrame | None, limit: int) -> DataFrame:
    return hybrid({"job": job_vector, "query": query_vector, "lexical": lexical_hits}, limit)


def score_fusion(hits: DataFrame, n_branches: int, limit: int) -> DataFrame:
    """Mean of sigmoid-normalised scores over all branches; an absent branch counts 0."""
    fused = hits.groupBy("queryId", "id").agg((F.sum(1 / (1 + F.exp(-F.col("score")))) / n_branches).alias("score"))
    return _top(fused, limit, [F.desc("score"), F.asc("id")])


def rank_fusion(hits: DataFrame, n_branches: int, limit: int) -> DataFrame:
    """Equally weighted reciprocal ranks."""
    fused = first_ranks(hits).groupBy("queryId", "id").agg((F.sum(1.0 / (RRF + F.col("place"))) / n_branches).alias("score"))
    return _top(fused, limit, [F.desc("score"), F.asc("id")])


def skill_evidence(hits: DataFrame) -> DataFrame:
    """Covered and required canonical skills of ``(viewerSkills, targetSkills)``; null where none is covered."""
    need, have = canonical_set("targetSkills"), canonical_set("viewerSkills")
    covered = F.size(F.array_intersect(need, have))
    return hits.withColumn("covered", F.when(covered > 0, covered)).withColumn("required", F.when(covered > 0, F.size(need)))


def skill_evidence_rank(hits: DataFrame, limit: int) -> DataFrame:
    """Retrieval places fused with competition ranks of exact covered/required ratios; without evidence, retrieval order.

    Ratios are compared as doubles: equal ones divide to equal doubles, and two of denominators up to
    n that differ do so by 1/n^2 at least, far above a double's rounding.
    """
    rows = skill_evidence(hits).withColumn("ratio", F.col("covered") / F.col("required"))
    ranked = rows.withColumn("evidenceRank", F.when(F.col("ratio").isNotNull(), F.rank().over(Window.partitionBy("queryId").orderBy(F.desc_nulls_last("ratio")))))
    score = 1.0 / (RRF + F.col("retrievalRank")) + F.coalesce(1.0 / (RRF + F.col("evidenceRank")), F.lit(0.0))
    scored = ranked.withColumnRenamed("rank", "retrievalRank").withColumn("score", score)
    return _top(scored, limit, [F.desc("score"), F.asc("retrievalRank"), F.asc("id")])


def ranking_violations(hits: DataFrame, most: int) -> DataFrame:
    """Queries whose hits are too many, repeated, of a place under one, or without an id."""
    checks = hits.groupBy("queryId").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("rank").alias("low"), F.count(F.when(F.length(F.trim(F.coalesce(F.col("id").cast("string"), F.lit("")))) == 0, 1)).alias("blank"))
    reasons = F.array_compact(F.array(F.when(F.col("n") > most, "TOO_MANY"), F.when(F.col("ids") + F.when(F.col("blank") > 0, 1).otherwise(0) < F.col("n"), "DUPLICATE_ID"), F.when(F.col("low") < 1, "NON_POSITIVE_RANK"), F.when(F.col("blank") > 0, "BLANK_ID")))
    return checks.select("queryId", reasons.alias("reasons")).where(F.size("reasons") > 0)


def fit_reasons(hits: DataFrame) -> DataFrame:
    """Target skills that the viewer has, and lacks."""
    need, have = canonical_set("targetSkills"), canonical_set("viewerSkills")
    return hits.withColumn("matched", F.array_intersect(need, have)).withColumn("missing", F.array_except(need, have))


def similar_items(items: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Nearest other items of each source item."""
    queries = sources.select(F.col("id").alias("queryId"), F.col("embedding").alias("queryVector"))
    near = knn(items, queries, k + 1).where("id <> queryId")
    return _top(near.drop("rank"), k, [F.desc("score"), F.asc("id")])


def recommend(items: DataFrame, people: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Nearest items of each person's vector."""
    return knn(items, people.select(F.col("id").alias("queryId"), F.col("embedding").alias("queryVector")), k, where)


def search_or_fallback(queries: DataFrame, vector: DataFrame, lexical_hits: DataFrame) -> DataFrame:
    """Vector hits where the query has a vector that found some; else lexical ones, labelled degraded."""
    served = vector.select("queryId").distinct()
    good = vector.select("queryId", "id", "rank").withColumn("degraded", F.lit(False))
    rest = lexical_hits.join(served, "queryId", "left_anti").select("queryId", "id", "rank").withColumn("degraded", F.lit(True))
    return good.unionByName(rest).join(queries.select("queryId"), "queryId", "left_semi")


def revalidate_hits(hits: DataFrame, current: DataFrame) -> DataFrame:
    """Hits whose entity is still eligible with the same source; order kept, first occurrence counts."""
    live = current.select("id", F.col("sourceHash").alias("nowHash"))
    ok = hits.join(live, "id").where("sourceHash = nowHash").drop("nowHash")
    first = ok.withColumn("n", F.row_number().over(Window.partitionBy("queryId", "id").orderBy("rank"))).where("n = 1").drop("n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("queryId").orderBy("rank", "id")))


def _lines(*parts: Column) -> Column:
    """The parts as lines, without blanks and control characters around the whole."""
    return F.regexp_replace(F.concat_ws("\n", *parts), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _sorted_terms(name: str) -> Column:
    """A set of terms as they are written, in order; null is the empty set."""
    return F.array_join(F.array_sort(F.array_distinct(F.coalesce(name, F.array().cast("array<string>")))), ", ")


def searchable_text_job(df: DataFrame) -> DataFrame:
    """Title, description, requirements a line each, and skills, as one text."""
    empty = F.array().cast("array<string>")
    requirements = F.array_join(F.coalesce("requirements", empty), "\n")
    return df.withColumn("text", _lines(F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.lit("Requirements:"), requirements, F.lit("Skills:"), _sorted_terms("skills")))


def searchable_text_candidate(df: DataFrame) -> DataFrame:
    """Experience summary and skills as one text; what is empty has no line."""
    given = lambda c: F.when(F.length(c) > 0, c)
    return df.withColumn("text", _lines(given(F.col("experienceSummary")), F.lit("Skills:"), given(_sorted_terms("skills"))))


def source_hash(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("sourceHash", F.sha2(column, 256))


def embedding_work(df: DataFrame, model: str) -> DataFrame:
    """What to embed: nothing (no text, or its embedding is current), too long a document, or the prepared text.

    A current embedding comes before the size. Sizes are UTF-16 units.
    """
    current = F.col("text").isNull() | ((F.col("storedHash") == F.col("sourceHash")) & (F.col("storedModel") == model))
    units = F.octet_length(F.encode("text", "UTF-16BE")) / 2
    return df.withColumn("work", F.when(F.coalesce(current, F.lit(False)), "NoWork").when(units > MAX_TEXT, "DocumentTooLarge").otherwise("Prepared"))
