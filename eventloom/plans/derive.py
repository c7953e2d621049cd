"""Frames that the queries derive from the driver's tables, and the same derivations in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVED = datetime(2024, 1, 20, 12)
WATERMARK = datetime(2024, 1, 10)
STATUS_OF = {"view": "Accepted", "click": "Interview", "purchase": "Hired", "error": "Rejected"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; zoneless timestamps become UTC ones."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in df.schema])


#: Rows that a task of a dealt table gets, about: its sorts and aggregates take some 200 MB.
ROWS_PER_TASK = 250_000


def tasks_for(df: DataFrame) -> int:
    """As many tasks as the counted rows need, whatever the session's number is; a table's count reads footers alone."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))


def dealt(df: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """``df`` dealt once by a key; what follows by that key, alone or with others, shuffles no more."""
    return df.repartition(tasks or tasks_for(df), key)


def facts(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """Events as lifecycle facts: one application per event, or per user."""
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])[F.col("event_type")]
    subject = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    return e.select(
        F.col("event_id").cast("string").alias("eventId"),
        F.when(F.col("event_type") == "signup", "APPLICATION_CREATED").otherwise("APPLICATION_STATUS_CHANGED").alias("eventType"),
        F.col("ts").alias("occurredAt"),
        F.concat(F.lit("a"), F.col("user_id" if by_user else "event_id").cast("string")).alias("applicationId"),
        status.alias("newStatus"),
        F.lit(None).cast("array<string>").alias("jobSkills"),
        subject.alias("subjectToken"),
        F.array(subject).alias("subjectTokens"),
        F.lit("t").alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("eventFingerprint"),
    )


FACTS = """facts AS (
  SELECT cast(event_id AS varchar) AS "eventId", event_id, user_id, event_type, ts,
    CASE WHEN event_type = 'signup' THEN 'APPLICATION_CREATED' ELSE 'APPLICATION_STATUS_CHANGED' END AS "eventType",
    CASE event_type WHEN 'view' THEN 'Accepted' WHEN 'click' THEN 'Interview' WHEN 'purchase' THEN 'Hired' WHEN 'error' THEN 'Rejected' END AS "newStatus",
    cast(ts AS date) AS day, 'a' || event_id AS app, 's' || user_id AS subj,
    sha256(event_id || '|' || event_type) AS fp
  FROM events)"""


def posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as job postings: the part's type words are skills, the supplier is the subject."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    subject = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("eventId"),
        F.lit("JOB_CREATED").alias("eventType"),
        F.date_trunc("month", "l_shipdate").alias("occurredAt"),
        F.split("p_type", " ").alias("jobSkills"),
        subject.alias("subjectToken"),
        F.array(subject).alias("subjectTokens"),
    )


POSTED = """posted AS (
  SELECT l_orderkey || '-' || l_linenumber AS id, cast(date_trunc('month', l_shipdate) AS date) AS day, lower(trim(unnest(string_split(p_type, ' ')))) AS skill, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def order_stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as applications: ordered is created, the lines' ship dates are the later stages."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    line = lambda n: F.min(F.when(F.col("l_linenumber") == n, F.col("l_shipdate")))
    ships = li.groupBy("l_orderkey").agg(line(1).alias("acceptedAt"), line(2).alias("interviewAt"), line(3).alias("hiredAt"), line(4).alias("rejectedAt"))
    return o.join(ships, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("applicationId"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("subjectToken"), F.col("o_orderdate").alias("createdAt"), "acceptedAt", "interviewAt", "hiredAt", "rejectedAt"
    )


STAGES = """ships AS (
  SELECT l_orderkey, min(CASE WHEN l_linenumber = 1 THEN l_shipdate END) AS accepted, min(CASE WHEN l_linenumber = 2 THEN l_shipdate END) AS interview, min(CASE WHEN l_linenumber = 3 THEN l_shipdate END) AS hired
  FROM lineitem GROUP BY 1), st AS (
  SELECT o_orderkey, o_custkey AS subj, o_orderdate AS created, accepted, interview, hired FROM orders JOIN ships ON o_orderkey = l_orderkey)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as jobs."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), (k % 7).alias("recruiterId"), F.col("p_name").alias("title"), F.col("p_name").alias("description"), F.array("p_brand").alias("requirements"),
        F.split("p_type", " ").alias("skills"), F.col("p_brand").alias("country"), F.concat(F.lit(" City"), (F.col("p_size") % 10).cast("string")).alias("city"),
        (F.col("p_size") % 5 == 0).alias("remote"), ((k * 7919 % 18000) / 100.0 - 90).alias("lat"), ((k * 104729 % 36000) / 100.0 - 180).alias("lon"),
        F.when(k % 4 == 0, "Closed").otherwise("Open").alias("status"), F.timestamp_seconds(F.lit(1704067200) + k * 60).alias("createdAt"),
    )


JOBS = """jobs AS (
  SELECT p_partkey AS id, p_partkey % 7 AS recruiter, p_name AS title, string_split(p_type, ' ') AS skills, list_sort(list_distinct(list_transform(string_split(p_type, ' '), lambda s: lower(trim(s))))) AS canon, p_brand AS country, ' City' || (p_size % 10) AS city,
    p_size % 5 = 0 AS remote, (p_partkey * 7919 % 18000) / 100.0 - 90 AS lat, (p_partkey * 104729 % 36000) / 100.0 - 180 AS lon,
    CASE WHEN p_partkey % 4 = 0 THEN 'Closed' ELSE 'Open' END AS status, 1704067200 + p_partkey * 60 AS created_s
  FROM part)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"), F.lit("Candidate").alias("role"), F.when(k % 11 == 0, "Deleted").otherwise("Active").alias("accountStatus"),
        F.array(F.lower("c_mktsegment"), F.concat(F.lit("s"), (k % 5).cast("string"))).alias("skills"), F.col("n_name").alias("country"),
        F.concat(F.lit("City"), (k % 10).cast("string")).alias("city"), F.when(k % 2 == 0, "Available").otherwise("Busy").alias("availabilityStatus"),
        F.when(k % 3 != 2, k % 3 == 0).alias("recruiterSearchOptIn"), F.timestamp_seconds(F.lit(1704067200) + k).alias("deletionRequestedAt"),
    )


USERS = """users AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'Deleted' ELSE 'Active' END AS account, [lower(c_mktsegment), 's' || (c_custkey % 5)] AS skills, n_name AS country,
    'City' || (c_custkey % 10) AS city, CASE WHEN c_custkey % 2 = 0 THEN 'Available' ELSE 'Busy' END AS availability, CASE WHEN c_custkey % 3 <> 2 THEN c_custkey % 3 = 0 END AS opt
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

APPLICATION_STATUSES = ("Created", "Accepted", "Declined", "Interview", "Hired", "Rejected")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as applications to jobs."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("candidateId"), (k % 200 + 1).alias("jobId"), F.element_at(F.array(*map(F.lit, APPLICATION_STATUSES)), (k % 6 + 1).cast("int")).alias("status"), F.col("o_orderdate").alias("createdAt"))


APPLICATIONS = """apps AS (
  SELECT o_orderkey AS id, o_custkey AS candidate, o_orderkey % 200 + 1 AS job, ['Created','Accepted','Declined','Interview','Hired','Rejected'][o_orderkey % 6 + 1] AS status, o_orderdate AS created
  FROM orders)"""


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as Kafka records: JSON envelopes with faults by the id's remainder.

    Of 40: 0 lacks the payload, 1 is a tombstone, 2 has no zone in its time, 3 an unknown type,
    4 is doubled at another offset with another payload, 5 repeats a key.
    """
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    uuid = lambda n: F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))
    kind = F.when(k % 40 == 3, "NO_SUCH_EVENT").otherwise("APPLICATION_CREATED")
    zone = F.when(k % 40 == 2, "").otherwise("Z")
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)

    def body(job) -> object:
        return F.to_json(F.struct(uuid(k).alias("applicationId"), uuid(F.col("user_id")).alias("candidateId"), uuid(job).alias("jobId"), F.lit("Created").alias("status")))

    def value(job):
        head = F.concat(F.lit('{"eventId":"'), uuid(k), F.lit('","eventType":"'), kind, F.lit('","occurredAt":"'), time, F.lit('","aggregateType":"Application","aggregateId":"'), uuid(k), F.lit('","actorId":"'), uuid(F.col("user_id")), F.lit('"'))
        payload = F.when(k % 40 == 0, "").otherwise(F.concat(F.lit(',"payload":'), body(job)))
        again = F.when(k % 40 == 5, ',"eventType":"APPLICATION_CREATED"').otherwise("")
        return F.when(k % 40 != 1, F.concat(head, again, payload, F.lit("}")).cast("binary"))

    one = e.select(F.lit("t").alias("topic"), (k % 3).cast("int").alias("partition"), k.alias("offset"), value(k % 9).alias("value"), F.col("ts").alias("timestamp"))
    two = e.where(k % 40 == 4).select(F.lit("t").alias("topic"), (k % 3).cast("int").alias("partition"), (k + 10_000_000).alias("offset"), value(k % 9 + 1).alias("value"), F.col("ts").alias("timestamp"))
    return one.unionByName(two)


ENVELOPES = """recs AS (
  SELECT event_id, event_id % 3 AS partition, event_id AS "offset", event_id % 40 AS r, user_id, ts FROM events
  UNION ALL SELECT event_id, event_id % 3, event_id + 10000000, 4, user_id, ts FROM events WHERE event_id % 40 = 4)"""


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 17th user is marked for deletion."""
    return table(spark, sf_dir, "events").where("user_id % 17 = 0").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("subjectToken")).distinct()
