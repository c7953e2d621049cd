"""Subjects: keyed tokens, deletion markers, and audits of stored tokens and keys."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..specs import SUBJECT_TABLES, TABLES

_VERIFIER_LABEL = b"subject-key-verifier"


def token(key_id: str, key: bytes, subject: str) -> str:
    """``keyId_`` and the unpadded base64url HMAC-SHA256 of the subject's id."""
    return f"{key_id}_{base64.urlsafe_b64encode(hmac.new(key, subject.encode(), hashlib.sha256).digest()).rstrip(b'=').decode()}"


def key_verifier(key: bytes) -> str:
    """Tells a key without revealing it: its HMAC of a fixed label."""
    return base64.urlsafe_b64encode(hmac.new(key, _VERIFIER_LABEL, hashlib.sha256).digest()).rstrip(b"=").decode()


def _tokenizer(df: DataFrame, keys: dict[str, bytes]):
    """A vectorised UDF; the keys travel by broadcast, so plans and logs never hold them."""
    shared = df.sparkSession.sparkContext.broadcast(keys)

    @F.pandas_udf(StringType())
    def run(key_id: pd.Series, subject: pd.Series) -> pd.Series:
        held, seen = shared.value, {}

        def one(k: str, s: str | None) -> str | None:
            if not s:
                return None
            if (k, s) not in seen:
                seen[k, s] = token(k, held[k], s)
            return seen[k, s]

        return pd.Series([one(k, s) for k, s in zip(key_id, subject)], dtype=object)

    return run


def _row_tokenizer(df: DataFrame, key_id: str, key: bytes):
    """The same for arrays of ids under one key; a batch's repeated ids are hashed once."""
    shared = df.sparkSession.sparkContext.broadcast(key)

    @F.pandas_udf(ArrayType(StringType()))
    def run(subjects: pd.Series) -> pd.Series:
        held, seen = shared.value, {}

        def one(s: str) -> str:
            if s not in seen:
                seen[s] = token(key_id, held, s)
            return seen[s]

        return pd.Series([[one(s) for s in ids] for ids in subjects], dtype=object)

    return run


def subject_ids() -> Column:
    """Candidate first, then actor, then the candidates that a candidate search returned; distinct, in order."""
    found = F.when((F.col("eventType") == "SEARCH_PERFORMED") & (F.col("payload.searchKind") == "candidateMatches"), F.transform("payload.results", lambda r: F.lower(r["resultId"])))
    all_ids = F.concat(F.array(F.lower("payload.candidateId"), F.col("actorId")), F.coalesce(found, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(all_ids, lambda s: s.isNotNull() & (s != "")))


def with_subject_tokens(df: DataFrame, key_id: str, key: bytes) -> DataFrame:
    """``subjectToken`` (candidate before actor) and ``subjectTokens`` under the primary key.

    A row's ids are tokenised where the row is, so nothing is shuffled.
    """
    return df.withColumn("subjectTokens", _row_tokenizer(df, key_id, key)(subject_ids())).withColumn("subjectToken", F.get("subjectTokens", F.lit(0)))


def marker_tokens(subjects: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """Tokens of ``subjectId`` under every configured key, as deletion markers."""
    each = subjects.select("subjectId", F.explode(F.array(*map(F.lit, keys))).alias("keyId"))
    return each.select(_tokenizer(subjects, keys)("keyId", "subjectId").alias("subjectToken")).where("subjectToken is not null").distinct()


def matched_by_subject(df: DataFrame, markers: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows any of whose tokens is marked: exploded tokens meet the markers in an equi-join."""
    hit = df.select(*key, F.explode("subjectTokens").alias("subjectToken")).join(markers.select("subjectToken").distinct(), "subjectToken", "left_semi").select(*key).distinct()
    return df.join(hit, _same(df, hit, key), "left_semi")


def exclude_markers(df: DataFrame, markers: DataFrame, key: tuple[str, ...] | None = None) -> DataFrame:
    """Rows none of whose tokens is marked; keyed by the Kafka coordinate, else the event id, null-safely."""
    key = key or (("topic", "partition", "offset") if {"topic", "partition", "offset"} <= set(df.columns) else ("eventId",))
    hit = df.select(*key, F.explode("subjectTokens").alias("subjectToken")).join(markers.select("subjectToken").distinct(), "subjectToken", "left_semi").select(*key).distinct()
    return df.join(hit, _same(df, hit, key), "left_anti")


def _same(left: DataFrame, right: DataFrame, key: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & left[k].eqNullSafe(right[k])
    return out


def without_marked_applications(df: DataFrame, markers: DataFrame) -> DataFrame:
    """If any event of an application is marked, none of its events stay."""
    marked = df.where("applicationId is not null").select("applicationId", F.explode("subjectTokens").alias("subjectToken")).join(markers.select("subjectToken").distinct(), "subjectToken", "left_semi")
    return df.join(marked.select("applicationId").distinct(), "applicationId", "left_anti")


def purge_marked(df: DataFrame, markers: DataFrame, key: tuple[str, ...], event_table: bool = True) -> DataFrame:
    """The table without marked rows; an event table also loses rows that no subject can be found for."""
    kept = exclude_markers(df, markers, key)
    return kept.where(F.size("subjectTokens") > 0) if event_table else kept


def count_marked(tables: dict[str, DataFrame], markers: DataFrame) -> DataFrame:
    """Marked rows by table, in one union."""
    out = None
    for name, df in tables.items():
        spec = TABLES.get(name)
        key = spec.key if spec else ("eventId",)
        one = matched_by_subject(df, markers, key).agg(F.count("*").alias("marked")).select(F.lit(name).alias("table"), "marked")
        out = one if out is None else out.unionByName(one)
    return out


def assert_absent(tables: dict[str, DataFrame], markers: DataFrame) -> None:
    """Raise if any table still holds a marked row."""
    left = [r["table"] for r in count_marked(tables, markers).where("marked > 0").collect()]
    if left:
        raise ValueError(f"marked rows remain in {', '.join(left)}")


def marked_files(df: DataFrame, markers: DataFrame, ownerless: bool = True) -> DataFrame:
    """Distinct files that hold marked rows or, if asked, rows without tokens: the evidence of an erasure is not cut short.

    ``df`` is a file-backed table.  Tokens are unfolded where they are read; one row a file leaves a task.
    """
    rows = df.select(F.col("_metadata.file_path").alias("file"), "subjectTokens")
    hit = rows.select("file", F.explode("subjectTokens").alias("subjectToken")).join(markers.select("subjectToken").distinct(), "subjectToken", "left_semi").select("file")
    return (hit.union(rows.where(F.size("subjectTokens") == 0).select("file")) if ownerless else hit).distinct()


def files_left(evidence: DataFrame, listed: DataFrame) -> DataFrame:
    """Of the files that an erasure named, those that a listing ``(path)`` still holds."""
    return evidence.join(listed.select(F.col("path").alias("file")).distinct(), "file", "left_semi")


def files_with_text(files: DataFrame, needle: str) -> DataFrame:
    """Paths of files ``(path, content)`` whose bytes hold ``needle``: in plain pages, or in the footer's statistics."""
    return files.where(F.instr(F.col("content").cast("string"), needle) > 0).select("path")


def find_text_reference(df: DataFrame, needle: str) -> DataFrame:
    """Rows any of whose columns holds ``needle`` in its JSON text."""
    return df.where(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).contains(needle))


def token_key_violations(tables: dict[str, DataFrame], key_id: str, at) -> DataFrame:
    """Tables whose unexpired rows hold a primary token of another key, the first of them by table order."""
    out = None
    for priority, (name, df) in enumerate(tables.items()):
        live = df.where(F.col("expiresAt") > F.lit(at)).where(~F.col("subjectToken").startswith(f"{key_id}_"))
        one = live.select(F.lit(priority).alias("priority"), F.lit(name).alias("table"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("priority", "table").agg(F.count("*").alias("rows"))


def invalid_tokens(tables: dict[str, DataFrame], key_ids: list[str]) -> DataFrame:
    """Stored tokens, scalar or in arrays, whose form or key id is unknown."""
    form = f"^({'|'.join(key_ids)})_[A-Za-z0-9_-]{{43}}$"
    out = None
    for name, df in tables.items():
        own = [F.col("subjectToken")] if "subjectToken" in df.columns else []
        tokens = df.select(F.explode(F.concat(F.array(*own) if own else F.array().cast("array<string>"), "subjectTokens")).alias("token"))
        one = tokens.where(F.col("token").isNull() | ~F.col("token").rlike(form)).select(F.lit(name).alias("table"), "token")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def reconcile_keys(registry: DataFrame, configured: DataFrame, stored: DataFrame) -> DataFrame:
    """Verdict by key id: registered keys that changed or went while in use, keys in use without anchor, new ones."""
    r = registry.select("keyId", F.col("verifier").alias("was"))
    c = configured.select("keyId", F.col("verifier").alias("now"))
    s = stored.select("keyId").distinct().withColumn("used", F.lit(True))
    joined = r.join(c, "keyId", "full").join(s, "keyId", "full")
    used = F.coalesce("used", F.lit(False))
    verdict = (
        F.when(F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now")), "CHANGED")
        .when(used & F.col("now").isNull(), "REMOVED")
        .when(used & F.col("was").isNull(), "UNANCHORED")
        .when(F.col("was").isNull(), "NEW")
        .when(F.col("now").isNull(), "RETIRED")
        .otherwise("UNCHANGED")
    )
    return joined.select("keyId", verdict.alias("verdict"))


def subject_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: tables[n] for n in SUBJECT_TABLES if n in tables}
