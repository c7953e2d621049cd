"""A corpus pipeline: quality rules, language, near duplicates, personal data, packing.

Each stage works on all that its predecessor kept, written as Parquet and read again; all but
the last return the columns of ``documents``.  Rows are judged, not ids: of two rows with one
id, one may go and the other stay.  In every stage an empty table gives an empty result, a
very long text is handled whole, and extra columns of any name are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import language, near_dup, packing, pii, quality
from eventloom.llm.common import crc_of_id, materialize
from eventloom.llm.queries import tokenizer_file

#: Below this share of its best language a text counts as in none.
LEAST_SCORE = 0.25
#: Hundredths of their five-word shingles that near duplicates share.
SIMILAR = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the current policy keeps, judged from the ledger's bits.

    A null or blank text has too few words and goes; repeated rows stay or go together.
    """
    return quality.apply_policy(quality.ledger(docs, carry=True)).where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the network knows.

    A null text, or one without a letter, is in none and goes; repeated rows stay or go together.
    """
    found = language.identify(docs, crc_of_id(docs, 4) == 2, carry=True)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the least id (then text hash), once.

    Null and blank texts duplicate nothing but rows equal to them in id and text.
    """
    return near_dup.keep_one(docs, SIMILAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with personal data replaced by its kind, and their new lengths.

    A null text stays null; repeated rows are masked each.
    """
    masked = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens.

    A null or empty text is one piece, the end token; repeated rows are packed each.
    """
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The trained and iterative stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
