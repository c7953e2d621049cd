"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document.  The ledger keeps its measurements and one bit per
failed rule; policies are masks over those bits, so a new policy version, or an ablation, is
bitwise arithmetic over the stored ledger and never reads a text again.

Nulls count as texts without words; repeated rows are measured each; an empty table gives an
empty ledger; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 5
_BLANKS = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]+"

#: Rule bits in order (fixed values): name, and the condition that fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines",
    "shouting": "n_words >= 10 and 100 * n_upper > 60 * word_chars",
    "exclamations": "100 * n_exclaim > 50 * n_words",
    "long_words": "n_words >= 10 and word_chars > 25 * n_words",
    "short_words": "n_words >= 10 and word_chars < 2 * n_words",
}
#: Policy versions: the rules that reject a document under each.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "2024-1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "2024-2": tuple(RULES),
}
CURRENT = "2024-2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    """The policy's rules as bits."""
    return sum(map(bit, POLICIES[policy]))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _covered(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more, from the sorted windows."""

    def from_sorted(runs: Column) -> Column:
        same = lambda i, j: F.get(runs, i)["w"] == F.get(runs, j)["w"]
        twice = F.filter(runs, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return _bound(F.sort_array(F.transform(twice, lambda x: x["i"])), from_starts)

    def from_starts(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, WINDOW)).alias("w"), i.alias("i")),
    )
    return _bound(F.sort_array(windows), from_sorted)


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id`` and the measurements that the rules need; with ``carry`` the whole row too, as ``row``."""
    row = [F.struct(docs["*"]).alias("row")] if carry else []
    kept = ["row"] if carry else []
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    cut = docs.select(*row, docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).withColumn("words", F.array_remove(F.split("text", _BLANKS), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    chars = F.length("text")
    cut = cut.select(
        *kept,
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (chars - F.length(F.regexp_replace("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (chars - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_upper"),
        (chars - F.length(F.regexp_replace("text", "!+", ""))).cast("long").alias("n_exclaim"),
        lines.alias("lines"),
        F.when(F.size("words") >= WINDOW, grams).alias("grams"),
    )
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    return cut.select(
        *kept,
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_upper",
        "n_exclaim",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, _covered(F.col("words"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Measurements plus ``failures``, one bit per failed rule, stored in the shared folder.

    Being stored, it is evaluated once whatever policies, filters and ablations follow.  With
    ``carry`` each entry holds its document as the struct ``row``, so that rows are judged
    without a join.
    """
    failed = F.lit(0)
    for rule, condition in RULES.items():
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(bit(rule))).otherwise(F.lit(0)))
    return materialize(measure(docs, carry).withColumn("failures", failed))


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``base_failed`` and ``kept`` from a ledger's bits alone."""
    failures = F.col("failures")
    base_failed = failures.bitwiseAND(F.lit(mask("base"))) != 0
    return rows.withColumns({"base_failed": base_failed, "kept": ~base_failed & (failures.bitwiseAND(F.lit(mask(policy))) == 0)})


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and that it alone rejects, by bitwise sums in one pass."""
    failures, whole = F.col("failures"), mask(policy)
    sums = rows.agg(
        F.count("*").alias("n"),
        *[F.sum(F.getbit(failures, F.lit(list(RULES).index(r))).cast("long")).alias(f"fails_{r}") for r in POLICIES[policy]],
        *[F.count(F.when(failures.bitwiseAND(F.lit(whole)) == bit(r), 1)).alias(f"only_{r}") for r in POLICIES[policy]],
    )
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(f"fails_{r}", F.lit(0)).alias("n_failed"), F.col(f"only_{r}").alias("n_only")) for r in POLICIES[policy]]))
    return sums.select(F.col("n").alias("n_docs"), rule.alias("r")).select("n_docs", "r.rule", "r.n_failed", "r.n_only")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(replace(text, '!', '')) AS n_exclaim,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 30 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)
         OR 100 * n_upper > 60 * word_chars OR 100 * n_exclaim > 50 * n_words
         OR word_chars > 25 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""
