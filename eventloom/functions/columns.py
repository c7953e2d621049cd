"""Column functions: canonical terms, hashes, distances, vector similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def canonical(col: Column | str) -> Column:
    """Trimmed, lower-cased term."""
    return F.lower(F.trim(col))


def canonical_set(col: Column | str) -> Column:
    """Distinct canonical terms in order, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(col, canonical), lambda t: F.length(t) > 0)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def utc_day(ts: Column | str) -> Column:
    return F.to_date(ts)


def hours_between(start: Column | str, stop: Column | str) -> Column:
    """Exact microsecond difference in hours."""
    return (F.unix_micros(stop) - F.unix_micros(start)) / F.lit(3.6e9)


def length_prefixed(parts: list[Column]) -> Column:
    """Fields joined so that no two different lists give one string."""
    return F.concat(*[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts])


def nearest_rank(name: str, p: float) -> Column:
    """The exact, not interpolated, percentile of column ``name`` in a group."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {name})")


def set_digest(value: Column | str) -> Column:
    """An aggregate that names a multiset of texts in no order: SHA-256 over their number and the sums of their SHA-256 in lanes of 48 bits.

    Sums combine map-side and in any order; a sum has room for 2^51 texts.
    Nulls count as their own text.
    """
    digest = F.sha2(F.coalesce(F.concat(F.lit("="), value), F.lit("-")), 256)
    lanes = [F.coalesce(F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in range(1, 61, 12)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *lanes), 256)


def set_digest_sql(value: str) -> str:
    """The same in DuckDB, of a text without nulls."""
    lane = lambda at: f"cast(coalesce(sum(cast(('0x' || substr(sha256('=' || {value}), {at}, 12)) AS bigint)), 0) AS varchar)"
    return "sha256(cast(count(*) AS varchar) || ':' || " + " || ':' || ".join(lane(at) for at in range(1, 61, 12)) + ")"
