"""All registered queries of the library proper, and the SQL that checks them."""

from __future__ import annotations

from ..operators import reports
from . import derive, queries_events, queries_search


def flagship(spark, sf_dir: str):
    """The daily funnel; the smallest tables have few subjects a day, so two suffice here."""
    return reports.wide_funnel_day(derive.facts(spark, sf_dir), k=2)


def queries() -> dict:
    return {**queries_events.Q, **queries_search.Q}


def oracle_sql() -> dict[str, str]:
    return {**queries_events.SQL, **queries_search.SQL}
