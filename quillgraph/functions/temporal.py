"""Time in scores: coverage of a query's window, decay and authority of age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig


def in_window(published: Column, start: Column, end: Column, date_from: str | None, date_to: str | None, strict: bool = True) -> Column:
    """Whether a document may lie in a window; dates and bounds are compared as strings.

    Each bound is tested on its own: the publication date or the end of the coverage against the lower one, the
    publication date or the start of the coverage against the upper one. Undated rows pass unless strict.
    """
    undated = F.lit(False) if strict else published.isNull() & start.isNull() & end.isNull()
    holds = lambda *tests: undated | F.coalesce(tests[0], F.lit(False)) | F.coalesce(tests[1], F.lit(False))
    low = F.lit(True) if date_from is None else holds(published >= F.lit(date_from), end >= F.lit(date_from))
    high = F.lit(True) if date_to is None else holds(published <= F.lit(date_to), start <= F.lit(date_to))
    return low & high


def coverage(doc_from: Column, doc_to: Column, published: Column, query_from: Column, query_to: Column) -> Column:
    """Share of the query's window that a document covers (dates); open ends reach to the years 1000 and 3000."""
    early, late = F.to_date(F.lit("1000-01-01")), F.to_date(F.lit("3000-01-01"))
    a, b = F.coalesce(doc_from, published), F.coalesce(doc_to, published)
    known = (a.isNotNull() | b.isNotNull()) & (query_from.isNotNull() | query_to.isNotNull())
    a, b = F.coalesce(a, early), F.coalesce(b, late)
    c, d = F.coalesce(query_from, early), F.coalesce(query_to, late)
    overlap, span = F.datediff(F.least(b, d), F.greatest(a, c)), F.greatest(F.datediff(d, c), F.lit(1))
    return F.when(known & (b >= c) & (a <= d), F.least(overlap / span, F.lit(1.0))).otherwise(F.lit(0.0))


def decay_rate(decay_class: Column, config: EngineConfig = DEFAULT) -> Column:
    """Rate of a class; unknown ones decay as scholarly texts."""
    rate = F.lit(config.decay_rates["SCHOLARLY"])
    for name, value in config.decay_rates.items():
        rate = F.when(decay_class == name, F.lit(value)).otherwise(rate)
    return rate


def temporal_score(
    intent: Column, principal: Column, raw_bm25: Column, decay_class: Column, published: Column, covered: Column, as_of: Column, config: EngineConfig = DEFAULT
) -> Column:
    """What time adds to a fused score; five layers keep strong results out of it."""
    days = F.datediff(as_of, published)
    age = F.when(days >= 0, 1 - F.exp(-F.lit(config.age_lambda) * days)).otherwise(F.lit(0.0))
    past = F.when(covered > 0, 0.7 * covered + 0.3 * age).otherwise(age)
    now = F.when(published.isNull(), 0.5 * covered).when(days < 0, F.lit(0.0)).otherwise(F.exp(-decay_rate(decay_class, config) * days) + 0.3 * covered)
    immune = (F.coalesce(intent, F.lit("none")) == "none") | F.coalesce(principal, F.lit(False)) | (F.coalesce(raw_bm25, F.lit(0.0)) > config.gate_floor)
    return F.when(immune, F.lit(0.0)).otherwise(F.lit(config.temporal_weight) * F.when(intent == "historical_fact", past).otherwise(now))
