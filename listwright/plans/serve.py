"""Serving: facet index, exports and search over the stored tiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.operators import serving
from listwright.plans.scan import State
from listwright.rules.ruleset import RuleSet

C = F.col


def published(state: State, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """``(verified, possible)`` as shown, stale possible rows dropped."""
    verified = state.open.unionByName(state.recent)
    return verified, serving.refilter_possible(state.possible, verified, rules)


def facet_index(state: State, rules: RuleSet, now: Column) -> DataFrame:
    verified, possible = published(state, rules)
    return serving.facet_projection(verified, now, F.lit("verified")).unionByName(
        serving.facet_projection(possible, now, F.lit("possible"))
    )


def find(
    index: DataFrame,
    query: str = "",
    company: str = "",
    filters: Mapping[str, str] | None = None,
    quick: Sequence[str] = (),
    mode: str = "newest",
    limit: int = 100,
) -> DataFrame:
    """Best ``limit`` rows: filter, score, top-k without a global sort."""
    found = serving.search_rows(index, query, company, filters, quick)
    return serving.rank(found, mode, [F.asc("id")]).limit(max(0, limit))
