"""Facets, counters, ranked search, expected programmes and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import dates, search, text
from listwright.operators.classify import is_public, with_possible
from listwright.operators.ordered import pick_first
from listwright.rules.ruleset import RuleSet
from listwright.schema import EVIDENCE_RANK
from listwright.session import shuffled

C = F.col
FAR = "9999-12-31"


def evidence_rank() -> Column:
    out = F.lit(0)
    for status, rank in EVIDENCE_RANK.items():
        out = F.when(C("eligibility_status") == status, F.lit(rank)).otherwise(out)
    return out


def facet_projection(records: DataFrame, now: Column, tier: Column) -> DataFrame:
    """Flat display and filter columns of a record."""
    filled = lambda name: F.nullif(C(name), F.lit(""))
    return records.select(
        "id",
        "title",
        F.concat_ws(
            " ",
            filled("title"), filled("canonical_employer"), filled("division"), filled("description_excerpt"),
            filled("primary_category"), F.nullif(F.array_join("secondary_tags", " "), F.lit("")),
            filled("programme_type"), filled("organisation_type"), filled("location"),
        ).alias("search"),
        C("primary_category").alias("category"),
        F.array_join("secondary_tags", "|").alias("tags"),
        C("canonical_employer").alias("employer"),
        C("organisation_type").alias("organisation"),
        C("programme_type").alias("programme"),
        C("eligibility_status").alias("eligibility"),
        C("relevance_status").alias("relevance"),
        "location",
        C("geographic_scope").alias("geography"),
        F.when(C("paid"), "paid").otherwise("unknown").alias("paid"),
        "status",
        C("cycle_provenance").alias("cycle"),
        C("source_authority").alias("authority"),
        F.when(F.size("nationality_requirements") > 0, "required").otherwise("not-stated").alias("nationality"),
        C("employer_quality_tier").alias("tier"),
        tier.alias("listing"),
        dates.is_new(C("first_seen_at"), now).alias("new"),
        dates.is_closing(C("deadline"), now).alias("closing"),
        C("match_score").alias("score"),
        evidence_rank().alias("evidence"),
        F.coalesce(C("deadline").cast("string"), F.lit(FAR)).alias("deadline"),
        F.coalesce(C("opening_date").cast("string"), F.lit(FAR)).alias("opening"),
        C("first_seen_at").alias("first_seen"),
    )


def facet_values(df: DataFrame, column: str, labeler=text.label) -> DataFrame:
    """Distinct non-empty values of a scalar or list column with labels and counts, in order."""
    is_list = df.schema[column].dataType.typeName() == "array"
    item = F.explode(F.array_distinct(column)) if is_list else C(column).cast("string")
    return (
        df.select(item.alias("value"))
        .filter("value <> ''")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("label", labeler(C("value")))
        .orderBy("value")
    )


def facet_table(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``(facet, value, rows)`` of several facets in one pass over the table."""
    parts = []
    for name, column in columns.items():
        is_list = df.schema[column].dataType.typeName() == "array"
        values = F.array_distinct(column) if is_list else F.array(C(column).cast("string"))
        parts.append(F.transform(values, _tagged(name)))
    items = df.select(F.explode(F.concat(*parts)).alias("i")).select("i.facet", "i.value")
    return items.filter("value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("rows"))


def _tagged(name: str):
    return lambda value: F.struct(F.lit(name).alias("facet"), value.alias("value"))


def counters(records: DataFrame, now: Column) -> DataFrame:
    """One row of dashboard counters."""
    today = F.to_date(now)
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    category = F.lower("primary_category")
    policy = ("policy_research_internship", "parliamentary_office_internship")
    development = ("development_humanitarian_internship", "international_institution_internship")
    return records.agg(
        F.count(F.lit(1)).alias("listed"),
        count(C("status") == "open").alias("open_now"),
        count(C("first_seen_at") >= now - F.expr("INTERVAL 24 HOURS")).alias("new_day"),
        count(C("first_seen_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("new_week"),
        count(C("deadline").between(today, F.date_add(today, 7))).alias("closing_week"),
        count(C("programme_type") == "summer_internship_2027").alias("summer"),
        count(F.contains("programme_type", F.lit("vacation_scheme"))).alias("vacation"),
        count(C("programme_type").isin(*policy)).alias("policy"),
        count(
            F.contains(category, F.lit("climate")) | F.contains(category, F.lit("environment")) | F.contains(category, F.lit("esg"))
        ).alias("environment"),
        count(C("programme_type").isin(*development)).alias("development"),
    )


def by_programme(records: DataFrame) -> DataFrame:
    return records.groupBy("programme_type").agg(F.count(F.lit(1)).alias("rows"))


def scan_metrics(
    open_rows: DataFrame, recent: DataFrame, possible: DataFrame, review: DataFrame, health: DataFrame, registry: DataFrame, now: Column
) -> DataFrame:
    """One row of tier and source counts."""
    sized = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sources = registry.filter("enabled").agg(
        F.count(F.lit(1)).alias("employers_monitored"),
        F.count_if(~C("monitor_only")).alias("publishing_sources"),
        F.count_if(C("monitor_only")).alias("monitor_only_sources"),
    )
    states = health.agg(
        F.count_if(C("status") == "healthy").alias("healthy_sources"),
        F.count_if(C("status") == "failed").alias("failed_sources"),
        F.coalesce(F.sum("listing_count"), F.lit(0)).alias("listings_scanned"),
    )
    out = sized(open_rows, "open_verified_roles")
    # Every side is a single aggregate row.
    for part in (
        sized(recent, "recent_cycle_unstated"), sized(possible, "possible_roles"), sized(review, "review_queue"), sources, states,
    ):
        out = out.crossJoin(part)
    return out.select(now.alias("data_updated_at"), *out.columns)


def scan_summary(
    health: DataFrame, scanned: DataFrame, observations: DataFrame, public: DataFrame, possible: DataFrame, review: DataFrame
) -> DataFrame:
    ran = health.join(scanned.select("source_id"), "source_id", "left_semi").agg(
        F.count(F.lit(1)).alias("sources_attempted"),
        F.count_if((C("status") != "failed") & C("last_success_at").isNotNull()).alias("sources_succeeded"),
    )
    for df, name in ((observations, "observations"), (public, "public_roles"), (possible, "possible_roles"), (review, "review_items")):
        ran = ran.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))
    return ran


def refilter_possible(possible: DataFrame, verified: DataFrame, rules: RuleSet) -> DataFrame:
    """Possible rows that still pass today's rules and are not verified."""
    still = with_possible(possible, rules).filter("is_possible").drop("is_possible")
    return still.join(verified.select("id").distinct(), "id", "left_anti").select(*possible.columns)


def recently_closed(closed: DataFrame, active: DataFrame, now: Column, days: int = 14) -> DataFrame:
    recent = closed.filter(C("closed_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return recent.join(active.select("id").distinct(), "id", "left_anti")


def expected_vs_live(expected: DataFrame, live: DataFrame) -> DataFrame:
    """Expected programmes, replaced by the first open record of the same employer and programme."""
    folded = lambda c: text.casefold(c)
    candidates = live.filter(C("status") == "open").select(
        folded(C("canonical_employer")).alias("_e"), C("programme_type").alias("_p"), C("ord").alias("_o"),
        F.struct("opening_date", "first_seen_at", "canonical_url").alias("live"),
    )
    first = pick_first(candidates, ["_e", "_p"], C("_o"))
    joined = expected.join(
        first, (folded(C("employer")) == C("_e")) & (C("expected_programme_type") == C("_p")), "left"
    )
    on = C("live").isNotNull()
    return joined.select(
        "id",
        "employer",
        "expected_programme_type",
        "expected_location",
        F.when(on, dates.date_label(F.coalesce("live.opening_date", F.to_date("live.first_seen_at"))))
        .otherwise(C("historical_opening_window"))
        .alias("opening_window"),
        F.when(on & C("live.opening_date").isNotNull(), "official_future_opening_date")
        .when(on, "currently_open")
        .otherwise(C("evidence_type"))
        .alias("evidence_type"),
        F.when(on, "currently open").otherwise(C("current_status")).alias("current_status"),
        F.when(on, C("live.canonical_url")).otherwise(C("source_url")).alias("source_url"),
    )


# --- search ---------------------------------------------------------------------------------

# Sort modes over the facet columns.
def sort_mode(mode: str = "newest") -> list[Column]:
    collated = lambda name: F.collate(C(name), "UNICODE")
    modes = {
        "newest": F.desc("first_seen"),
        "deadline": F.asc("deadline"),
        "opening": F.asc("opening"),
        "employer": collated("employer").asc(),
        "category": collated("category").asc(),
        "score": F.desc("score"),
        "evidence": F.desc("evidence"),
    }
    return [modes.get(mode, modes["newest"])]


def rank(results: DataFrame, mode: str = "newest", tie: Sequence[Column] = ()) -> DataFrame:
    """Best search score first, then the chosen mode, then a stable tie-break."""
    return results.orderBy(F.desc("search_score"), *sort_mode(mode), *tie)


def search_rows(
    facets: DataFrame,
    query: str = "",
    company: str = "",
    filters: Mapping[str, str] | None = None,
    quick: Sequence[str] = (),
    saved: DataFrame | None = None,
) -> DataFrame:
    """Facet rows matching every condition, with ``search_score``.

    Facet filters are substrings after normalisation. All tests are filters on stored columns, so
    they run in the scan stage.
    """
    df = facets.withColumns(
        {
            "_title": search.search_text(C("title")),
            "_broad": search.search_text(C("search")),
            "_company": search.search_text(C("employer")),
        }
    )
    df = df.filter(search.all_words(C("_broad"), query) & search.all_words(C("_company"), company))
    df = df.filter(search.any_substring(C("category"), list(quick)))
    for name, value in (filters or {}).items():
        df = df.filter(F.contains(search.search_text(C(name).cast("string")), F.lit(search.search_term(value))))
    if saved is not None:
        df = df.join(saved.select("id").distinct(), "id", "left_semi")
    scored = search.search_score(C("_title"), C("_broad"), C("_company"), query, company)
    return df.withColumn("search_score", scored).drop("_title", "_broad", "_company")


def public_export(records: DataFrame) -> DataFrame:
    """Published columns: everything but the reviewed decision."""
    return records.drop("manual_override")


def lookup(tables: Mapping[str, DataFrame], ids: Sequence[str]) -> DataFrame:
    """Rows by id over all state tables, tagged with their table."""
    out = None
    for name, df in tables.items():
        part = df.filter(C("id").isin(*ids)).withColumn("state_table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def explain(records: DataFrame) -> DataFrame:
    """Why a record was classified as it was, one line per piece of evidence, reason and component."""
    line = lambda kind, name, detail: F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail")
    )
    lines = F.concat(
        F.transform("eligibility_evidence", lambda e: line("evidence", e["rule_id"], e["text"])),
        F.transform("relevance_reasons", lambda r: line("reason", F.lit("relevance"), r)),
        F.transform(
            F.map_entries("match_components"), lambda e: line("component", e["key"], e["value"].cast("string"))
        ),
    )
    return records.select("id", F.posexplode(lines).alias("line", "_l")).select("id", "line", "_l.kind", "_l.name", "_l.detail")


def approve(overrides: DataFrame, records: DataFrame, requests: DataFrame) -> DataFrame:
    """Override table after approval requests; one is taken only when the changed row turns public."""
    asked = requests.select(
        C("role_id").alias("id"),
        *[C(n).alias(f"_{n}") for n in requests.columns if n != "role_id"],
        F.struct(*[C(n) for n in overrides.columns]).alias("_request"),
    )
    changed = records.join(shuffled(asked), "id").withColumns(
        {
            "eligibility_status": F.coalesce("_eligibility_status", "eligibility_status"),
            "relevance_status": F.coalesce("_relevance_status", "relevance_status"),
            "geographic_scope": F.coalesce("_geographic_scope", "geographic_scope"),
            "manual_override": C("_request"),
            "publication_review_required": F.lit(False),
        }
    )
    accepted = changed.filter(is_public()).select(*[C(f"_request.{n}").alias(n) for n in overrides.columns])
    return overrides.join(shuffled(accepted.select("role_id")), "role_id", "left_anti").select(*overrides.columns).unionByName(accepted)


def restrict(df: DataFrame, source: str | None = None, category: str | None = None) -> DataFrame:
    """Source filter (prunes the scan) and category filter by slug (after classification)."""
    if source is not None:
        name = "source_id" if "source_id" in df.columns else "source_registry_id"
        df = df.filter(C(name) == source)
    if category is not None:
        df = df.filter(text.slug(C("primary_category")) == category)
    return df
