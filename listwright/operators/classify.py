"""Rule-based classification of raw listings: raw x registry x overrides -> records.

Everything is a chain of projections: one scan, no shuffle beyond the dimension joins, no Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import dates, text, urls, values
from listwright.functions.constants import constant, constant_map
from listwright.operators.phrases import any_hit, barrier, first_hit, strings, with_hits, words
from listwright.rules.ruleset import OTHER, RuleSet
from listwright.schema import (
    AUTHORITY_RATIO,
    DISCOVERY,
    ELIGIBILITY_RATIO,
    EVIDENCE,
    GEOGRAPHY_RATIO,
    IN_SCOPE,
    OVERRIDE_STRUCT,
)

C = F.col
OFFICIAL = (
    "official_ats",
    "official_careers_page",
    "official_programme_page",
    "official_government_portal",
)


def ratio_of(c: Column, table: Mapping[str, float]) -> Column:
    out = F.lit(0.0)
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def join_registry(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach each row's source as a struct ``src``. Spark broadcasts the registry when it is small."""
    dimension = registry.select(
        C("id").alias("source_id"), F.struct(*[C(name) for name in registry.columns]).alias("src")
    )
    return raw.join(dimension, "source_id")


def join_overrides(df: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Attach the reviewed decision for the row's stable id, NULL when there is none."""
    if overrides is None:
        return df.withColumn("override", F.lit(None).cast(OVERRIDE_STRUCT))
    wide = overrides.select(
        C("role_id").alias("id"), F.struct(*[C(n) for n in overrides.columns]).cast(OVERRIDE_STRUCT).alias("override")
    )
    return df.join(wide, "id", "left")


# --- one-column classifiers -----------------------------------------------------------------


def location_type(rules: RuleSet) -> Column:
    where = C("n_place")
    given = F.coalesce(C("location_type"), F.lit("unknown"))
    return (
        F.when(given != "unknown", given)
        .when(F.contains(where, F.lit("hybrid")), "hybrid")
        .when(text.has_any(where, rules.remote_terms), "remote_uk")
        .when(text.has_any(where, rules.multi_terms) | F.contains(C("location"), F.lit(";")), "multi_location")
        .when(~where.isin("", "unknown"), "onsite")
        .otherwise("unknown")
    )


def geography(rules: RuleSet) -> Column:
    """``struct<scope, reason>``."""
    where = C("n_place")
    made = lambda scope, reason=None: F.struct(
        F.lit(scope).alias("scope"),
        (reason if reason is not None else F.lit(None).cast("string")).alias("reason"),
    )
    return (
        F.when(text.has_any(where, (*rules.london_terms, *rules.remote_terms)), made("london"))
        .when(C("src.uk_priority_exception"), made("uk_priority_exception", C("src.exception_reason")))
        .when(where.isin("", "unknown", "uk", "united kingdom"), made("uncertain"))
        .otherwise(made("out_of_scope"))
    )


def cycle_provenance() -> Column:
    return (
        F.when(C("cycle_provenance").isNotNull() & (C("cycle_provenance") != ""), C("cycle_provenance"))
        .when(C("source_type") == "curated_yaml", "manual_verified")
        .when(C("source_authority").isin(*OFFICIAL), "employer_stated")
        .otherwise("unknown")
    )


def programme(rules: RuleSet) -> Column:
    """``struct<kind, provenance>`` from the ordered programme table."""
    table = rules.programmes
    words_all, hint = C("n_programme"), C("n_hint")
    made = lambda kind, source: F.struct(F.lit(kind).alias("kind"), source.alias("provenance"))
    stated = cycle_provenance()
    unstated = made(table.unstated_type, F.lit("cycle_unstated"))
    scheme = F.when(F.lit(False), unstated)
    for phrase, kind in table.vacation_seasons:
        scheme = scheme.when(text.has_phrase(words_all, phrase), made(kind, stated))
    topic_source = F.coalesce(
        F.nullif(C("cycle_provenance"), F.lit("")),
        F.when(C("source_authority") != "trusted_sector_board", "official_recruitment_page").otherwise("unknown"),
    )
    chain = (
        F.when(text.has_phrase(words_all, table.vacation_phrase), scheme.otherwise(unstated))
        .when(text.has_any(words_all, table.summer_phrases), made(table.summer_type, stated))
        .when(
            dates.programme_window(C("programme_start"), table.summer_months, table.summer_year),
            made(table.summer_type, F.lit("programme_dates")),
        )
        .when(~text.has_any(hint, table.cycle_phrases), unstated)
    )
    for kind, terms in table.topics:
        chain = chain.when(text.has_any(words_all, terms), made(kind, topic_source))
    return chain.otherwise(unstated)


def date_provenance() -> Column:
    return (
        F.when(C("date_provenance").isNotNull() & (C("date_provenance") != ""), C("date_provenance"))
        .when(C("published_date").isNull(), "observed_first_seen")
        .when(C("source_authority") == "trusted_sector_board", "trusted_primary_listing")
        .when(C("source_authority") == "official_programme_page", "official_programme_page")
        .otherwise("employer_stated")
    )


def status_of(as_of: Column) -> Column:
    closed = F.coalesce(C("explicitly_closed"), F.lit(False))
    return F.when(closed, "closed").when(C("opening_date") > as_of, "upcoming").otherwise("open")


# --- staged classifiers ---------------------------------------------------------------------


def with_texts(df: DataFrame) -> DataFrame:
    """Normalise each text once; longer texts are put together from the parts."""
    raw = lambda name: F.coalesce(C(name), F.lit(""))
    df = df.withColumns(
        {
            "n_title": text.normalise_text(C("title")),
            "n_description": text.normalise_text(C("description")),
            "n_eligibility": text.normalise_text(C("eligibility_text")),
            "n_hint": text.normalise_text(C("cycle_hint")),
            "n_place": text.normalise_text(C("location")),
            "eligibility_body": text.strip(raw("eligibility_text")),
            "description_body": text.strip(raw("description")),
        }
    )
    join = lambda *names: F.concat_ws(" ", *[F.nullif(C(n), F.lit("")) for n in names])
    # A language name such as C++ may straddle the seam between two fields.
    seam = F.rlike(raw("description"), F.lit(r"^\s*[+#]"))
    whole = text.normalise_text(F.concat_ws(" ", raw("title"), raw("description")))
    df = df.withColumn("n_text", F.when(seam, whole).otherwise(join("n_title", "n_description")))
    has_own = C("eligibility_body") != ""
    return df.withColumns(
        {
            "n_all": join("n_text", "n_eligibility"),
            "n_programme": join("n_text", "n_hint"),
            "n_stage": F.when(has_own, C("n_eligibility")).otherwise(C("n_description")),
            "stage_body": F.when(has_own, C("eligibility_body")).otherwise(C("description_body")),
            "stage_field": F.when(has_own, "eligibility_text").otherwise("description"),
        }
    )


def _flat(table: Mapping[str, Sequence[str]]) -> list[str]:
    return [term for terms in table.values() for term in terms]


def with_rule_hits(df: DataFrame, rules: RuleSet) -> DataFrame:
    law = [term for stage, terms in rules.law_stages for term in (stage, *terms)]
    return with_hits(
        df,
        {
            "hits_title": (C("n_title"), _flat(rules.categories)),
            "hits_text": (
                C("n_text"),
                [
                    *_flat(rules.categories),
                    *rules.negative,
                    *rules.hard_exclusions,
                    *_flat(rules.positive),
                    *_flat(rules.skills),
                    *rules.selectivity_terms,
                ],
            ),
            "hits_all": (C("n_all"), ["unpaid", *rules.hard_exclusions]),
            "hits_stage": (
                C("n_stage"),
                [*_flat(rules.verified), *_flat(rules.likely), *law, *rules.law_final_terms],
            ),
        },
    )


def classify_category(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Primary category by highest score, ties to the greatest name; tags in taxonomy order."""
    table = constant(
        [
            {"category": name, "terms": [w for w in map(text.normalise_term, terms) if w]}
            for name, terms in rules.categories.items()
        ]
    )
    count = lambda terms, hits: F.size(F.filter(terms, lambda t: F.array_contains(hits, t)))
    known = strings(rules.categories)
    df = df.withColumn(
        "category_scores",
        F.transform(
            table,
            lambda row: F.struct(
                (count(row["terms"], C("hits_title")) * 3 + count(row["terms"], C("hits_text"))).alias("score"),
                row["category"].alias("category"),
                F.arrays_overlap(row["terms"], C("hits_text")).alias("in_text"),
            ),
        ),
    )
    best = F.array_max(C("category_scores"))
    hinted = F.when(F.array_contains(known, C("category_hint")), C("category_hint"))
    df = df.withColumn(
        "primary_category",
        F.coalesce(hinted, F.when(best["score"] > 0, best["category"]), F.lit(OTHER)),
    )
    tagged = F.transform(
        F.filter(C("category_scores"), lambda s: s["in_text"] & (s["category"] != C("primary_category"))),
        lambda s: s["category"],
    )
    given = F.array_intersect(F.coalesce(C("source_tags"), strings([])), known)
    return df.withColumn("secondary_tags", F.array_distinct(F.concat(given, tagged))).drop("category_scores")


def _item(rule_id: Column, fragment: Column, field: Column | None = None) -> Column:
    return F.struct(
        rule_id.alias("rule_id"),
        text.redact_email(fragment).alias("text"),
        C("source_url").alias("source_url"),
        (field if field is not None else F.lit(None).cast("string")).alias("structured_field"),
    )


def _one(rule_id: str | Column, fragment: Column, field: str | Column | None = None) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.array(_item(as_column(rule_id), fragment, as_column(field) if field is not None else None))


def _fragment_pool() -> Column:
    """Every fragment of eligibility, description and title with its normalised form."""
    return text.fragment_pool({n: C(n) for n in ("eligibility_text", "description", "title")})


def _quote(rule_id: str | Column, terms: Column) -> Column:
    """Evidence quoting the first fragment that holds any of ``terms``, else the whole field."""
    found = F.try_element_at(
        F.filter(C("pool"), lambda p: F.exists(terms, lambda t: F.contains(p["words"], text.padded(t)))), F.lit(1)
    )
    whole = F.when(C("stage_body") != "", C("stage_body")).otherwise(text.strip(C("title")))
    return _one(rule_id, F.coalesce(found["text"], whole), F.coalesce(found["field"], C("stage_field")))


def assess_eligibility(df: DataFrame, rules: RuleSet) -> DataFrame:
    """First matching rule decides the status; some rules only add evidence on the way.

    ``stop`` names the deciding rule. Needs the text, hit, scope and programme columns.
    """
    organisation = C("raw_organisation_type")
    unpaid, paid = C("paid").eqNullSafe(F.lit(False)), C("paid").eqNullSafe(F.lit(True))
    padded_all = text.padded(C("n_all"))
    stage_hit = lambda terms: any_hit(C("hits_stage"), terms)
    relevant = C("n_eligibility")
    vacation = C("programme_type").isin(*rules.programmes.vacation_types)
    law_ok = F.lit(False)
    for stage, terms in rules.law_stages:
        law_ok = law_ok | (stage_hit([stage]) & stage_hit(terms))
    nationality = F.coalesce(C("nationality_requirements"), strings([]))
    residency = F.coalesce(C("residency_requirements"), strings([]))
    clearance = F.coalesce(C("clearance_requirements"), strings([]))
    joined = text.normalise_text(F.array_join(nationality, " "))
    second_year = text.has_any(relevant, rules.second_year_terms)

    df = df.withColumns(
        {
            "law_path": vacation,
            "hard_term": first_hit(C("hits_all"), rules.hard_exclusions),
            "nation": F.when(F.size(nationality) == 0, "none")
            .when(text.has_any(joined, rules.british_terms), "british")
            .when(text.has_any(joined, rules.commonwealth_terms), "new_zealand")
            .otherwise("other"),
            "verified_ids": F.array_compact(
                F.array(*[F.when(stage_hit(terms), F.lit(name)) for name, terms in rules.verified.items()])
            ),
            "likely_id": F.try_element_at(
                F.array_compact(
                    F.array(*[F.when(stage_hit(terms), F.lit(name)) for name, terms in rules.likely.items()])
                ),
                F.lit(1),
            ),
        }
    )
    stop = (
        F.when(C("geographic_scope") == "out_of_scope", "scope_out")
        .when(C("geographic_scope") == "uncertain", "scope_unknown")
        .when(unpaid, "paid_false")
        .when(F.rlike(padded_all, F.lit(rules.final_year_pattern)), "final_year")
        .when(any_hit(C("hits_all"), ["unpaid"]), "unpaid")
        .when(C("hard_term").isNotNull(), "hard")
        .when(text.has_any(relevant, rules.third_year_terms) & ~second_year, "third_year")
        .when(text.has_any(relevant, rules.first_year_terms) & ~second_year, "first_year")
        .when((C("programme_type") == rules.programmes.parliamentary_type) & ~paid, "parliament_pay")
        .when(organisation.isin(*rules.paid_types) & ~paid, "controlled_pay")
        .when(C("law_path") & stage_hit(rules.law_final_terms), "law_final")
        .when(C("law_path") & ~law_ok, "law_missing")
        .when(C("source_authority") == DISCOVERY, "discovery")
        .when(C("nation") == "other", "nation_other")
        .when((F.size(residency) > 0) | (F.size(clearance) > 0), "security")
        .when((F.size(C("verified_ids")) > 0) | C("law_path"), "verified")
        .when(C("likely_id").isNotNull(), "likely")
        .otherwise("missing")
    )
    df = df.withColumn("stop", stop)
    quoting = ("final_year", "unpaid", "hard", "law_final", "verified", "likely")
    df = df.withColumn("pool", F.when(C("stop").isin(*quoting), _fragment_pool()))

    none = F.array().cast(EVIDENCE)
    own_ids = lambda name: rules.rule_ids.get(name, f"eligibility.{name}")
    term_list = lambda terms: strings(words(terms))
    pay_note = F.coalesce(F.nullif(C("paid_evidence"), F.lit("")), F.lit("Paid status is not stated"))
    verified_items = [
        F.when(F.array_contains(C("verified_ids"), name), _quote(own_ids(name), term_list(terms))).otherwise(none)
        for name, terms in rules.verified.items()
    ]
    likely_item = none
    for name, terms in rules.likely.items():
        likely_item = F.when(C("likely_id") == name, _quote(own_ids(name), term_list(terms))).otherwise(likely_item)
    deciding = (
        F.when(C("stop").isin("scope_out", "scope_unknown"), _one("location.not_verified", C("location"), "location"))
        .when(
            C("stop") == "paid_false",
            _one("pay.unpaid", F.coalesce(F.nullif(C("paid_evidence"), F.lit("")), F.lit("paid=false")), "paid_evidence"),
        )
        .when(C("stop") == "final_year", _quote("study.final_year_only", strings(["final year"])))
        .when(C("stop") == "unpaid", _quote("pay.unpaid", strings(["unpaid"])))
        .when(
            C("stop") == "hard",
            _quote(
                F.concat(F.lit("exclusion."), F.replace(C("hard_term"), F.lit(" "), F.lit("_"))),
                F.array(C("hard_term")),
            ),
        )
        .when(C("stop") == "third_year", _one("study.third_year_only", C("eligibility_text"), "eligibility_text"))
        .when(C("stop") == "first_year", _one("study.first_year_only", C("eligibility_text"), "eligibility_text"))
        .when(C("stop") == "parliament_pay", _one("pay.parliament_requires_paid", pay_note))
        .when(C("stop") == "controlled_pay", _one("pay.quality_controlled_organisation", pay_note))
        .when(C("stop") == "law_final", _quote("law.final_year_non_law_only", term_list(rules.law_final_terms)))
        .when(
            C("stop") == "law_missing",
            _one(
                "law.explicit_non_law_stage_missing",
                F.coalesce(
                    F.nullif(C("stage_body"), F.lit("")),
                    F.lit("No explicit eligible non-law study stage was found"),
                ),
                C("stage_field"),
            ),
        )
        .when(
            C("stop") == "discovery",
            _one(
                "source.discovery_only",
                F.lit("Eligibility is plausible but must be verified on the employer's application page"),
            ),
        )
        .when(
            C("stop") == "nation_other",
            _one("nationality.not_established", F.try_element_at(nationality, F.lit(1)), "nationality_requirements"),
        )
        .when(
            C("stop") == "security",
            _one(
                "security.additional_requirement",
                values.first_of(residency, clearance),
                F.when(F.size(residency) > 0, "residency_requirements").otherwise("clearance_requirements"),
            ),
        )
        .when(C("stop") == "verified", F.concat(none, *verified_items))
        .when(C("stop") == "likely", likely_item)
        .when(
            C("stop") == "missing",
            _one(
                "eligibility.material_evidence_missing",
                F.coalesce(
                    F.nullif(C("stage_body"), F.lit("")), F.lit("Material study-stage eligibility is not stated")
                ),
                C("stage_field"),
            ),
        )
        .otherwise(none)
    )
    after_law = ("discovery", "nation_other", "security", "verified", "likely", "missing")
    after_nation = ("security", "verified", "likely", "missing")
    law_item = F.when(
        C("law_path") & C("stop").isin(*after_law),
        _one("law.non_law_stage_verified", C("stage_body"), C("stage_field")),
    ).otherwise(none)
    nation_item = F.when(
        C("nation").isin("british", "new_zealand") & C("stop").isin(*after_nation),
        _one(
            F.concat(F.lit("nationality."), C("nation")),
            F.try_element_at(nationality, F.lit(1)),
            "nationality_requirements",
        ),
    ).otherwise(none)
    note = (
        F.when(~C("stop").isin(*after_nation), F.lit(None).cast("string"))
        .when(C("nation") == "british", "Known British citizenship meets the stated nationality element only.")
        .when(C("nation") == "new_zealand", "Known New Zealand citizenship meets the stated nationality element only.")
    )
    ineligible = (
        "scope_out", "paid_false", "final_year", "unpaid", "hard", "third_year", "first_year", "law_final",
    )
    status = (
        F.when(C("stop").isin(*ineligible), "ineligible")
        .when(C("stop") == "verified", "verified_eligible")
        .when(C("stop") == "likely", "likely_eligible")
        .otherwise("uncertain")
    )
    return df.withColumns(
        {
            "eligibility_status": status,
            "eligibility_evidence": F.concat(law_item, nation_item, deciding),
            "nationality_assessment": note,
        }
    ).drop("pool", "law_path", "hard_term", "nation", "verified_ids", "likely_id")


def assess_relevance(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Status, reasons and the two hit counts. Needs the hit and category columns."""
    hit = lambda terms: any_hit(C("hits_text"), terms)
    negatives = [t for t in (*rules.negative, *rules.hard_exclusions) if text.normalise_term(t)]
    # The reason quotes the phrase as it is written in the table.
    spelling: dict[str, str] = {}
    for term in negatives:
        spelling.setdefault(text.normalise_term(term), term)
    excluded = F.try_element_at(
        constant_map(spelling), first_hit(C("hits_text"), negatives)
    )
    controlled = C("raw_organisation_type").isin(*rules.controlled_types)
    approved = C("src.priority_tier").isin(*rules.approved_tiers)
    total = lambda table: sum((hit(terms).cast("int") for terms in table.values()), F.lit(0))
    in_category = C("primary_category") != OTHER
    df = df.withColumns(
        {
            "excluded_term": excluded,
            "substantive_raw": total(rules.positive) + in_category.cast("int"),
            "skill_raw": total(rules.skills),
        }
    )
    blocked = C("excluded_term").isNotNull() | (controlled & ~F.coalesce(approved, F.lit(False)))
    unselective = C("raw_organisation_type").isin(*rules.selective_types) & ~hit(rules.selectivity_terms)
    status = (
        F.when(blocked, "irrelevant")
        .when(unselective, "borderline_relevance")
        .when(C("substantive_raw") >= 3, "strong_match")
        .when(C("substantive_raw") >= 1, "credible_match")
        .when(C("src.manual_review_required"), "borderline_relevance")
        .otherwise("irrelevant")
    )
    found = [
        F.when(hit(terms), F.lit(rules.reasons.get(name, f"Matches {name.replace('_', ' ')} evidence")))
        for name, terms in rules.positive.items()
    ]
    closing = (
        F.when(unselective, "Selectivity is not established for this charity, NGO or foundation role")
        .when(C("substantive_raw") >= 1, F.lit(None).cast("string"))
        .when(C("src.manual_review_required"), "Substantive relevance requires manual review")
        .otherwise("No substantive approved-category evidence found")
    )
    reasons = (
        F.when(C("excluded_term").isNotNull(), F.array(F.concat(F.lit("Excluded work: "), C("excluded_term"))))
        .when(blocked, F.array(F.lit("Organisation scale or selectivity has not been approved")))
        .otherwise(
            F.array_distinct(
                F.array_compact(
                    F.array(
                        *found,
                        F.when(C("skill_raw") > 0, "Uses relevant analytical, research or communication skills"),
                        F.when(
                            in_category,
                            F.concat(F.lit("Falls within the approved "), C("primary_category"), F.lit(" category")),
                        ),
                        closing,
                    )
                )
            )
        )
    )
    return df.withColumns(
        {
            "relevance_status": status,
            "relevance_reasons": reasons,
            "substantive_hits": F.when(blocked, 0).otherwise(C("substantive_raw")),
            "skill_hits": F.when(blocked, 0).otherwise(C("skill_raw")),
        }
    ).drop("excluded_term", "substantive_raw", "skill_raw")


def score(df: DataFrame, rules: RuleSet, as_of: Column) -> DataFrame:
    """Eight rounded components and their sum, held at 49 without positive eligibility."""
    ratios = {
        "eligibility_strength": ratio_of(C("eligibility_status"), ELIGIBILITY_RATIO),
        "substantive_relevance": values.clamp(C("substantive_hits"), 3),
        "skill_alignment": values.clamp(C("skill_hits"), 2),
        "organisation_quality": C("approved_organisation").cast("double"),
        "geographic_fit": ratio_of(C("geographic_scope"), GEOGRAPHY_RATIO),
        "recency": dates.recency_ratio(C("published_date"), as_of),
        "deadline_urgency": dates.urgency_ratio(C("deadline"), as_of),
        "evidence_quality": ratio_of(C("source_authority"), AUTHORITY_RATIO),
    }
    df = df.withColumn("match_components", values.components(ratios, rules.weights))
    full = values.total(C("match_components"))
    held = C("eligibility_status").isin("ineligible", "uncertain")
    return df.withColumn("match_score", F.when(held, F.least(full, F.lit(49))).otherwise(full))


def apply_overrides(df: DataFrame) -> DataFrame:
    """Reviewed values replace derived ones; the decision itself becomes evidence."""
    reviewed = C("override").isNotNull()
    note = F.array(
        F.struct(
            F.lit("manual.override").alias("rule_id"),
            text.redact_email(C("override.reason")).alias("text"),
            C("override.evidence_url").alias("source_url"),
            F.lit("manual_override").alias("structured_field"),
        )
    )
    pick = lambda name: F.coalesce(F.nullif(C(f"override.{name}"), F.lit("")), C(name))
    return df.withColumns(
        {
            "eligibility_status": pick("eligibility_status"),
            "relevance_status": pick("relevance_status"),
            "geographic_scope": pick("geographic_scope"),
            "email_approved": F.coalesce(C("override.email_approved"), F.lit(False)),
            "eligibility_evidence": F.when(reviewed, F.concat(C("eligibility_evidence"), note)).otherwise(
                C("eligibility_evidence")
            ),
        }
    )


def classify(
    raw: DataFrame,
    registry: DataFrame,
    overrides: DataFrame | None,
    rules: RuleSet,
    now: Column,
) -> DataFrame:
    """Full classification. ``now`` is the observation time; nothing reads the clock."""
    as_of = F.to_date(now)
    df = join_registry(raw, registry)
    for name in ("description", "eligibility_text", "application_method", "paid_evidence"):
        df = df.withColumn(name, text.redact_email(C(name)))
    df = df.withColumns(
        {
            "id": text.stable_id(C("employer"), C("source_type"), C("source_identifier")),
            "organisation_type": F.coalesce(
                F.nullif(C("organisation_type"), F.lit("")), C("src.organisation_type")
            ),
            "raw_organisation_type": C("organisation_type"),
            "source_tags": C("secondary_tags"),
        }
    )
    df = join_overrides(df, overrides)
    df = barrier(with_rule_hits(with_texts(df), rules))
    df = df.withColumns({"_geo": geography(rules), "_programme": programme(rules)})
    df = df.withColumns(
        {
            "geographic_scope": C("_geo.scope"),
            "geographic_exception_reason": C("_geo.reason"),
            "programme_type": C("_programme.kind"),
            "location_type": location_type(rules),
        }
    )
    df = classify_category(df, rules)
    df = assess_relevance(assess_eligibility(df, rules), rules)
    df = apply_overrides(df)
    df = df.withColumn(
        "approved_organisation", F.coalesce(C("src.priority_tier").isin(*rules.approved_tiers), F.lit(False))
    )
    df = score(df, rules, as_of)
    df = df.withColumns(
        {
            "canonical_url": urls.canonical_url(C("source_url")),
            "apply_url": urls.canonical_url(
                F.coalesce(F.nullif(C("application_url"), F.lit("")), C("source_url"))
            ),
        }
    )
    closed = F.coalesce(C("explicitly_closed"), F.lit(False))
    # A fragment's words are words of the whole text too, unless a C++ or C# straddles a cut; other rows need no fragments.
    wanted = (*rules.degree_terms, *rules.study_terms, *rules.graduation_terms)
    straddling = F.contains("stage_body", F.lit("+")) | F.contains("stage_body", F.lit("#"))
    pool = text.fragment_pool({"stage": C("stage_body")})
    df = df.withColumn("_restricted", text.has_any(C("n_stage"), wanted) | straddling)
    df = df.withColumn("stage_pool", F.when(C("_restricted"), pool).otherwise(F.array().cast("array<struct<text:string,field:string,words:string>>")))
    restrictions = lambda terms: text.distinct_texts(text.holding(C("stage_pool"), terms))
    shown = F.when(
        C("source_authority").isin("official_government_portal", "trusted_sector_board", DISCOVERY), C("employer")
    ).otherwise(C("src.canonical_name"))
    empty = strings([])
    all_urls = F.concat(
        F.array(C("source_url")),
        F.array_compact(F.array(F.nullif(C("application_url"), F.lit("")))),
        F.filter(F.coalesce(C("all_source_urls"), empty), lambda u: u.isNotNull() & (u != "")),
        F.array(C("canonical_url"), C("apply_url")),
    )
    ordinal = (
        C("source_ord").cast("bigint") * F.lit(1 << 40)
        + C("page_no").cast("bigint") * F.lit(1 << 20)
        + C("position").cast("bigint")
    )
    out = df.select(
        "id",
        text.clean_name(shown).alias("canonical_employer"),
        "employer_alias",
        "organisation_type",
        "named_office_or_mp",
        "political_affiliation",
        "division",
        "application_method",
        "listing_publisher",
        "source_authority",
        text.strip(C("title")).alias("title"),
        "canonical_url",
        C("apply_url").alias("application_url"),
        F.array_distinct(all_urls).alias("all_source_urls"),
        C("source_id").alias("source_registry_id"),
        "source_type",
        "source_identifier",
        "location",
        "location_type",
        "geographic_scope",
        "geographic_exception_reason",
        "programme_type",
        "primary_category",
        "secondary_tags",
        F.substring(C("description_body"), 1, 500).alias("description_excerpt"),
        "published_date",
        now.alias("first_seen_at"),
        now.alias("last_seen_at"),
        "opening_date",
        "deadline",
        "programme_start",
        "programme_end",
        "salary",
        "paid",
        C("paid_evidence").alias("paid_status_evidence"),
        "eligibility_status",
        C("eligibility_evidence").cast(EVIDENCE).alias("eligibility_evidence"),
        F.transform(C("eligibility_evidence"), lambda e: e["rule_id"]).alias("eligibility_rule_ids"),
        "relevance_status",
        "relevance_reasons",
        "match_score",
        "match_components",
        restrictions(rules.degree_terms).alias("degree_restrictions"),
        restrictions(rules.study_terms).alias("study_year_restrictions"),
        restrictions(rules.graduation_terms).alias("graduation_year_restrictions"),
        F.coalesce(C("nationality_requirements"), empty).alias("nationality_requirements"),
        F.coalesce(C("residency_requirements"), empty).alias("residency_requirements"),
        F.coalesce(C("clearance_requirements"), empty).alias("clearance_requirements"),
        "nationality_assessment",
        C("src.priority_tier").alias("employer_quality_tier"),
        "approved_organisation",
        (F.coalesce(C("src.manual_review_required"), F.lit(False)) & C("override").isNull()).alias(
            "publication_review_required"
        ),
        date_provenance().alias("date_provenance"),
        C("_programme.provenance").alias("cycle_provenance"),
        status_of(as_of).alias("status"),
        F.when(closed, "Official listing states applications are closed").alias("closure_reason"),
        F.when(closed, C("source_url")).alias("closure_evidence"),
        F.when(closed, now).alias("closed_at"),
        F.lit(0).alias("consecutive_missing_count"),
        F.lit("healthy").alias("source_health_at_last_check"),
        C("override").alias("manual_override"),
        "email_approved",
        ordinal.alias("ord"),
    )
    return barrier(out)


# --- tier predicates on records -------------------------------------------------------------


def in_scope() -> Column:
    return C("geographic_scope").isin(*IN_SCOPE)


def not_unpaid() -> Column:
    return ~C("paid").eqNullSafe(F.lit(False))


def _relevant() -> Column:
    return C("relevance_status").isin("strong_match", "credible_match") | (
        (C("relevance_status") == "borderline_relevance") & C("manual_override").isNotNull()
    )


def is_public(assume_open: bool = False) -> Column:
    """Publication boundary of the verified tier."""
    live = F.lit(True) if assume_open else C("status") != "closed"
    return (
        C("eligibility_status").isin("verified_eligible", "likely_eligible", "manual_approved")
        & _relevant()
        & ~C("publication_review_required")
        & live
        & in_scope()
        & (C("source_authority") != DISCOVERY)
        & not_unpaid()
    )


def guards(rules: RuleSet, title: Column) -> Column:
    """Clinician posts and publishers that sell placements."""
    clinician = (
        (C("organisation_type") == "public_health")
        & text.has_phrase(title, "gp")
        & ~text.has_any(title, ("reception", "receptionist", "admin", "administrator", "assistant"))
    )
    sellers = [text.normalise_term(name) for name in rules.excluded_publishers]
    seller = (C("source_authority") == DISCOVERY) & (
        text.normalise_text(C("canonical_employer")).isin(*sellers) if sellers else F.lit(False)
    )
    return F.coalesce(clinician, F.lit(False)) | seller


def with_possible(df: DataFrame, rules: RuleSet, into: str = "is_possible") -> DataFrame:
    """Flag rows of the recall-oriented tier: live, plausible, not already public. A flag that is there stays."""
    if into in df.columns:
        return df
    context = [term for terms in rules.context_exclusions.values() for term in terms]
    df = df.withColumns(
        {
            "_title": text.normalise_text(C("title")),
            "_full": text.normalise_text(F.concat_ws(" ", C("title"), C("description_excerpt"))),
        }
    )
    df = with_hits(
        df,
        {
            "_title_hits": (C("_title"), [*rules.title_inclusions, *rules.title_exclusions, *context]),
            "_full_hits": (C("_full"), rules.hard_exclusions),
        },
    )
    by_context = F.lit(False)
    for organisation, terms in rules.context_exclusions.items():
        by_context = by_context | ((C("organisation_type") == organisation) & any_hit(C("_title_hits"), terms))
    flag = (
        ~is_public()
        & (C("status") == "open")
        & (C("eligibility_status") != "ineligible")
        & C("relevance_status").isin("strong_match", "credible_match", "borderline_relevance")
        & any_hit(C("_title_hits"), rules.title_inclusions)
        & ~any_hit(C("_title_hits"), rules.title_exclusions)
        & ~any_hit(C("_full_hits"), rules.hard_exclusions)
        & ~F.coalesce(by_context, F.lit(False))
        & ~guards(rules, C("_title"))
        & in_scope()
        & not_unpaid()
    )
    return barrier(df.withColumn(into, flag).drop("_title", "_full", "_title_hits", "_full_hits"))


def needs_review(possible: Column) -> Column:
    return (
        (C("status") != "closed")
        & (C("eligibility_status") == "uncertain")
        & ~possible
        & (C("relevance_status") != "irrelevant")
    )


def digest_eligible() -> Column:
    """Like the public boundary, but likely rows need a reviewed mail approval and must be open."""
    status_ok = C("eligibility_status").isin("verified_eligible", "manual_approved") | (
        (C("eligibility_status") == "likely_eligible") & C("email_approved")
    )
    return (
        status_ok
        & _relevant()
        & (C("status") == "open")
        & in_scope()
        & (C("source_authority") != DISCOVERY)
        & ~C("publication_review_required")
        & not_unpaid()
    )
