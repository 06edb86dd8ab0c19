"""Table schemas and ordered domains."""

from __future__ import annotations

RAW = """
source_id STRING, source_identifier STRING, employer STRING, employer_alias STRING, title STRING,
source_url STRING, application_url STRING, source_type STRING, source_authority STRING,
listing_publisher STRING, organisation_type STRING, named_office_or_mp STRING,
political_affiliation STRING, division STRING, application_method STRING, location STRING,
location_type STRING, description STRING, published_date DATE, opening_date DATE, deadline DATE,
programme_start DATE, programme_end DATE, salary STRING, paid BOOLEAN, paid_evidence STRING,
eligibility_text STRING, nationality_requirements ARRAY<STRING>,
residency_requirements ARRAY<STRING>, clearance_requirements ARRAY<STRING>,
all_source_urls ARRAY<STRING>, explicitly_closed BOOLEAN, cycle_hint STRING,
date_provenance STRING, cycle_provenance STRING, category_hint STRING,
secondary_tags ARRAY<STRING>, extra MAP<STRING,STRING>,
source_ord INT, page_no INT, position INT
"""

PAYLOADS = """
source_id STRING, scan_id STRING, page_no INT, query STRING, content_type STRING,
payload BINARY, fetched_at TIMESTAMP
"""

EVIDENCE = "ARRAY<STRUCT<rule_id:STRING,text:STRING,source_url:STRING,structured_field:STRING>>"

OVERRIDES = """
role_id STRING, eligibility_status STRING, relevance_status STRING, email_approved BOOLEAN,
geographic_scope STRING, reason STRING, evidence_url STRING, reviewed_at TIMESTAMP
"""

OVERRIDE_STRUCT = (
    "STRUCT<role_id:STRING,eligibility_status:STRING,relevance_status:STRING,email_approved:BOOLEAN,"
    "geographic_scope:STRING,reason:STRING,evidence_url:STRING,reviewed_at:TIMESTAMP>"
)

RECORD = f"""
id STRING, canonical_employer STRING, employer_alias STRING, organisation_type STRING,
named_office_or_mp STRING, political_affiliation STRING, division STRING,
application_method STRING, listing_publisher STRING, source_authority STRING, title STRING,
canonical_url STRING, application_url STRING, all_source_urls ARRAY<STRING>,
source_registry_id STRING, source_type STRING, source_identifier STRING, location STRING,
location_type STRING, geographic_scope STRING, geographic_exception_reason STRING,
programme_type STRING, primary_category STRING, secondary_tags ARRAY<STRING>,
description_excerpt STRING, published_date DATE, first_seen_at TIMESTAMP,
last_seen_at TIMESTAMP, opening_date DATE, deadline DATE, programme_start DATE,
programme_end DATE, salary STRING, paid BOOLEAN, paid_status_evidence STRING,
eligibility_status STRING, eligibility_evidence {EVIDENCE}, eligibility_rule_ids ARRAY<STRING>,
relevance_status STRING, relevance_reasons ARRAY<STRING>, match_score INT,
match_components MAP<STRING,INT>, degree_restrictions ARRAY<STRING>,
study_year_restrictions ARRAY<STRING>, graduation_year_restrictions ARRAY<STRING>,
nationality_requirements ARRAY<STRING>, residency_requirements ARRAY<STRING>,
clearance_requirements ARRAY<STRING>, nationality_assessment STRING,
employer_quality_tier STRING, approved_organisation BOOLEAN,
publication_review_required BOOLEAN, date_provenance STRING, cycle_provenance STRING,
status STRING, closure_reason STRING, closure_evidence STRING, closed_at TIMESTAMP,
consecutive_missing_count INT, source_health_at_last_check STRING,
manual_override {OVERRIDE_STRUCT}, email_approved BOOLEAN, ord BIGINT
"""

REGISTRY = """
id STRING, canonical_name STRING, aliases ARRAY<STRING>, organisation_type STRING,
careers_url STRING, ats_type STRING, endpoint STRING, source_authority STRING, enabled BOOLEAN,
priority_tier STRING, uk_priority_exception BOOLEAN, exception_reason STRING,
poll_interval_minutes INT, result_cap INT, expected_min_items INT, monitor_only BOOLEAN,
manual_review_required BOOLEAN, required_settings ARRAY<STRING>, request_method STRING,
request_body STRING, curated_file STRING, notes STRING, source_ord INT
"""

HEALTH = """
source_id STRING, status STRING, checked_at TIMESTAMP, last_success_at TIMESTAMP,
item_count BIGINT, listing_count BIGINT, candidate_count BIGINT, pages_scanned BIGINT,
capped BOOLEAN, parser_ok BOOLEAN, content_hash STRING, changed_since_last_success BOOLEAN,
message STRING
"""

OBSERVATIONS = """
role_id STRING, source_id STRING, source_identifier STRING, observed_at TIMESTAMP,
source_url STRING, changes ARRAY<STRING>
"""

EXPECTED = """
id STRING, employer STRING, expected_programme_type STRING, expected_location STRING,
historical_opening_window STRING, evidence_type STRING, source_url STRING, last_verified DATE,
current_status STRING, official_opening_date DATE
"""

SUBSCRIBERS = """
id STRING, email STRING, status STRING, created_at TIMESTAMP, confirmed_at TIMESTAMP,
unsubscribed_at TIMESTAMP, confirmation_token_hash STRING, confirmation_expires_at TIMESTAMP,
unsubscribe_token_hashes ARRAY<STRING>, last_digest_sent STRING, delivery_failure_status STRING
"""

# Ordered domains.
AUTHORITY_RANK = {
    "official_ats": 6,
    "official_programme_page": 5,
    "official_government_portal": 5,
    "official_careers_page": 4,
    "trusted_sector_board": 3,
    "discovery_only_source": 0,
}
AUTHORITY_RATIO = {
    "official_ats": 1.0,
    "official_careers_page": 0.9,
    "official_programme_page": 1.0,
    "official_government_portal": 1.0,
    "trusted_sector_board": 0.8,
    "discovery_only_source": 0.0,
}
ELIGIBILITY_RATIO = {
    "verified_eligible": 1.0,
    "manual_approved": 1.0,
    "likely_eligible": 0.6,
    "uncertain": 0.0,
    "ineligible": 0.0,
}
GEOGRAPHY_RATIO = {
    "london": 1.0,
    "uk_priority_exception": 0.6,
    "uncertain": 0.0,
    "out_of_scope": 0.0,
}
EVIDENCE_RANK = {
    "verified_eligible": 3,
    "manual_approved": 3,
    "likely_eligible": 2,
    "uncertain": 1,
    "ineligible": 0,
}
# Closed vocabularies of the record table.
DOMAINS = {
    "source_authority": tuple(AUTHORITY_RANK),
    "eligibility_status": tuple(ELIGIBILITY_RATIO),
    "relevance_status": ("strong_match", "credible_match", "borderline_relevance", "irrelevant"),
    "geographic_scope": tuple(GEOGRAPHY_RATIO),
    "location_type": ("onsite", "hybrid", "remote_uk", "multi_location", "unknown"),
    "status": ("open", "closed", "upcoming"),
    "programme_type": (
        "summer_internship_2027",
        "winter_vacation_scheme_2026",
        "spring_vacation_scheme_2027",
        "summer_vacation_scheme_2027",
        "selective_insight_programme",
        "short_professional_internship",
        "policy_research_internship",
        "parliamentary_office_internship",
        "international_institution_internship",
        "development_humanitarian_internship",
        "environmental_esg_internship",
        "healthcare_health_policy_internship",
        "commercial_operations_internship",
        "cycle_unstated_recent_role",
        "upcoming_announced_programme",
    ),
    "date_provenance": (
        "employer_stated",
        "official_programme_page",
        "trusted_primary_listing",
        "observed_first_seen",
        "historical_estimate",
        "third_party_estimate",
        "unknown",
    ),
    "cycle_provenance": (
        "employer_stated",
        "programme_dates",
        "official_recruitment_page",
        "manual_verified",
        "cycle_unstated",
        "unknown",
    ),
}
IN_SCOPE = ("london", "uk_priority_exception")
DISCOVERY = "discovery_only_source"
