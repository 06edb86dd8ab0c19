import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import NOW, as_dict, table
from listwright import schema
from listwright.operators.classify import classify, is_public, with_possible
from listwright.rules import default_rules

RULES = default_rules()


def raw(**given) -> dict:
    base = {
        "source_id": "s1", "source_identifier": "1", "employer": "Acme", "title": "Policy research internship",
        "source_url": "https://acme.test/jobs/1", "application_url": "https://acme.test/apply/1?utm_source=x",
        "source_type": "generic_json", "source_authority": "official_ats", "organisation_type": "corporate",
        "location": "London", "location_type": "unknown", "description": "Legal and compliance research. Uses Excel.",
        "eligibility_text": "Open to penultimate year students. Any degree.", "published_date": dt.date(2026, 8, 20),
        "deadline": dt.date(2026, 8, 30), "paid": True, "explicitly_closed": False, "source_ord": 1, "page_no": 0, "position": 0,
    }
    base.update(given)
    return base


def source(**given) -> dict:
    base = {
        "id": "s1", "canonical_name": "Acme Group", "organisation_type": "corporate", "endpoint": "https://acme.test",
        "ats_type": "generic_json", "source_authority": "official_ats", "enabled": True, "priority_tier": "priority",
        "uk_priority_exception": False, "monitor_only": False, "manual_review_required": False, "source_ord": 1,
    }
    base.update(given)
    return base


CASES = {
    "base": ({}, {}),
    "outside": ({"location": "Leeds"}, {}),
    "blank_place": ({"location": "UK"}, {}),
    "exception": ({"location": "Leeds"}, {"uk_priority_exception": True, "exception_reason": "National"}),
    "unpaid_flag": ({"paid": False}, {}),
    "unpaid_word": ({"description": "This role is unpaid."}, {}),
    "final_year": ({"eligibility_text": "Final year students only; second year need not apply."}, {}),
    "hard": ({"description": "Works on compliance. Must have C++ daily!"}, {}),
    "third_only": ({"eligibility_text": "Relevant for: 3rd year"}, {}),
    "third_and_second": ({"eligibility_text": "Relevant for: 3rd year, 2nd year"}, {}),
    "charity_unknown_pay": ({"organisation_type": "charity", "paid": None}, {}),
    "vacation_ok": ({"title": "Vacation scheme summer 2027", "eligibility_text": "Penultimate year non-law students"}, {}),
    "vacation_missing": ({"title": "Vacation scheme summer 2027", "eligibility_text": "Anyone"}, {}),
    "vacation_final": ({"title": "Vacation scheme spring 2027", "eligibility_text": "Final year non-law"}, {}),
    "discovery": ({"source_authority": "discovery_only_source"}, {}),
    "british": ({"nationality_requirements": ["British citizen"]}, {}),
    "foreign": ({"nationality_requirements": ["French"]}, {}),
    "clearance": ({"clearance_requirements": ["SC clearance"]}, {}),
    "likely": ({"eligibility_text": "Undergraduates welcome"}, {}),
    "missing": ({"eligibility_text": "", "description": ""}, {}),
    "review": ({}, {"manual_review_required": True}),
    "closed": ({"explicitly_closed": True}, {}),
    "upcoming": ({"opening_date": dt.date(2026, 9, 1)}, {}),
}


@pytest.fixture(scope="module")
def classified(spark):
    raws, sources = [], []
    for i, (name, (r, s)) in enumerate(CASES.items()):
        raws.append(raw(source_id=name, source_identifier=name, position=i, **r))
        sources.append(source(id=name, **s))
    override = [{
        "role_id": None, "eligibility_status": "manual_approved", "email_approved": True, "reason": "ok me@x.example.com",
        "evidence_url": "https://e.test", "reviewed_at": NOW,
    }]
    df = classify(
        table(spark, schema.RAW, raws), table(spark, schema.REGISTRY, sources), table(spark, schema.OVERRIDES, override), RULES,
        F.lit(NOW).cast("timestamp"),
    )
    flagged = with_possible(df, RULES).withColumn("public", is_public())
    return {r["source_identifier"]: as_dict(r) for r in flagged.collect()}


@pytest.mark.parametrize(
    "name,status,rules",
    [
        ("base", "verified_eligible", ["study.penultimate", "degree.any"]),
        ("outside", "ineligible", ["location.not_verified"]),
        ("blank_place", "uncertain", ["location.not_verified"]),
        ("exception", "verified_eligible", ["study.penultimate", "degree.any"]),
        ("unpaid_flag", "ineligible", ["pay.unpaid"]),
        ("unpaid_word", "ineligible", ["pay.unpaid"]),
        ("final_year", "ineligible", ["study.final_year_only"]),
        ("hard", "ineligible", ["exclusion.must_have_cplusplus"]),
        ("third_only", "ineligible", ["study.third_year_only"]),
        ("third_and_second", "uncertain", ["eligibility.material_evidence_missing"]),
        ("charity_unknown_pay", "uncertain", ["pay.quality_controlled_organisation"]),
        ("vacation_ok", "verified_eligible", ["law.non_law_stage_verified", "study.penultimate", "degree.non_law"]),
        ("vacation_missing", "uncertain", ["law.explicit_non_law_stage_missing"]),
        ("vacation_final", "ineligible", ["law.final_year_non_law_only"]),
        ("discovery", "uncertain", ["source.discovery_only"]),
        ("british", "verified_eligible", ["nationality.british", "study.penultimate", "degree.any"]),
        ("foreign", "uncertain", ["nationality.not_established"]),
        ("clearance", "uncertain", ["security.additional_requirement"]),
        ("likely", "likely_eligible", ["study.broad_undergraduate"]),
        ("missing", "uncertain", ["eligibility.material_evidence_missing"]),
    ],
)
def test_eligibility_chain(classified, name, status, rules):
    assert classified[name]["eligibility_status"] == status
    assert classified[name]["eligibility_rule_ids"] == rules


def test_evidence_quotes_the_source_sentence(classified):
    quoted = [(e["text"], e["structured_field"]) for e in classified["base"]["eligibility_evidence"]]
    assert quoted == [("Open to penultimate year students.", "eligibility_text"), ("Any degree.", "eligibility_text")]
    assert classified["hard"]["eligibility_evidence"][0]["text"] == "Must have C++ daily!"


def test_score_and_links(classified):
    base = classified["base"]
    assert base["match_components"] == {
        "eligibility_strength": 20, "substantive_relevance": 35, "skill_alignment": 10, "organisation_quality": 10,
        "geographic_fit": 10, "recency": 5, "deadline_urgency": 5, "evidence_quality": 5,
    }
    assert base["match_score"] == 100 and classified["discovery"]["match_score"] == 49
    assert classified["exception"]["match_components"]["geographic_fit"] == 6
    assert base["application_url"] == "https://acme.test/apply/1"
    assert base["canonical_employer"] == "Acme Group" and classified["discovery"]["canonical_employer"] == "Acme"


def test_tiers_and_status(classified):
    assert classified["base"]["public"] and not classified["base"]["is_possible"]
    assert not classified["review"]["public"] and classified["review"]["is_possible"]
    assert classified["discovery"]["is_possible"] and not classified["outside"]["is_possible"]
    assert classified["closed"]["status"] == "closed" and not classified["closed"]["public"]
    assert classified["upcoming"]["status"] == "upcoming" and classified["upcoming"]["public"]
    assert classified["vacation_ok"]["programme_type"] == "summer_vacation_scheme_2027"
