"""Built-in rule tables, used where a deployment supplies none.

Everything below is fixed values: phrase lists whose content decides results.
"""

from __future__ import annotations

from listwright.rules.ruleset import OTHER, Programmes, RuleSet

CATEGORIES = {
    "Law-Firm Vacation Schemes": ("vacation scheme",),
    "Investment Banking": ("investment banking", "mergers and acquisitions", "m&a"),
    "Corporate Finance and Transactions": ("corporate finance", "transaction advisory"),
    "Markets, Sales and Trading": ("sales and trading", "global markets", "trading"),
    "Asset and Investment Management": ("asset management", "investment management"),
    "Development Finance and Impact Investment": ("development finance", "impact investment"),
    "Real Estate Investment and Advisory": ("real estate", "property investment"),
    "Financial Regulation and Central Banking": ("central bank", "financial regulation"),
    "Compliance and Financial Crime": ("compliance", "financial crime", "anti money laundering"),
    "Legal and Regulatory": ("legal", "regulatory", "litigation"),
    "Insurance and Reinsurance": ("insurance", "reinsurance", "underwriting"),
    "Climate and Catastrophe Risk": ("catastrophe risk", "climate risk"),
    "Management and Strategy Consulting": ("strategy consulting", "management consulting"),
    "Economic Consulting": ("economic consulting", "economist"),
    "Healthcare Consulting": ("healthcare consulting",),
    "Corporate Strategy": ("corporate strategy", "business strategy"),
    "Business Operations and Commercial Analysis": ("commercial analysis", "business operations"),
    "Public Policy and Policy Research": ("public policy", "policy research"),
    "Parliament and MP Offices": ("parliament", "member of parliament", "mp office", "westminster"),
    "Intelligence and National Security": ("national security", "intelligence analyst"),
    "Political and Geopolitical Risk": ("geopolitical", "political risk"),
    "Think Tanks and Research Institutes": ("think tank", "research institute"),
    "International Institutions and Multilateral Organisations": (
        "multilateral", "international institution", "world bank", "united nations",
    ),
    "International Development": ("international development", "development programme"),
    "Humanitarian Affairs and Emergency Response": ("humanitarian", "emergency response"),
    "Monitoring, Evaluation, Research and Learning": ("monitoring and evaluation", "mel"),
    "Energy and Commodities": ("energy trading", "commodities"),
    "Oil and Gas": ("oil and gas",),
    "Environmental Risk Management": ("environmental risk", "environmental assessment"),
    "Climate Strategy": ("climate strategy", "decarbonisation", "energy transition"),
    "ESG and Responsible Investment": ("esg", "responsible investment", "sustainability"),
    "Geospatial Analysis and GIS": ("geospatial", "qgis", "gis", "location intelligence"),
    "Public and Global Health": ("global health", "public health"),
    "Health Policy and Health Economics": ("health policy", "health economics"),
    "Pharmaceutical and Healthcare": ("pharmaceutical", "market access", "healthcare"),
    "Supply Chain and Procurement": ("supply chain", "procurement"),
    "Logistics and Emergency Operations": ("logistics", "emergency operations"),
    "Communications and Stakeholder Engagement": ("stakeholder engagement", "strategic communications"),
    "Corporate Responsibility and Social Impact": ("corporate responsibility", "social impact"),
    OTHER: (),
}

GRADUATION = (
    "graduate in 2028",
    "graduating in 2028",
    "graduation year 2028",
    "anticipated graduation date summer 2028",
    "completion time frame between june 2027 and july 2028",
    "completion timeframe between june 2027 and july 2028",
)

VERIFIED = {
    "graduation_2028": GRADUATION,
    "penultimate_year": ("penultimate year",),
    "second_year": ("second year",),
    "any_degree": ("any degree", "all degree disciplines", "any discipline"),
    "non_law": ("non law",),
}

LIKELY = {"broad_undergraduate": ("undergraduate students", "current undergraduate", "undergraduates")}

HARD_EXCLUSIONS = (
    "graduates only", "completed degree required", "final year only", "law degree only",
    "llb required", "software engineer", "quantitative researcher",
    "quantitative research internship", "quant researcher", "quant research internship",
    "quantitative trader", "quantitative trading internship", "quant trader",
    "quant trading internship", "quantitative developer", "quant developer",
    "machine learning engineer", "computer science degree required", "engineering degree required",
    "mathematics degree required", "medical degree required", "laboratory scientist",
    "campus ambassador", "retail assistant", "hospitality assistant", "fundraising volunteer",
    "social media volunteer", "election campaign volunteer", "unpaid", "c++ required",
    "c++ is required", "must have c++", "proficiency in c++", "proficient in c++",
    "strong c++ skills", "strong c++ programming skills", "advanced c++",
    "commercial c++ experience", "professional c++ experience", "c++ programming experience",
    "experience programming in c++", "experience with c++ required",
)

POSITIVE = {
    "legal_risk": ("legal", "compliance", "regulatory", "risk"),
    "investment_diligence": ("due diligence", "financial analysis", "valuation", "financial modelling"),
    "research_policy": ("research", "analysis", "policy", "parliament", "briefing"),
    "climate_development": ("climate", "environmental risk", "humanitarian", "development"),
    "health": ("public health", "health policy", "health economics", "healthcare consulting"),
    "commercial": ("investment", "banking", "insurance", "real estate", "commercial analysis"),
    "operations": ("stakeholder", "programme management", "project management", "supply chain"),
    "geospatial": ("geospatial", "gis", "qgis", "location intelligence"),
}

SKILLS = {
    "analytical_tools": ("excel", "python", "spss"),
    "research_communication": ("research", "writing", "briefing", "evidence review"),
}

NEGATIVE = (
    "advanced software engineering", "computer science only", "advanced quantitative finance",
    "specialist machine learning", "engineering only", "clinical", "laboratory",
    "generic fundraising", "generic social media", "generic office administration",
    "election campaigning",
)

WEIGHTS = {
    "eligibility_strength": 20,
    "substantive_relevance": 35,
    "skill_alignment": 10,
    "organisation_quality": 10,
    "geographic_fit": 10,
    "recency": 5,
    "deadline_urgency": 5,
    "evidence_quality": 5,
}

RULE_IDS = {
    "graduation_2028": "graduation.2028",
    "penultimate_year": "study.penultimate",
    "second_year": "study.second_year",
    "any_degree": "degree.any",
    "non_law": "degree.non_law",
    "broad_undergraduate": "study.broad_undergraduate",
}

REASONS = {
    "legal_risk": "Legal, compliance, regulatory or risk work aligns with prior experience",
    "investment_diligence": "Uses investment due diligence, valuation or financial-analysis skills",
    "research_policy": "Uses research, analysis and written briefing skills",
    "climate_development": "Relevant to climate, resilience, humanitarian or development study",
    "health": "Relevant to health policy, global health or healthcare consulting",
    "commercial": "Provides substantive financial or commercial analysis",
    "operations": "Uses stakeholder, programme or operational coordination skills",
    "geospatial": "Matches geospatial and location-analysis experience",
    "communications": "Involves substantive strategic communications or public affairs",
}

TITLE_INCLUSIONS = (
    "intern", "internship", "vacation scheme", "insight programme", "insight program",
    "work experience", "summer analyst", "trainee", "assistant", "caseworker", "researcher",
    "coordinator", "officer", "organiser", "administrator", "analyst", "associate", "adviser",
    "advisor", "executive", "consultant", "project support", "programme support",
    "program support", "programme", "program", "paralegal", "placement", "admin",
    "administrative", "support", "clerk", "facilitator", "tutor", "secretary",
    "customer service", "communications", "marketing", "fundraising", "finance", "research",
    "policy", "operations", "business", "commercial", "governance", "compliance", "risk",
    "development", "events", "engagement", "outreach", "admissions", "registry", "careers",
    "welfare", "co ordinator",
)

TITLE_EXCLUSIONS = (
    "graduate", "graduate scheme", "graduate programme", "graduate program", "graduate job",
    "manager", "senior", "head of", "director", "chief", "principal", "supervisor", "lead",
    "leader", "apprentice", "school leaver", "campus ambassador", "reception", "receptionist",
    "front of house", "front desk", "switchboard", "nursery", "early years", "childcare",
    "child care", "preschool", "pre school", "room leader", "nanny", "babysitter", "playworker",
    "play worker", "teaching assistant", "learning support assistant", "classroom assistant",
    "kitchen assistant", "catering assistant", "assistant chef", "sales assistant",
    "gas engineer", "java developer", "locum", "business studies teacher", "pharmacy assistant",
    "therapy assistant", "machine learning", "natural language processing", "software engineer",
    "software developer", "data science", "quant research", "quantitative research",
    "quant researcher", "quantitative researcher", "quantitative analyst",
    "quantitative finance", "quantitative strategies", "quantitative trading", "quant trading",
    "quant trader", "quantitative developer", "quant developer", "systematic researcher",
    "systematic trading", "algorithmic trading", "quants", "engineering internship",
    "engineering summer internship", "solutions engineer", "architecture intern", "actuarial",
    "professor", "lecturer", "lecturers", "research fellow", "research fellows",
    "clinical fellow", "doctor", "nurse", "midwife", "radiographer", "psychologist",
    "psychotherapist", "therapist", "pharmacist", "physiotherapist", "occupational therapist",
    "dentist", "medical prescriber", "healthcare assistant", "care assistant", "solicitor",
    "volunteer", "palliative care", "clinical advisor", "clinical adviser",
    "12 month placement", "industrial placement", "year in industry", "summer 2026",
    "start date march april 2026",
)

CONTEXT_EXCLUSIONS = {
    "public_health": (
        "consultant", "locum", "general practitioner", "psychiatrist", "surgeon", "anaesthetist",
        "pathologist", "cardiologist", "ophthalmologist", "neurologist", "dermatologist",
        "paediatric", "gynaecologist", "orthopaedic", "nursing", "physiotherapy", "radiograph",
        "pharmacy", "kitchen assistant", "housekeeping assistant", "catering assistant",
        "activities assistant", "care support assistant", "allied health professional",
        "practitioner", "psychological", "therapy", "radiographic", "support worker", "catering",
        "engineer", "surgical", "physician", "medical officer",
    ),
    "higher_education": (
        "postdoctoral", "post doctoral", "research associate", "dean", "reader",
        "programme leader", "program leader", "subject lead",
    ),
}

PROGRAMMES = Programmes(
    vacation_phrase="vacation scheme",
    vacation_seasons=(
        ("winter 2026", "winter_vacation_scheme_2026"),
        ("spring 2027", "spring_vacation_scheme_2027"),
        ("summer 2027", "summer_vacation_scheme_2027"),
    ),
    summer_phrases=("summer 2027", "2027 summer"),
    summer_type="summer_internship_2027",
    summer_months=(6, 7, 8),
    summer_year=2027,
    cycle_phrases=("2026 27", "2027"),
    topics=(
        ("parliamentary_office_internship", ("parliament", "member of parliament", "mp office")),
        ("policy_research_internship", ("policy", "think tank")),
        ("development_humanitarian_internship", ("humanitarian", "international development")),
        ("international_institution_internship", ("world bank", "united nations", "multilateral")),
        ("environmental_esg_internship", ("environment", "climate", "esg", "sustainability")),
        ("healthcare_health_policy_internship", ("health policy", "health economics", "healthcare consulting")),
        ("commercial_operations_internship", ("supply chain", "procurement", "commercial analysis")),
        ("selective_insight_programme", ("insight programme", "insight program")),
        ("short_professional_internship", ("short internship", "professional internship")),
    ),
    unstated_type="cycle_unstated_recent_role",
    parliamentary_type="parliamentary_office_internship",
)

MISSION_TYPES = ("charity", "ngo", "foundation", "nonprofit")


def default_rules() -> RuleSet:
    return RuleSet(
        categories=CATEGORIES,
        verified=VERIFIED,
        likely=LIKELY,
        hard_exclusions=HARD_EXCLUSIONS,
        positive=POSITIVE,
        skills=SKILLS,
        negative=NEGATIVE,
        weights=WEIGHTS,
        programmes=PROGRAMMES,
        rule_ids=RULE_IDS,
        reasons=REASONS,
        controlled_types=(*MISSION_TYPES, "think_tank"),
        paid_types=(*MISSION_TYPES, "think_tank"),
        selective_types=MISSION_TYPES,
        approved_tiers=("priority", "major", "approved"),
        title_inclusions=TITLE_INCLUSIONS,
        title_exclusions=TITLE_EXCLUSIONS,
        context_exclusions=CONTEXT_EXCLUSIONS,
        excluded_publishers=("beyond academy", "the intern group"),
        london_terms=("london", "greater london", "westminster"),
        remote_terms=("remote uk", "united kingdom remote", "remote within the uk"),
        multi_terms=("multiple locations", "various locations", "uk wide"),
        selectivity_terms=("selective", "competitive", "structured internship programme"),
        final_year_pattern=r" final year (students? )?only ",
        third_year_terms=("relevant for 3rd year",),
        first_year_terms=("relevant for 1st year",),
        second_year_terms=("2nd year", "second year"),
        law_final_terms=("final year non law",),
        law_stages=(
            (
                "penultimate year",
                ("non law", "any degree", "all degree disciplines", "all penultimate year undergraduates"),
            ),
            ("second year", ("non law", "any degree", "any discipline", "all degree disciplines")),
        ),
        british_terms=("british", "uk national"),
        commonwealth_terms=("new zealand", "commonwealth citizen", "commonwealth citizens"),
        degree_terms=(
            "any degree", "all degree disciplines", "any discipline", "non law", "law degree", "llb",
            "computer science degree", "engineering degree", "mathematics degree", "medical degree",
        ),
        study_terms=("penultimate year", "second year", "final year", "undergraduate"),
        graduation_terms=GRADUATION,
    )
