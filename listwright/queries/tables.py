"""Listing tables derived by Spark from the driver tables, and the same tables in SQL.

Each document is read as one listing of the board in ``source``; its labels give pay and reviewed
decisions. The phrase tables hold words that occur in the documents' four languages.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright import schema
from listwright.functions import text
from listwright.operators.classify import classify
from listwright.queries.base import spread, s_any, s_fragments, s_has, s_list, s_norm, s_strip, table
from listwright.rules import RuleSet, default_rules
from listwright.rules.ruleset import OTHER, Programmes

C = F.col
NOW = "2026-02-20 12:00:00"
TODAY = dt.date(2026, 2, 20)


def now():
    return F.lit(NOW).cast("timestamp")


PROGRAMMES = Programmes(
    vacation_phrase="license",
    vacation_seasons=(
        ("mit license", "winter_vacation_scheme_2026"),
        ("apache license", "spring_vacation_scheme_2027"),
        ("gnu general public license", "summer_vacation_scheme_2027"),
    ),
    summer_phrases=("summer 2027",),
    summer_type="summer_internship_2027",
    summer_months=(6, 7, 8),
    summer_year=2027,
    cycle_phrases=("2026 27",),
    topics=(
        ("parliamentary_office_internship", ("the the",)),
        ("policy_research_internship", ("de la", "und der")),
        ("environmental_esg_internship", ("of the", "this is")),
    ),
    unstated_type="cycle_unstated_recent_role",
    parliamentary_type="parliamentary_office_internship",
)

RULES: RuleSet = replace(
    default_rules(),
    categories={
        "English Prose": ("of the", "and the", "to the", "with the", "this is"),
        "French Prose": ("de la", "que le", "dans la", "pour le", "avec la"),
        "German Prose": ("und der", "die und", "mit der", "von der", "sich auf"),
        "Spanish Prose": ("que el", "en el", "los que", "por la", "con el"),
        "Licensing and Terms": ("license", "apache license", "mit license", "gnu general public license"),
        "Contact & Access": ("token", "mail1", "mail3", "mail8", "example com"),
        "Climate Notes": ("the a", "a the", "ge n"),
        OTHER: (),
    },
    verified={
        "open_release": ("mit license", "apache license"),
        "english_line": ("of the", "to the", "and the"),
        "german_line": ("und der", "die und"),
    },
    likely={"short_words": ("en", "de", "der")},
    hard_exclusions=("token", "gnu general public license", "rewh rewh", "orre orre", "mail3"),
    positive={
        "english": ("that", "from the", "by the"),
        "french": ("avec", "pour"),
        "german": ("nicht", "sich", "auch"),
        "spanish": ("los", "para"),
        "terms": ("license", "released under", "licensed under"),
    },
    skills={"joining": ("with", "avec", "mit", "con"), "pointing": ("this", "das", "est")},
    negative=("copyright", "the the the the", "mail8"),
    programmes=PROGRAMMES,
    rule_ids={"open_release": "release.open"},
    reasons={"english": "Reads as English", "terms": "States its terms"},
    title_inclusions=("the", "la", "der", "que", "die", "of", "et", "en", "is"),
    title_exclusions=("copyright", "spam", "und", "ci n"),
    context_exclusions={"public_health": ("of", "de"), "higher_education": ("the",)},
    excluded_publishers=("src9 en",),
    selectivity_terms=("with the", "and the", "de la"),
    final_year_pattern=r" (this|that) (is )?the ",
    third_year_terms=("on the",),
    first_year_terms=("in the",),
    second_year_terms=("to", "a"),
    law_final_terms=("is the",),
    law_stages=(("the", ("of", "and")), ("license", ("under",))),
    degree_terms=("mit license", "of the", "la de"),
    study_terms=("und der", "the and"),
    graduation_terms=("de la",),
)


def documents(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


def _idx():
    return F.expr("cast(substring(source, 4) as int)")


def registry(spark: SparkSession, d: str) -> DataFrame:
    i = _idx()
    cols = {
        "id": C("source"),
        "canonical_name": F.concat(F.lit("Board "), "source"),
        "organisation_type": organisation(i),
        "careers_url": F.concat(F.lit("https://"), "source", F.lit(".example.com/careers")),
        "ats_type": F.lit("generic_json"),
        "endpoint": F.concat(F.lit("https://"), "source", F.lit(".example.com/jobs")),
        "source_authority": authority(i),
        "enabled": i % 10 != 9,
        "priority_tier": F.element_at(F.array(*[F.lit(t) for t in ("priority", "major", "approved", "review")]), i % 4 + 1),
        "uk_priority_exception": i % 7 == 3,
        "exception_reason": F.when(i % 7 == 3, "National programme"),
        "poll_interval_minutes": (i % 4) * 60,
        "result_cap": F.when(i % 6 == 5, 40),
        "expected_min_items": F.lit(1),
        "monitor_only": i % 8 == 7,
        "manual_review_required": (i % 6 == 5) | (i == 4),
        "required_settings": F.when(i == 11, F.array(F.lit("BOARD_KEY"))).otherwise(F.array().cast("array<string>")),
        "request_method": F.lit("GET"),
        "notes": F.lit("note"),
        "source_ord": i,
    }
    rows = table(spark, d, "documents").select("source").distinct()
    fields = schema_fields(schema.REGISTRY)
    return rows.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def schema_fields(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


AUTHORITIES = (
    "official_ats", "official_careers_page", "official_programme_page", "official_government_portal",
    "trusted_sector_board", "discovery_only_source",
)
ORGANISATIONS = ("corporate", "charity", "law_firm", "think_tank", "public_health", "higher_education", "ngo")
PLACES = ("London", "Westminster, London", "Manchester", "Remote UK", "", "London; Leeds", "Hybrid - London", "UK")


def authority(i):
    return F.element_at(F.array(*[F.lit(a) for a in AUTHORITIES]), i % len(AUTHORITIES) + 1)


def organisation(i):
    return F.element_at(F.array(*[F.lit(a) for a in ORGANISATIONS]), i % len(ORGANISATIONS) + 1)


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Raw listing table: one row per document."""
    i, n = _idx(), C("doc_id")
    lines = F.split("text", "\n")
    link = F.concat(F.lit("https://"), "source", F.lit(".example.com//jobs/"), F.md5("text"), F.lit("/?utm_source=feed&lang="), "lang")
    cols = {
        "source_id": C("source"),
        "source_identifier": n.cast("string"),
        "employer": F.concat_ws(" ", "source", "lang"),
        "title": lines[0],
        "source_url": F.concat(F.lit("https://"), "source", F.lit(".example.com/listing/"), n.cast("string")),
        "application_url": link,
        "source_type": F.lit("generic_json"),
        "source_authority": authority(i),
        "listing_publisher": F.when(n % 3 == 0, F.concat(F.lit("publisher "), (n % 5).cast("string"))),
        "organisation_type": organisation(i),
        "division": F.when(n % 9 == 4, F.concat(F.lit("Division "), (n % 2).cast("string"))),
        "location": F.element_at(F.array(*[F.lit(p) for p in PLACES]), (n % len(PLACES)).cast("int") + 1),
        "location_type": F.lit("unknown"),
        "description": C("text"),
        "published_date": F.date_add(F.lit(dt.date(2026, 1, 1)), (n % 60).cast("int")),
        "opening_date": F.when(n % 17 == 0, F.date_add(F.lit(dt.date(2026, 2, 1)), (n % 40).cast("int"))),
        "deadline": F.when(n % 3 > 0, F.date_add(F.lit(dt.date(2026, 2, 1)), (n * 7 % 60).cast("int"))),
        "programme_start": F.when(n % 19 == 5, F.date_add(F.lit(dt.date(2027, 5, 1)), (n % 120).cast("int"))),
        "paid": F.when(C("toxic") == 1, False).when(C("quality") == 1, True),
        "paid_evidence": F.when(C("quality") == 1, "labelled"),
        "eligibility_text": F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")),
        "nationality_requirements": F.when(n % 11 == 0, F.array(F.lit("British citizens")))
        .when(n % 11 == 1, F.array(F.lit("Commonwealth citizens")))
        .when(n % 11 == 2, F.array(F.lit("French"))),
        "residency_requirements": F.when(n % 13 == 0, F.array(F.lit("Resident for 3 years"))),
        "explicitly_closed": n % 23 == 0,
        "cycle_hint": F.when(n % 5 == 0, "2026/27").when(n % 5 == 1, "Summer 2027"),
        "category_hint": F.when(n % 29 == 0, "French Prose"),
        "secondary_tags": F.when(n % 31 == 0, F.array(F.lit("German Prose"), F.lit("No Such Tag"))),
        "source_ord": i,
        "page_no": (n / 1024).cast("int"),
        "position": (n % 1024).cast("int"),
    }
    fields = schema_fields(schema.RAW)
    return documents(spark, d).select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed decisions from the labels."""
    docs = documents(spark, d).filter("quality = 1 and doc_id % 10 = 0")
    ident = text.stable_id(F.concat_ws(" ", "source", "lang"), F.lit("generic_json"), C("doc_id").cast("string"))
    n = C("doc_id")
    return docs.select(
        ident.alias("role_id"),
        F.when(n % 20 == 0, "manual_approved").alias("eligibility_status"),
        F.when(n % 30 == 0, "credible_match").alias("relevance_status"),
        (n % 40 == 0).alias("email_approved"),
        F.when(n % 50 == 0, "london").alias("geographic_scope"),
        F.lit("Reviewed label").alias("reason"),
        F.concat(F.lit("https://review.example.com/"), n.cast("string")).alias("evidence_url"),
        F.lit("2026-02-01").cast("timestamp").alias("reviewed_at"),
    )


@lru_cache(maxsize=4)
def records(spark: SparkSession, d: str) -> DataFrame:
    """Lazy; only the plan is remembered, because building it takes seconds."""
    return classify(listings(spark, d), registry(spark, d), overrides(spark, d), RULES, now())


# --- the same in SQL ------------------------------------------------------------------------

S_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"


def s_redact(x: str) -> str:
    return f"regexp_replace({x}, '{S_EMAIL}', '[contact email on source]', 'g')"


REGISTRY_SQL = f"""
registry as (select *, 'Board ' || id as canonical_name, {s_list(ORGANISATIONS)}[i % {len(ORGANISATIONS)} + 1] as organisation_type,
  {s_list(AUTHORITIES)}[i % 6 + 1] as source_authority, i % 10 <> 9 as enabled,
  ['priority', 'major', 'approved', 'review'][i % 4 + 1] as priority_tier, i % 7 = 3 as uk_priority_exception,
  (i % 4) * 60 as poll_interval_minutes, case when i % 6 = 5 then 40 end as result_cap, 1 as expected_min_items,
  i % 8 = 7 as monitor_only, i % 6 = 5 or i = 4 as manual_review_required,
  'https://' || id || '.example.com/jobs' as endpoint
  from (select distinct source as id, cast(substr(source, 4) as integer) as i from documents))
"""

LISTINGS_SQL = f"""
{REGISTRY_SQL},
docs as (select d.doc_id as n, d.text, d.lang, d.source, cast(substr(d.source, 4) as integer) as i, l.quality, l.toxic
  from documents d left join labels l using (doc_id)),
listings as (select n, i, lang, text, source as source_id, source || ' ' || lang as employer,
  split_part(text, chr(10), 1) as title,
  'https://' || source || '.example.com/listing/' || n as source_url,
  'https://' || source || '.example.com//jobs/' || md5(text) || '/?utm_source=feed&lang=' || lang as application_url,
  {s_list(AUTHORITIES)}[i % 6 + 1] as source_authority,
  {s_list(ORGANISATIONS)}[i % {len(ORGANISATIONS)} + 1] as organisation_type,
  case when n % 3 = 0 then 'publisher ' || (n % 5) end as listing_publisher,
  case when n % 9 = 4 then 'Division ' || (n % 2) end as division,
  {s_list(PLACES)}[n % {len(PLACES)} + 1] as location, {s_redact('text')} as description,
  date '2026-01-01' + cast(n % 60 as integer) as published_date,
  case when n % 17 = 0 then date '2026-02-01' + cast(n % 40 as integer) end as opening_date,
  case when n % 3 > 0 then date '2026-02-01' + cast(n * 7 % 60 as integer) end as deadline,
  case when n % 19 = 5 then date '2027-05-01' + cast(n % 120 as integer) end as programme_start,
  case when toxic = 1 then false when quality = 1 then true end as paid,
  case when quality = 1 then 'labelled' end as paid_evidence,
  {s_redact("split_part(text, chr(10), 2)")} as eligibility_text,
  case n % 11 when 0 then 'British citizens' when 1 then 'Commonwealth citizens' when 2 then 'French' end as nationality,
  case when n % 13 = 0 then 'Resident for 3 years' end as residency, n % 23 = 0 as explicitly_closed,
  case n % 5 when 0 then '2026/27' when 1 then 'Summer 2027' else '' end as cycle_hint,
  case when n % 29 = 0 then 'French Prose' end as category_hint, n % 31 = 0 as tagged, quality
  from docs),
overrides as (select substr(sha256({s_norm("source || ' ' || lang")} || '|generic_json|' || n), 1, 16) as id,
  case when n % 20 = 0 then 'manual_approved' end as o_eligibility, case when n % 30 = 0 then 'credible_match' end as o_relevance,
  n % 40 = 0 as o_mail, case when n % 50 = 0 then 'london' end as o_scope, 'https://review.example.com/' || n as o_url
  from docs where quality = 1 and n % 10 = 0)
"""


def _texts_sql() -> str:
    body = f"case when {s_strip('eligibility_text')} <> '' then {{}} else {{}} end"
    return f"""
texts as (select *, substr(sha256({s_norm('employer')} || '|generic_json|' || n), 1, 16) as id,
  {s_norm('title')} as n_title, {s_norm("title || ' ' || description")} as n_text,
  {s_norm("title || ' ' || description || ' ' || eligibility_text")} as n_all,
  {s_norm("title || ' ' || description || ' ' || cycle_hint")} as n_programme, {s_norm('eligibility_text')} as n_eligibility,
  {s_norm('cycle_hint')} as n_hint, {s_norm('location')} as n_place,
  {body.format(s_strip('eligibility_text'), s_strip('description'))} as stage_body,
  {body.format("'eligibility_text'", "'description'")} as stage_field from listings),
staged as (select *, {s_norm('stage_body')} as n_stage, t.n as doc_id from texts t)
"""


def _context_sql() -> str:
    p = RULES.programmes
    stated = "case when i % 6 < 4 then 'employer_stated' else 'unknown' end"
    topic = "case when i % 6 = 4 then 'unknown' else 'official_recruitment_page' end"
    seasons = " ".join(f"when {s_has('n_programme', phrase)} then '{kind}'" for phrase, kind in p.vacation_seasons)
    season_any = s_any("n_programme", [phrase for phrase, _ in p.vacation_seasons])
    topics = " ".join(f"when {s_any('n_programme', terms)} then '{kind}'" for kind, terms in p.topics)
    topic_any = " or ".join(s_any("n_programme", terms) for _, terms in p.topics)
    summer = "coalesce(year(programme_start) = 2027 and month(programme_start) in (6, 7, 8), false)"
    scheme = s_has("n_programme", p.vacation_phrase)
    named = s_any("n_programme", p.summer_phrases)
    cycle = s_any("n_hint", p.cycle_phrases)
    london = s_any("n_place", (*RULES.london_terms, *RULES.remote_terms))
    return f"""
context as (select s.*, r.priority_tier, r.manual_review_required, r.canonical_name,
  case when contains(n_place, 'hybrid') then 'hybrid' when {s_any('n_place', RULES.remote_terms)} then 'remote_uk'
    when {s_any('n_place', RULES.multi_terms)} or contains(location, ';') then 'multi_location'
    when n_place not in ('', 'unknown') then 'onsite' else 'unknown' end as location_type,
  case when {london} then 'london' when r.uk_priority_exception then 'uk_priority_exception'
    when n_place in ('', 'unknown', 'uk', 'united kingdom') then 'uncertain' else 'out_of_scope' end as scope0,
  case when {scheme} then case {seasons} else '{p.unstated_type}' end when {named} then '{p.summer_type}'
    when {summer} then '{p.summer_type}' when not {cycle} then '{p.unstated_type}' {topics} else '{p.unstated_type}' end as programme_type,
  case when {scheme} then case when {season_any} then {stated} else 'cycle_unstated' end when {named} then {stated}
    when {summer} then 'programme_dates' when not {cycle} then 'cycle_unstated' when {topic_any} then {topic}
    else 'cycle_unstated' end as cycle_provenance,
  case when source_authority = 'trusted_sector_board' then 'trusted_primary_listing'
    when source_authority = 'official_programme_page' then 'official_programme_page' else 'employer_stated' end as date_provenance,
  case when explicitly_closed then 'closed' when opening_date > date '2026-02-20' then 'upcoming' else 'open' end as status
  from staged s join (select id as rid, priority_tier, manual_review_required, canonical_name, uk_priority_exception from registry) r
    on r.rid = s.source_id)
"""


def _category_sql() -> str:
    cats = ", ".join(f"{{'c': '{name}', 't': {s_list([f' {t} ' for t in terms]) if terms else '[]::varchar[]'}}}" for name, terms in RULES.categories.items())
    return f"""
scored as (select *, list_transform([{cats}], lambda k: {{'s': 3 * len(list_filter(k.t, lambda t: contains(' ' || n_title || ' ', t)))
    + len(list_filter(k.t, lambda t: contains(' ' || n_text || ' ', t))), 'c': k.c,
    'x': len(list_filter(k.t, lambda t: contains(' ' || n_text || ' ', t))) > 0}}) as scores from context),
picked as (select *, coalesce(category_hint, case when list_reverse_sort(scores)[1].s > 0 then list_reverse_sort(scores)[1].c end,
  '{OTHER}') as primary_category from scored),
categorised as (select *, list_concat(case when tagged then ['German Prose'] else [] end,
  list_transform(list_filter(scores, lambda k: k.x and k.c <> primary_category and not (tagged and k.c = 'German Prose')), lambda k: k.c))
  as tags from picked)
"""


def _quote(terms: list[str] | str) -> str:
    """SQL list with the first fragment holding a term, or nothing."""
    if isinstance(terms, str):
        test = f"contains(p.w, ' ' || {terms} || ' ')"
    else:
        test = "(" + " or ".join(f"contains(p.w, ' {t} ')" for t in terms) + ")"
    return f"list_filter(pool, lambda p: {test})[1]"


def _ev(rule: str, fragment: str, fld: str) -> str:
    return f"{{'r': {rule}, 't': {fragment}, 'f': {fld}}}"


def _quoted(rule: str, terms) -> str:
    q = _quote(terms)
    whole = f"case when stage_body <> '' then stage_body else {s_strip('title')} end"
    return _ev(rule, f"coalesce({q}.t, {whole})", f"coalesce({q}.f, stage_field)")


def _eligibility_sql() -> str:
    r = RULES
    hard = f"list_filter({s_list(r.hard_exclusions)}, lambda t: contains(' ' || n_all || ' ', ' ' || t || ' '))[1]"
    law = " or ".join(f"({s_has('n_stage', stage)} and {s_any('n_stage', terms)})" for stage, terms in r.law_stages)
    vacation = ", ".join(f"'{v}'" for v in r.programmes.vacation_types)
    second = s_any("n_eligibility", r.second_year_terms)
    verified = [(name, terms) for name, terms in r.verified.items()]
    own = lambda name: f"'{r.rule_ids.get(name, 'eligibility.' + name)}'"
    likely = [(name, terms) for name, terms in r.likely.items()]
    verified_list = "list_filter([" + ", ".join(
        f"case when {s_any('n_stage', terms)} then {_quoted(own(name), list(terms))} end" for name, terms in verified
    ) + "], lambda e: e is not null)"
    likely_case = "case " + " ".join(
        f"when {s_any('n_stage', terms)} then {_quoted(own(name), list(terms))}" for name, terms in likely
    ) + " end"
    pool = " , ".join(
        f"list_transform({s_fragments(name)}, lambda p: {{'t': p, 'f': '{name}', 'w': ' ' || {s_norm('p')} || ' '}})"
        for name in ("eligibility_text", "description", "title")
    )
    note = "coalesce(paid_evidence, 'Paid status is not stated')"
    controlled = ", ".join(f"'{t}'" for t in r.paid_types)
    return f"""
decided as (select *, programme_type in ({vacation}) as law_path, {hard} as hard_term,
  flatten([{pool}]) as pool,
  case when nationality is null then 'none' when nationality = 'British citizens' then 'british'
    when nationality = 'Commonwealth citizens' then 'new_zealand' else 'other' end as nation from categorised),
stopped as (select *, case when scope0 = 'out_of_scope' then 'scope_out' when scope0 = 'uncertain' then 'scope_unknown'
  when paid = false then 'paid_false' when regexp_matches(' ' || n_all || ' ', '{r.final_year_pattern}') then 'final_year'
  when {s_has('n_all', 'unpaid')} then 'unpaid' when hard_term is not null then 'hard'
  when {s_any('n_eligibility', r.third_year_terms)} and not {second} then 'third_year'
  when {s_any('n_eligibility', r.first_year_terms)} and not {second} then 'first_year'
  when programme_type = '{r.programmes.parliamentary_type}' and paid is distinct from true then 'parliament_pay'
  when organisation_type in ({controlled}) and paid is distinct from true then 'controlled_pay'
  when law_path and {s_any('n_stage', r.law_final_terms)} then 'law_final' when law_path and not ({law}) then 'law_missing'
  when source_authority = 'discovery_only_source' then 'discovery' when nation = 'other' then 'nation_other'
  when residency is not null then 'security'
  when law_path or {' or '.join(s_any('n_stage', t) for _, t in verified)} then 'verified'
  when {' or '.join(s_any('n_stage', t) for _, t in likely)} then 'likely' else 'missing' end as stop from decided),
judged as (select *,
  case when stop in ('scope_out', 'paid_false', 'final_year', 'unpaid', 'hard', 'third_year', 'first_year', 'law_final') then 'ineligible'
    when stop = 'verified' then 'verified_eligible' when stop = 'likely' then 'likely_eligible' else 'uncertain' end as eligibility0,
  case when stop in ('security', 'verified', 'likely', 'missing') then case nation
    when 'british' then 'Known British citizenship meets the stated nationality element only.'
    when 'new_zealand' then 'Known New Zealand citizenship meets the stated nationality element only.' end end as nationality_assessment,
  list_concat(list_concat(
    case when law_path and stop in ('discovery', 'nation_other', 'security', 'verified', 'likely', 'missing')
      then [{_ev("'law.non_law_stage_verified'", 'stage_body', 'stage_field')}] else [] end,
    case when nation in ('british', 'new_zealand') and stop in ('security', 'verified', 'likely', 'missing')
      then [{_ev("'nationality.' || nation", 'nationality', "'nationality_requirements'")}] else [] end),
    case stop when 'scope_out' then [{_ev("'location.not_verified'", 'location', "'location'")}]
      when 'scope_unknown' then [{_ev("'location.not_verified'", 'location', "'location'")}]
      when 'paid_false' then [{_ev("'pay.unpaid'", "coalesce(paid_evidence, 'paid=false')", "'paid_evidence'")}]
      when 'final_year' then [{_quoted("'study.final_year_only'", ['final year'])}]
      when 'unpaid' then [{_quoted("'pay.unpaid'", ['unpaid'])}]
      when 'hard' then [{_quoted("'exclusion.' || replace(hard_term, ' ', '_')", 'hard_term')}]
      when 'third_year' then [{_ev("'study.third_year_only'", 'eligibility_text', "'eligibility_text'")}]
      when 'first_year' then [{_ev("'study.first_year_only'", 'eligibility_text', "'eligibility_text'")}]
      when 'parliament_pay' then [{_ev("'pay.parliament_requires_paid'", note, 'null')}]
      when 'controlled_pay' then [{_ev("'pay.quality_controlled_organisation'", note, 'null')}]
      when 'law_final' then [{_quoted("'law.final_year_non_law_only'", list(r.law_final_terms))}]
      when 'law_missing' then [{_ev("'law.explicit_non_law_stage_missing'", "coalesce(nullif(stage_body, ''), 'No explicit eligible non-law study stage was found')", 'stage_field')}]
      when 'discovery' then [{_ev("'source.discovery_only'", "'Eligibility is plausible but must be verified on the employer''s application page'", 'null')}]
      when 'nation_other' then [{_ev("'nationality.not_established'", 'nationality', "'nationality_requirements'")}]
      when 'security' then [{_ev("'security.additional_requirement'", 'residency', "'residency_requirements'")}]
      when 'verified' then {verified_list} when 'likely' then [{likely_case}]
      else [{_ev("'eligibility.material_evidence_missing'", "coalesce(nullif(stage_body, ''), 'Material study-stage eligibility is not stated')", 'stage_field')}]
    end) as evidence0 from stopped)
"""


def _relevance_sql() -> str:
    r = RULES
    negative = [*r.negative, *r.hard_exclusions]
    excluded = f"list_filter({s_list(negative)}, lambda t: contains(' ' || n_text || ' ', ' ' || t || ' '))[1]"
    count = lambda table: " + ".join(f"({s_any('n_text', terms)})::int" for terms in table.values())
    types = lambda names: ", ".join(f"'{n}'" for n in names)
    reasons = ", ".join(
        f"case when {s_any('n_text', terms)} then '{r.reasons.get(name, f'Matches {name} evidence')}' end"
        for name, terms in r.positive.items()
    )
    return f"""
hits as (select *, {excluded} as excluded_term,
  {count(r.positive)} + (primary_category <> '{OTHER}')::int as substantive, {count(r.skills)} as skill,
  organisation_type in ({types(r.selective_types)}) and not {s_any('n_text', r.selectivity_terms)} as unselective,
  priority_tier in ({types(r.approved_tiers)}) as approved from judged),
related as (select *, excluded_term is not null or (organisation_type in ({types(r.controlled_types)}) and not approved) as blocked from hits),
reasoned as (select *, case when blocked then 'irrelevant' when unselective then 'borderline_relevance'
    when substantive >= 3 then 'strong_match' when substantive >= 1 then 'credible_match'
    when manual_review_required then 'borderline_relevance' else 'irrelevant' end as relevance0,
  case when excluded_term is not null then ['Excluded work: ' || excluded_term]
    when blocked then ['Organisation scale or selectivity has not been approved']
    else list_filter([{reasons}, case when skill > 0 then 'Uses relevant analytical, research or communication skills' end,
      case when primary_category <> '{OTHER}' then 'Falls within the approved ' || primary_category || ' category' end,
      case when unselective then 'Selectivity is not established for this charity, NGO or foundation role'
        when substantive >= 1 then null when manual_review_required then 'Substantive relevance requires manual review'
        else 'No substantive approved-category evidence found' end], lambda x: x is not null) end as reasons from related)
"""


def _score_sql() -> str:
    def ratio(column: str, values: dict) -> str:
        return f"case {column} " + " ".join(f"when '{k}' then {v:.1f}" for k, v in values.items()) + " else 0.0 end"

    w = RULES.weights
    part = lambda name, expr: f"round_even({w[name]}::double * ({expr})::double, 0)::int as c_{name}"
    left_days = "(deadline - date '2026-02-20')"
    age = "greatest(date '2026-02-20' - published_date, 0)"
    return f"""
overridden as (select t.* exclude (id), t.id as id, coalesce(o_eligibility, eligibility0) as eligibility_status,
  coalesce(o_relevance, relevance0) as relevance_status, coalesce(o_scope, scope0) as geographic_scope,
  coalesce(o_mail, false) as email_approved, o.id is not null as reviewed,
  list_concat(evidence0, case when o.id is not null then [{{'r': 'manual.override', 't': 'Reviewed label', 'f': 'manual_override'}}] else [] end) as evidence
  from reasoned t left join overrides o on o.id = t.id),
parts as (select *,
  {part('eligibility_strength', ratio('eligibility_status', schema.ELIGIBILITY_RATIO))},
  {part('substantive_relevance', 'case when blocked then 0 else least(1.0, substantive / 3.0::double) end')},
  {part('skill_alignment', 'case when blocked then 0 else least(1.0, skill / 2.0::double) end')},
  {part('organisation_quality', 'approved::int')}, {part('geographic_fit', ratio('geographic_scope', schema.GEOGRAPHY_RATIO))},
  {part('recency', f'case when {age} <= 7 then 1.0 when {age} <= 30 then 0.5 else 0.0 end')},
  {part('deadline_urgency', f'case when {left_days} between 0 and 14 then 1.0 when {left_days} between 15 and 30 then 0.5 else 0.0 end')},
  {part('evidence_quality', ratio('source_authority', schema.AUTHORITY_RATIO))} from overridden),
summed as (select *, {' + '.join(f'c_{n}' for n in w)} as full_score from parts),
records as (select *, case when eligibility_status in ('ineligible', 'uncertain') then least(full_score, 49) else full_score end as match_score,
  source_url as canonical_url,
  'https://' || source_id || '.example.com/jobs/' || md5(text) || '?lang=' || lang as apply_url,
  case when i % 6 >= 3 then employer else canonical_name end as canonical_employer,
  manual_review_required and not reviewed as review_required,
  substr({s_strip('description')}, 1, 500) as excerpt,
  cast(i as bigint) * 1099511627776 + (n // 1024) * 1048576 + n % 1024 as ord from summed)
"""


RECORDS_SQL = "with " + ",".join(
    s.strip()
    for s in (LISTINGS_SQL, _texts_sql(), _context_sql(), _category_sql(), _eligibility_sql(), _relevance_sql(), _score_sql())
)


def s_public(live: str = "status <> 'closed'") -> str:
    return f"""(eligibility_status in ('verified_eligible', 'likely_eligible', 'manual_approved')
  and (relevance_status in ('strong_match', 'credible_match') or (relevance_status = 'borderline_relevance' and reviewed))
  and not review_required and {live} and geographic_scope in ('london', 'uk_priority_exception')
  and source_authority <> 'discovery_only_source' and paid is distinct from false)"""


def s_possible() -> str:
    r = RULES
    title = s_norm("title")
    full = s_norm("title || ' ' || excerpt")
    context = " or ".join(
        f"(organisation_type = '{kind}' and {s_any(title, terms)})" for kind, terms in r.context_exclusions.items()
    )
    seller = f"(source_authority = 'discovery_only_source' and {s_norm('canonical_employer')} in ({', '.join(repr(p) for p in r.excluded_publishers)}))"
    return f"""(not {s_public()} and status = 'open' and eligibility_status <> 'ineligible' and relevance_status <> 'irrelevant'
  and {s_any(title, r.title_inclusions)} and not {s_any(title, r.title_exclusions)} and not {s_any(full, r.hard_exclusions)}
  and not ({context}) and not {seller} and geographic_scope in ('london', 'uk_priority_exception') and paid is distinct from false)"""
