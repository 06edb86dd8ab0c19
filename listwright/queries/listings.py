"""Classification, tiers, serving and digest queries over listings derived from the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listwright.functions import text
from listwright.operators import classify as K
from listwright.operators import digest as G
from listwright.operators import quality, serving
from listwright.operators.phrases import first_phrase, phrase_hits
from listwright.plans import serve
from listwright.queries.base import query, s_norm, s_strip, spread, table
from listwright.queries.tables import (
    RECORDS_SQL,
    RULES,
    listings,
    now,
    overrides,
    records,
    registry,
    s_possible,
    s_public,
)
from listwright.session import cut

C = F.col


@query(
    "flagship_publishable",
    f"""{RECORDS_SQL} select id, canonical_employer as employer, {s_strip('title')} as title, primary_category, eligibility_status, match_score from records
    where {s_public()} order by match_score desc, id limit 100""",
)
def flagship_publishable(spark, d):
    public = records(spark, d).filter(K.is_public())
    return public.orderBy(F.desc("match_score"), "id").limit(100).select(
        "id", C("canonical_employer").alias("employer"), "title", "primary_category", "eligibility_status", "match_score"
    )


@query(
    "classify_listings",
    f"""{RECORDS_SQL} select doc_id, id, location_type, geographic_scope, programme_type, cycle_provenance, date_provenance, status,
    primary_category, array_to_string(tags, '|') as tags, eligibility_status, relevance_status,
    array_to_string(reasons, '|') as reasons, match_score, nationality_assessment, apply_url as application_url, canonical_employer,
    email_approved, review_required from records""",
)
def classify_listings(spark, d):
    return records(spark, d).select(
        C("source_identifier").cast("bigint").alias("doc_id"), "id", "location_type", "geographic_scope", "programme_type",
        "cycle_provenance", "date_provenance", "status", "primary_category", F.array_join("secondary_tags", "|").alias("tags"),
        "eligibility_status", "relevance_status", F.array_join("relevance_reasons", "|").alias("reasons"), "match_score",
        "nationality_assessment", "application_url", "canonical_employer", "email_approved",
        C("publication_review_required").alias("review_required"),
    )


@query(
    "rule_chain_evidence",
    f"""{RECORDS_SQL} select doc_id, u.e.r as rule_id, md5(coalesce(u.e.t, '')) as quoted, u.e.f as field
    from records, unnest(evidence) as u(e)""",
)
def rule_chain_evidence(spark, d):
    df = records(spark, d).select(C("source_identifier").cast("bigint").alias("doc_id"), F.explode("eligibility_evidence").alias("e"))
    return df.select(
        "doc_id", C("e.rule_id").alias("rule_id"), F.md5(F.coalesce("e.text", F.lit(""))).alias("quoted"),
        C("e.structured_field").alias("field"),
    )


@query(
    "weighted_score",
    f"""{RECORDS_SQL} select doc_id, match_score, {', '.join(f'c_{n}' for n in RULES.weights)} from records""",
)
def weighted_score(spark, d):
    return records(spark, d).select(
        C("source_identifier").cast("bigint").alias("doc_id"), "match_score",
        *[C("match_components")[n].alias(f"c_{n}") for n in RULES.weights],
    )




@query(
    "phrase_hits",
    f"""with d as (select doc_id, {s_norm('text')} as n from documents),
    t as (select * from (values {", ".join(f"('{name}', '{t}', {i})" for i, (name, t) in enumerate((n, t) for n, ts in RULES.categories.items() for t in ts))}) v(rule, term, ord))
    select doc_id, rule, term, ord from d join t on contains(' ' || n || ' ', ' ' || term || ' ')""",
)
def phrase_hits_query(spark, d):
    """Join form of the phrase engine: n-grams against the phrase table."""
    docs = spread(table(spark, d, "documents")).select("doc_id", text.normalise_text(C("text")).alias("n"))
    phrases = RULES.table(spark).filter("kind = 'categories'").withColumn("phrase", text.normalise_text(C("term")))
    return phrase_hits(docs, "doc_id", C("n"), phrases).select("doc_id", "rule", "term", "ord")


@query(
    "first_phrase",
    f"""with d as (select doc_id, {s_norm('text')} as n from documents),
    t as (select * from (values {", ".join(f"('{t}', {i})" for i, t in enumerate(RULES.hard_exclusions))}) v(term, ord))
    select doc_id, arg_min(term, ord) as term from d join t on contains(' ' || n || ' ', ' ' || term || ' ') group by doc_id""",
)
def first_phrase_query(spark, d):
    docs = spread(table(spark, d, "documents")).select("doc_id", text.normalise_text(C("text")).alias("n"))
    phrases = RULES.table(spark).filter("kind = 'hard_exclusions'").withColumn("phrase", text.normalise_text(C("term")))
    return first_phrase(phrase_hits(docs, "doc_id", C("n"), phrases), "doc_id").select("doc_id", "term")


@query(
    "registry_join",
    f"""{RECORDS_SQL} select r.priority_tier, r.canonical_name, count(*) as rows, sum((r.source_authority = l.source_authority)::int) as agree
    from listings l join registry r on r.id = l.source_id group by all""",
)
def registry_join(spark, d):
    df = K.join_registry(listings(spark, d), registry(spark, d))
    return df.groupBy(C("src.priority_tier").alias("priority_tier"), C("src.canonical_name").alias("canonical_name")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(C("src.source_authority") == C("source_authority")).alias("agree")
    )


@query(
    "override_join",
    f"{RECORDS_SQL} select id, eligibility_status, relevance_status, geographic_scope, email_approved from records where reviewed",
)
def override_join(spark, d):
    return records(spark, d).filter(C("manual_override").isNotNull()).select(
        "id", "eligibility_status", "relevance_status", "geographic_scope", "email_approved"
    )


@query(
    "tier_split",
    f"""{RECORDS_SQL} select id, case when {s_public()} then 'public' when {s_possible()} then 'possible'
    when status <> 'closed' and eligibility_status = 'uncertain' and relevance_status <> 'irrelevant' then 'review' else 'none' end as tier
    from records""",
)
def tier_split(spark, d):
    df = K.with_possible(records(spark, d), RULES)
    tier = F.when(K.is_public(), "public").when(C("is_possible"), "possible").when(K.needs_review(C("is_possible")), "review").otherwise("none")
    return df.select("id", tier.alias("tier"))


S_DIGEST = """((eligibility_status in ('verified_eligible', 'manual_approved') or (eligibility_status = 'likely_eligible' and email_approved))
  and (relevance_status in ('strong_match', 'credible_match') or (relevance_status = 'borderline_relevance' and reviewed))
  and status = 'open' and geographic_scope in ('london', 'uk_priority_exception') and source_authority <> 'discovery_only_source'
  and not review_required and paid is distinct from false)"""

S_GROUP = """case when eligibility_status = 'verified_eligible' then 0 when eligibility_status = 'manual_approved' then 1
  when deadline <= date '2026-02-27' then 2 when contains(programme_type, 'vacation_scheme') then 3
  when programme_type = 'summer_internship_2027' then 4
  when programme_type in ('policy_research_internship', 'parliamentary_office_internship') then 5 else 6 end"""

S_FOLD = "replace(lower({}), 'ß', 'ss')"
S_SELECTED = f"""{RECORDS_SQL}, chosen as (select *, {S_GROUP} as digest_group from records where {S_DIGEST} and doc_id % 4 <> 0),
  selected as (select *, row_number() over (order by digest_group, {S_FOLD.format('canonical_employer')}, {S_FOLD.format('title')}, ord) - 1 as position from chosen)"""


DIGEST_COLUMNS = (
    "id", "ord", "source_identifier", "title", "canonical_employer", "programme_type", "deadline", "last_seen_at", "source_authority",
    "eligibility_status", "relevance_status", "email_approved", "publication_review_required", "status", "geographic_scope", "paid",
    "manual_override",
)


def _digest_rows(spark, d):
    """What a digest reads of the records, derived once, and the ids that were sent."""
    stored = cut(records(spark, d).select(*DIGEST_COLUMNS), "digest")
    return stored, stored.filter(C("source_identifier").cast("bigint") % 4 == 0).select("id")


@query("digest_select", f"{S_SELECTED} select id, digest_group, position from selected")
def digest_select(spark, d):
    """Eligible rows seen since the last success and never sent, in digest order."""
    last = F.lit("2026-02-19").cast("timestamp")
    selected, _ = G.select_digest(*_digest_rows(spark, d), last, now())
    return selected.select("id", "digest_group", "position")


@query(
    "digest_id",
    f"""{S_SELECTED},
    leaves as (select position // 4096 as place, sha256(string_agg(id, '|' order by position)) as h from selected group by 1),
    nodes as (select place // 4096 as up, case when count(*) = 1 then any_value(h) else sha256(string_agg(h, '' order by place)) end as h from leaves group by 1),
    top as (select case when count(*) = 1 then any_value(h) else sha256(string_agg(h, '' order by up)) end as h from nodes)
    select substr(coalesce(h, sha256('')), 1, 20) as digest_id from top""",
)
def digest_id(spark, d):
    _, ident = G.select_digest(*_digest_rows(spark, d), None, now())
    return ident


@query("digest_eligible", f"{RECORDS_SQL} select id from records where {S_DIGEST}")
def digest_eligible(spark, d):
    return records(spark, d).filter(K.digest_eligible()).select("id")


# --- serving --------------------------------------------------------------------------------

S_FACETS = f"""{RECORDS_SQL}, facets as (select id, title, concat_ws(' ', nullif(title, ''), canonical_employer, division, nullif(excerpt, ''),
  primary_category, nullif(array_to_string(tags, ' '), ''), programme_type, organisation_type, nullif(location, '')) as search,
  primary_category as category, array_to_string(tags, '|') as tags, canonical_employer as employer, organisation_type as organisation,
  programme_type as programme, eligibility_status as eligibility, location, geographic_scope as geography,
  case when paid then 'paid' else 'unknown' end as paid, status,
  case when nationality is not null then 'required' else 'not-stated' end as nationality, priority_tier as tier,
  coalesce(deadline <= date '2026-02-27', false) as closing, match_score as score,
  case eligibility_status when 'verified_eligible' then 3 when 'manual_approved' then 3 when 'likely_eligible' then 2 when 'uncertain' then 1 else 0 end as evidence,
  coalesce(cast(deadline as varchar), '9999-12-31') as deadline, coalesce(cast(opening_date as varchar), '9999-12-31') as opening
  from (select * replace ({{title}} as title) from records))""".replace(
    "{title}", "regexp_replace(title, '^\\s+|\\s+$', '', 'g')"
)


def _facets(spark, d):
    return serving.facet_projection(records(spark, d), now(), F.lit("verified"))


@query("facet_projection", f"{S_FACETS} select * replace (md5(search) as search) from facets")
def facet_projection(spark, d):
    return _facets(spark, d).drop("relevance", "cycle", "authority", "listing", "new", "first_seen").withColumn(
        "search", F.md5("search")
    )


@query(
    "facet_values",
    f"""{S_FACETS} select 'employer' as facet, employer as value, count(*) as rows from facets group by all
    union all select 'tag', u.t, count(*) from records, unnest(tags) as u(t) group by all
    union all select 'programme', programme, count(*) from facets group by all""",
)
def facet_values(spark, d):
    facets = {"employer": "canonical_employer", "tag": "secondary_tags", "programme": "programme_type"}
    return serving.facet_table(records(spark, d), facets)


@query(
    "facet_labels",
    """select c_mktsegment as value, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as label, count(*) as rows from customer group by all""",
)
def facet_labels(spark, d):
    return serving.facet_values(table(spark, d, "customer"), "c_mktsegment")


@query(
    "dashboard_counters",
    f"""{RECORDS_SQL} select count(*) as listed, count(*) filter (status = 'open') as open_now, count(*) as new_day, count(*) as new_week,
    count(*) filter (deadline between date '2026-02-20' and date '2026-02-27') as closing_week,
    count(*) filter (programme_type = 'summer_internship_2027') as summer,
    count(*) filter (contains(programme_type, 'vacation_scheme')) as vacation,
    count(*) filter (programme_type in ('policy_research_internship', 'parliamentary_office_internship')) as policy,
    count(*) filter (contains(lower(primary_category), 'climate') or contains(lower(primary_category), 'environment')
      or contains(lower(primary_category), 'esg')) as environment,
    count(*) filter (programme_type in ('development_humanitarian_internship', 'international_institution_internship')) as development
    from records""",
)
def dashboard_counters(spark, d):
    return serving.counters(records(spark, d), now())


@query("programme_counts", f"{RECORDS_SQL} select programme_type, count(*) as rows from records group by all")
def programme_counts(spark, d):
    return serving.by_programme(records(spark, d))


def _s_search(x: str) -> str:
    return f"trim(regexp_replace(lower(replace(strip_accents(coalesce({x}, '')), '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


def _s_field(x: str, phrase: str) -> str:
    every = " and ".join(f"contains({x}, '{w}')" for w in phrase.split())
    return f"case when {x} = '{phrase}' then 100 when starts_with({x}, '{phrase}') then 75 when contains({x}, '{phrase}') then 50 when {every} then 20 else 0 end"


@query(
    "search_rank",
    f"""{S_FACETS}, s as (select *, {_s_search('title')} as t, {_s_search('search')} as b, {_s_search('employer')} as e from facets),
    f as (select *, 2 * ({_s_field('t', 'the on')}) + ({_s_field('b', 'the on')}) + 3 * ({_s_field('e', 'src')}) as search_score from s
      where contains(b, 'the') and contains(b, 'on') and contains(e, 'src') and contains(lower(category), 'prose')
        and contains({_s_search('geography')}, 'london'))
    select id, search_score, score from f order by search_score desc, score desc, id limit 50""",
)
def search_rank(spark, d):
    found = serve.find(
        _facets(spark, d), "The, on", "SRC", {"geography": "London"}, ["prose"], mode="score", limit=50
    )
    return found.select("id", "search_score", "score")


@query(
    "search_totals",
    f"""{S_FACETS}, n as (select count(*) as total from facets where contains({_s_search('search')}, 'der'))
    select total, least(total, 100) as shown, total > 100 as has_more from n""",
)
def search_totals(spark, d):
    from listwright.operators.ordered import with_totals

    return with_totals(serving.search_rows(_facets(spark, d), "der"), 100)


@query(
    "sort_modes",
    f"""{S_FACETS}, m as (select 'deadline' as mode, id, row_number() over (order by deadline, id) as pos from facets
      union all select 'evidence', id, row_number() over (order by evidence desc, id) from facets
      union all select 'opening', id, row_number() over (order by opening, id) from facets)
    select * from m where pos <= 20""",
)
def sort_modes(spark, d):
    """First page per sort mode, each a top-k instead of a full sort."""
    df, out = cut(_facets(spark, d).select("id", "deadline", "evidence", "opening"), "facets"), None
    for mode in ("deadline", "evidence", "opening"):
        order = [*serving.sort_mode(mode), F.asc("id")]
        # The window numbers the one page that the top-k kept.
        top = df.orderBy(*order).limit(20).select(
            F.lit(mode).alias("mode"), "id", F.row_number().over(Window.orderBy(*order)).alias("pos")
        )
        out = top if out is None else out.unionByName(top)
    return out


@query(
    "explain_record",
    f"""{RECORDS_SQL}, x as (select id, u.e.r as name, md5(coalesce(u.e.t, '')) as detail, 'evidence' as kind from records, unnest(evidence) as u(e)
      union all select id, 'relevance', md5(r), 'reason' from (select id, unnest(reasons) as r from records))
    select id, kind, name, detail from x""",
)
def explain_record(spark, d):
    df = serving.explain(records(spark, d)).filter("kind <> 'component'")
    return df.select("id", "kind", "name", F.md5(F.coalesce("detail", F.lit(""))).alias("detail"))


@query(
    "state_lookup",
    f"""{RECORDS_SQL}, ids as (select id from records order by id limit 5)
    select id, case when {s_public()} then 'public' else 'other' end as state_table, match_score from records where id in (select id from ids)""",
)
def state_lookup(spark, d):
    df = cut(records(spark, d).select("id", "match_score", K.is_public().alias("shown")), "tables")
    ids = [r.id for r in df.select("id").orderBy("id").limit(5).collect()]
    found = serving.lookup({"public": df.filter("shown"), "other": df.filter("not shown")}, ids)
    return found.select("id", "state_table", "match_score")


@query(
    "approve_requests",
    f"""{RECORDS_SQL}, asked as (select *, true as reviewed2 from records where doc_id % 6 = 1),
    ok as (select id from asked where relevance_status in ('strong_match', 'credible_match', 'borderline_relevance') and status <> 'closed'
      and geographic_scope in ('london', 'uk_priority_exception') and source_authority <> 'discovery_only_source' and paid is distinct from false)
    select id as role_id, 'Reviewed label' as reason from overrides where id not in (select id from ok)
    union all select id, 'Second review' from ok""",
)
def approve_requests(spark, d):
    read = ("id", "source_identifier", "eligibility_status", "relevance_status", "geographic_scope", "status", "source_authority", "paid")
    df = cut(records(spark, d).select(*read), "judged")
    kept = overrides(spark, d)
    asked = df.filter(C("source_identifier").cast("bigint") % 6 == 1).select(
        C("id").alias("role_id"), F.lit("manual_approved").alias("eligibility_status"), F.lit(None).cast("string").alias("relevance_status"),
        F.lit(False).alias("email_approved"), F.lit(None).cast("string").alias("geographic_scope"), F.lit("Second review").alias("reason"),
        F.lit("https://review.example.com/x").alias("evidence_url"), now().alias("reviewed_at"),
    )
    return serving.approve(kept, df, asked).select("role_id", "reason")


@query(
    "restrict_source_category",
    f"{RECORDS_SQL} select id, primary_category from records where source_id = 'src3' and primary_category = 'English Prose'",
)
def restrict_source_category(spark, d):
    raw = serving.restrict(listings(spark, d), source="src3")
    df = K.classify(raw, registry(spark, d), overrides(spark, d), RULES, now())
    return serving.restrict(df, category="english-prose").select("id", "primary_category")


@query(
    "public_export",
    f"{RECORDS_SQL} select count(*) as rows, sum(match_score) as score, 0 as override_columns from records where {s_public()}",
)
def public_export(spark, d):
    shown = serving.public_export(records(spark, d).filter(K.is_public()))
    leaked = int("manual_override" in shown.columns)
    return shown.agg(F.count(F.lit(1)).alias("rows"), F.sum("match_score").alias("score"), F.lit(leaked).alias("override_columns"))


@query(
    "refilter_possible",
    f"{RECORDS_SQL} select id from records where {s_possible()} and doc_id % 5 <> 0",
)
def refilter_possible(spark, d):
    """Every stored row re-tested with today's rules, minus the ids already verified."""
    df = records(spark, d)
    verified = df.filter(C("source_identifier").cast("bigint") % 5 == 0)
    return serving.refilter_possible(df, verified, RULES).select("id")


@query(
    "recently_closed",
    f"{RECORDS_SQL} select id from records where explicitly_closed and doc_id % 2 = 1 and doc_id % 30 <= 14",
)
def recently_closed(spark, d):
    n = C("source_identifier").cast("bigint")
    df = records(spark, d).withColumn("closed_at", F.when(C("closed_at").isNotNull(), now() - F.make_interval(days=(n % 30).cast("int"))))
    return serving.recently_closed(df.filter("status = 'closed'"), df.filter(n % 2 == 0), now()).select("id")


@query(
    "split_open_recent",
    f"""{RECORDS_SQL} select case when programme_type = 'cycle_unstated_recent_role' then 'recent' else 'open' end as part, count(*) as rows
    from records where {s_public()} group by all""",
)
def split_open_recent(spark, d):
    from listwright.operators.lifecycle import split_open_recent as split

    first, second = split(cut(records(spark, d).filter(K.is_public()).select("programme_type"), "public"))
    part = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
    return part(first, "open").unionByName(part(second, "recent")).filter("rows > 0")


# --- quality --------------------------------------------------------------------------------

# The columns that decide about a tier.
TIER_COLUMNS = (
    "id", "source_identifier", "title", "description_excerpt", "canonical_employer", "organisation_type", "source_authority",
    "eligibility_status", "relevance_status", "publication_review_required", "status", "geographic_scope", "paid", "manual_override",
)


@query(
    "check_boundary",
    f"""{RECORDS_SQL}, v as (select * from records where {s_public()} or doc_id % 50 = 3),
    p as (select * from records where {s_possible()} or doc_id % 50 = 7)
    select id as key, 'verified' as tier, 'unverified row in verified tier' as rule from v where eligibility_status in ('uncertain', 'ineligible')
    union all select id, 'verified', 'outside verified boundary' from v where not {s_public()}
    union all select id, 'possible', 'ineligible row in possible tier' from p where eligibility_status = 'ineligible'
    union all select id, 'possible', 'outside possible boundary' from p where not {s_possible()}""",
)
def check_boundary(spark, d):
    """Tiers with some misplaced rows put in."""
    # Both tiers and their checks read the same rows: what the checks look at is derived once.
    stored = cut(records(spark, d).select(*TIER_COLUMNS), "tiers")
    df = K.with_possible(stored, RULES)
    n = C("source_identifier").cast("bigint")
    verified = df.filter(K.is_public() | (n % 50 == 3)).drop("is_possible")
    possible = df.filter(C("is_possible") | (n % 50 == 7)).drop("is_possible")
    found = quality.check_boundary(verified, possible, RULES)
    return found.filter("rule <> 'override column published'").select("key", "tier", "rule")


@query(
    "check_schema",
    f"""{RECORDS_SQL} select 'table' as key, 'missing column email_approved' as rule union all select 'table', 'unknown column surprise'
    union all select id, 'value of status' from records where doc_id % 40 = 1""",
)
def check_schema(spark, d):
    from listwright.schema import RECORD

    n = C("source_identifier").cast("bigint")
    df = records(spark, d).drop("email_approved").withColumns(
        {"surprise": F.lit(1), "status": F.when(n % 40 == 1, "odd").otherwise(C("status"))}
    )
    return quality.check_schema(df, RECORD, "id")


@query(
    "check_registry",
    f"""{RECORDS_SQL} select id as key, 'enabled without endpoint' as rule from registry where enabled and i % 5 = 2
    union all select id, 'exception without reason' from registry where uk_priority_exception and i <> 3
    union all select id, 'discovery source without review' from registry where enabled and source_authority = 'discovery_only_source' and i % 12 = 11
    union all select id, 'repeated id' from registry where i = 6""",
)
def check_registry(spark, d):
    """Registry with faults put in: missing endpoints, reasons and review flags, one id twice."""
    i = C("source_ord")
    df = registry(spark, d).withColumns(
        {
            "endpoint": F.when(i % 5 == 2, F.lit(None)).otherwise(C("endpoint")),
            "exception_reason": F.when(i == 3, C("exception_reason")),
            "manual_review_required": C("manual_review_required") & (i % 12 != 11),
        }
    )
    return quality.check_registry(df.unionByName(df.filter("source_ord = 6")))


@query(
    "check_coverage",
    f"""{RECORDS_SQL} select id, 'both tiers' as side from records where doc_id % 60 = 1
    union all select id, 'left only' from records where doc_id % 60 = 1 or doc_id % 60 = 2
    union all select 'x' || id, 'right only' from records where doc_id % 60 = 2""",
)
def check_coverage(spark, d):
    # Five filters read the ids: they are derived once.
    df = cut(records(spark, d).select("id", C("source_identifier").cast("bigint").alias("n")), "ids")
    verified = df.filter("n % 2 = 0 or n % 60 = 1").select("id")
    possible = df.filter("n % 2 = 1").select("id")
    index = df.select(F.when(C("n") % 60 == 2, F.concat(F.lit("x"), "id")).otherwise(C("id")).alias("id"))
    return quality.check_coverage(verified, possible, index)


@query(
    "taxonomy_diff",
    f"""{RECORDS_SQL} select distinct primary_category as category, 'not in taxonomy' as side from records where primary_category = 'Climate Notes'
    union all select 'Unused Name', 'without phrases'""",
)
def taxonomy_diff(spark, d):
    used = records(spark, d).select(C("primary_category").alias("category")).distinct()
    names = [(n,) for n in RULES.categories if n != "Climate Notes"]
    taxonomy = spark.createDataFrame([*names, ("Unused Name",)], "category string")
    known = taxonomy.filter("category = 'Unused Name'").unionByName(used.join(taxonomy, "category", "left_semi"))
    return quality.taxonomy_diff(used, known)


@query(
    "check_domains",
    """select cast(c_custkey as varchar) as key, 'c_mktsegment out of domain' as rule from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')
    union all select cast(c_custkey as varchar), 'link not https' from customer where c_custkey % 9 = 0""",
)
def check_domains(spark, d):
    link = F.concat(F.when(C("c_custkey") % 9 == 0, "http").otherwise("https"), F.lit("://x.example.com/"), "c_name")
    df = table(spark, d, "customer").withColumn("link", link)
    return quality.check_domains(df, "c_custkey", {"c_mktsegment": ("BUILDING", "MACHINERY")}, ["link"])


@query(
    "check_rules",
    """with t as (select distinct source || ' ' || lang as term from documents union all select distinct upper(source) || ' ' || lang from documents)
    select 'hard_exclusions/hard_exclusions' as key, 'repeated phrase: ' || lower(term) as rule from t group by lower(term) having count(*) > 1""",
)
def check_rules(spark, d):
    """Phrase table built from board names, each in two casings."""
    pairs = table(spark, d, "documents").select("source", "lang").distinct()
    shaped = lambda c: pairs.select(F.concat_ws(" ", c, "lang").alias("term"))
    terms = shaped(C("source")).unionByName(shaped(F.upper("source"))).select(
        F.lit("hard_exclusions").alias("kind"), F.lit("hard_exclusions").alias("rule"), "term", F.lit(0).alias("ord")
    )
    return quality.check_rules(terms)


