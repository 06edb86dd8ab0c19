"""Branches of operators that the other queries do not reach: labels, sort modes, keys, weights, digest state."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import values
from listwright.operators import digest as G
from listwright.operators import lifecycle as L
from listwright.operators import matching as M
from listwright.operators import quality, serving
from listwright.queries.base import query, s_norm, table
from listwright.queries.listings import S_FACETS, S_SELECTED, _digest_rows, _facets
from listwright.queries.tables import RECORDS_SQL, now, records
from listwright.rules.ruleset import COMPONENTS
from listwright.session import cut

C = F.col


@query(
    "change_labels",
    f"""{RECORDS_SQL} select id, case when doc_id % 13 = 0 then 'newly_published' else coalesce(nullif(concat_ws('|',
      case when doc_id % 17 = 1 then 'application_link_changed' end, case when doc_id % 17 = 2 then 'opening_date_changed' end,
      case when doc_id % 17 = 3 then 'closing_date_changed' end, case when doc_id % 17 = 4 then 'programme_dates_changed' end,
      case when doc_id % 17 = 5 or (doc_id % 17 = 6 and len(evidence) > 0) then 'eligibility_wording_changed' end,
      case when doc_id % 17 in (7, 8) then 'location_changed' end, case when doc_id % 17 = 9 then 'cycle_or_programme_type_changed' end,
      case when doc_id % 5 = 0 then case status when 'open' then 'applications_reopened' when 'closed' then 'confirmed_closure'
        when 'upcoming' then 'future_opening_announced' end end), ''), 'observed_unchanged') end as changes from records""",
)
def change_labels(spark, d):
    """All twelve labels: each listing against an earlier state in which one field was another."""
    df = records(spark, d)
    n = C("source_identifier").cast("bigint")
    old = {
        "application_url": (1, F.lit("https://old.example.com/")), "opening_date": (2, F.lit("2020-01-01").cast("date")),
        "deadline": (3, F.lit("2020-01-01").cast("date")), "programme_start": (4, F.lit("2020-01-01").cast("date")),
        "eligibility_status": (5, F.lit("unknown")), "eligibility_evidence": (6, F.slice("eligibility_evidence", 1, 0)),
        "location": (7, F.lit("Elsewhere")), "geographic_scope": (8, F.lit("elsewhere")), "programme_type": (9, F.lit("another")),
    }
    before = {name: F.when(n % 17 == k, value).otherwise(C(name)) for name, (k, value) in old.items()}
    before["status"] = F.when(n % 5 == 0, "unknown").otherwise(C("status"))
    before["id"] = F.when(n % 13 != 0, C("id"))
    pair = df.select(
        "id", F.struct(*[C(c) for c in df.columns]).alias("cur"), F.struct(*[before.get(c, C(c)).alias(c) for c in df.columns]).alias("prev")
    )
    return pair.select("id", F.array_join(L.change_labels("prev", "cur"), "|").alias("changes"))


@query(
    "sort_positions",
    f"""{S_FACETS} select 'newest' as mode, id, row_number() over (order by id) as pos from facets
      union all select 'deadline', id, row_number() over (order by deadline, id) from facets
      union all select 'opening', id, row_number() over (order by opening, id) from facets
      union all select 'employer', id, row_number() over (order by lower(employer), id) from facets
      union all select 'category', id, row_number() over (order by lower(category), id) from facets
      union all select 'score', id, row_number() over (order by score desc, id) from facets
      union all select 'evidence', id, row_number() over (order by evidence desc, id) from facets""",
)
def sort_positions(spark, d):
    """The place of every listing in each of the seven sort modes; all were first seen in the same scan."""
    # Every sort reads its rows twice, once for the bounds of its ranges: the sorted columns are derived once.
    df = cut(_facets(spark, d).select("id", "first_seen", "deadline", "opening", "employer", "category", "score", "evidence"), "facets")
    out = None
    for mode in ("newest", "deadline", "opening", "employer", "category", "score", "evidence"):
        ranked = G.global_rank(df, [*serving.sort_mode(mode), F.asc("id")])
        ranked = ranked.select(F.lit(mode).alias("mode"), "id", (C("position") + 1).alias("pos"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


@query(
    "source_key_sets",
    f"""{RECORDS_SQL}, named as (select *, {s_norm('canonical_employer')} as ce, {s_norm('title')} as tt, {s_norm('division')} as dv from records),
    keys as (select source_id, unnest(list_concat(['source:' || ce || ':' || source_id || ':' || n, 'ats:' || ce || ':' || n, 'application:' || apply_url,
      'official:' || canonical_url, 'natural:' || ce || ':' || tt || ':' || n_place || ':' || dv, 'identity:' || source_id || ':' || n],
      case when programme_start is not null then ['programme:' || ce || ':' || tt || ':' || programme_start] else [] end)) as key from named)
    select source_id as source_registry_id, count(distinct key) as keys from keys group by source_id""",
)
def source_key_sets(spark, d):
    """Distinct keys per source through the operator."""
    return M.source_keys(records(spark, d)).groupBy("source_registry_id").agg(F.count(F.lit(1)).alias("keys"))


@query(
    "requisition_match_keys",
    f"""{RECORDS_SQL}, urls as (select id, n, {s_norm('title')} as tt, deadline, case n % 4 when 0 then ['external-ats:acme.wd3.myworkdayjobs.com:role_' || n]
        when 1 then ['external-requisition:jobs.example.org:jobid:' || n] when 2 then ['external-requisition:jobs.example.org:gh_jid:' || n] else [] end as external from records)
    select id, array_to_string(external, '|') as external, case when n % 3 = 0 then 'office:office of n' || n % 7 || ':' || tt || ':' || coalesce(deadline::varchar, 'none') end as office from urls""",
)
def requisition_match_keys(spark, d):
    """Keys of vacancies on applicant systems and of named offices."""
    n = C("source_identifier").cast("bigint")
    text = n.cast("string")
    url = (
        F.when(n % 4 == 0, F.concat(F.lit("https://acme.wd3.myworkdayjobs.com/en-US/careers/Role_"), text, F.lit("/")))
        .when(n % 4 == 1, F.concat(F.lit("https://www.jobs.example.org/view?utm_source=x&jobid="), text))
        .when(n % 4 == 2, F.concat(F.lit("https://jobs.example.org/apply?gh_jid="), text, F.lit("&ref=y")))
        .otherwise(F.concat(F.lit("https://jobs.example.org/"), text))
    )
    df = records(spark, d).withColumns(
        {"application_url": url, "named_office_or_mp": F.when(n % 3 == 0, F.concat(F.lit("Office of N"), (n % 7).cast("string"))).otherwise("")}
    )
    keys = df.select("id", M.match_keys().alias("k"))
    external = F.filter("k", lambda k: F.startswith(k, F.lit("external-")))
    office = F.filter("k", lambda k: F.startswith(k, F.lit("office:")))
    return keys.select("id", F.array_join(external, "|").alias("external"), F.try_element_at(office, F.lit(1)).alias("office"))


@query(
    "keys_overlap",
    """select p_partkey, list_has_any(string_split(lower(p_name), ' '), string_split(lower(p_type || ' ' || p_brand), ' ')) as meets from part""",
)
def keys_overlap(spark, d):
    words = lambda *c: F.split(F.lower(F.concat_ws(" ", *c)), " ")
    return table(spark, d, "part").select("p_partkey", values.keys_overlap(words("p_name"), words("p_type", "p_brand")).alias("meets"))


@query(
    "check_weights",
    """with w as (select o_orderpriority as component, (count(*) - 100) as w from orders group by 1),
    t as (select sum(w) as s, count(*) as n from w)
    select component as key, 'unknown component' as rule from w union all select component, 'negative' from w where w < 0
    union all select 'weights', 'total is not 100' from t where s <> 100 union all select 'weights', 'component count' from t where n <> 8""",
)
def check_weights(spark, d):
    """Order priorities stand for components; none of them is known."""
    counted = table(spark, d, "orders").groupBy(C("o_orderpriority").alias("component")).agg((F.count(F.lit(1)) - 100).cast("int").alias("w"))
    assert len(COMPONENTS) == 8
    return quality.check_weights(counted)


@query(
    "digest_state",
    f"""{S_SELECTED}, done as (select id from selected union select id from records where doc_id % 4 = 0),
    runs as (select max(doc_id) as last from records)
    select id, 'sent' as kind from done union all select 'run ' || ((select last from runs) - k), 'run' from range(4) r(k)
    union all select 'run now', 'run'""",
)
def digest_state(spark, d):
    """Sent ids and the run log after a digest went out; the log keeps its last five runs."""
    df, sent = _digest_rows(spark, d)
    selected, _ = G.select_digest(df, sent, None, now())
    n = C("source_identifier").cast("bigint")
    runs = df.select(
        (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(mins=n.cast("int"))).alias("at"), F.lit("sent").alias("outcome"),
        F.concat(F.lit("run "), n.cast("string")).alias("digest_id"),
    )
    after, log = G.advance_state(sent, selected, runs, "sent", "run now", now(), keep_runs=5)
    return after.select("id", F.lit("sent").alias("kind")).unionByName(log.select(C("digest_id").alias("id"), F.lit("run").alias("kind")))
