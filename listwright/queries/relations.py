"""Joins, windows, lifecycle and state queries over orders, events, customers and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.operators import digest as G
from listwright.operators import health as H
from listwright.operators import lifecycle as L
from listwright.operators import matching as M
from listwright.operators import ordered as O
from listwright.operators import serving
from listwright.operators.components import key_components, shared_pairs
from listwright.operators.resolve import FILLED, group_rows, materially_distinct, resolve, traits
from listwright.queries.base import query, s_norm, table
from listwright.queries.tables import RECORDS_SQL, RULES, now, records, s_possible
from listwright.session import cut
from listwright.streaming import jobs

C = F.col


# --- any-key joins --------------------------------------------------------------------------

S_ORDERS = """
o as (select o_orderkey as n, o_custkey as c, o_orderpriority as p, cast(o_orderdate as date) as day from orders),
f as (select * from o where day >= date '1998-06-01'), e as (select * from o where day < date '1998-06-01')
"""


def _order_sides(spark, d):
    df = table(spark, d, "orders").select(
        C("o_orderkey").alias("ord"),
        F.array(
            F.concat(F.lit("c:"), C("o_custkey").cast("string")),
            F.concat(F.lit("p:"), "o_orderpriority", F.lit(":"), (C("o_custkey") % 40).cast("string")),
        ).alias("keys"),
        C("o_orderstatus").alias("source_registry_id"),
        F.to_date("o_orderdate").alias("day"),
    )
    cutoff = F.lit("1998-06-01").cast("date")
    return df.filter(C("day") >= cutoff), df.filter(C("day") < cutoff)


@query(
    "first_match_join",
    f"""with {S_ORDERS}, k as (select f.n, (select min(e.n) from e where e.c = f.c) as a,
      (select min(e.n) from e where e.p = f.p and e.c % 40 = f.c % 40) as b from f)
    select n as ord, least(a, b) as match_ord from k where a is not null or b is not null""",
)
def first_match_join(spark, d):
    """Same customer, or same priority and customer class: the earliest older order."""
    fresh, old = _order_sides(spark, d)
    return M.first_match(fresh, old.withColumn("old", C("ord")), "ord", "old", "old").select("ord", "match_ord")


@query(
    "greedy_match",
    """with o as (select o_orderkey as n, o_custkey as c, cast(o_orderdate as date) >= date '1998-06-01' as fresh from orders),
    r as (select *, row_number() over (partition by c, fresh order by n) as rn from o)
    select f.n as fresh_ord, e.n as old_ord from r f join r e on f.c = e.c and f.rn = e.rn and f.fresh and not e.fresh""",
)
def greedy_match(spark, d):
    """One key per row: serial choice pairs equal ranks, which the SQL spells out."""
    fresh, old = _order_sides(spark, d)
    one = lambda df: df.withColumn("keys", F.slice("keys", 1, 1))
    return M.greedy_match(one(fresh), one(old), "ord", "ord")


@query("greedy_match_two_keys")
def greedy_match_two_keys(spark, d):
    """Two keys per row make the choice depend on the order of everything before; no SQL form."""
    return M.greedy_match(*_order_sides(spark, d), "ord", "ord")


@query(
    "policy_match",
    f"""with {S_ORDERS.replace("from orders", "from (select * from orders)")}, s as (select o_orderkey as n, o_orderstatus as s from orders),
    k as (select f.n, (select min(e.n) from e join s x on x.n = e.n where e.c = f.c and x.s = y.s) as a,
      (select min(e.n) from e join s x on x.n = e.n where e.p = f.p and e.c % 40 = f.c % 40 and x.s = y.s) as b
      from f join s y on y.n = f.n where y.s <> 'P')
    select n as ord, least(a, b) as match_ord from k where a is not null or b is not null""",
)
def policy_match(spark, d):
    """Matches only inside the same source; rows of a discovery source match nothing."""
    fresh, old = _order_sides(spark, d)
    authority = F.when(C("source_registry_id") == "P", "discovery_only_source").otherwise("official_ats")
    fresh = fresh.withColumn("source_authority", authority)
    return M.policy_matches(fresh, old.withColumn("old", C("ord")), "ord", "old", "old").select("ord", "match_ord")


@query(
    "minus_keys",
    f"""with {S_ORDERS} select n as ord from f where not exists (select 1 from e where e.c = f.c)
    and not exists (select 1 from e where e.p = f.p and e.c % 40 = f.c % 40 and e.n % 3 = 0)
    union all select -n from f where n % 10 <> 0""",
)
def minus_keys(spark, d):
    fresh, old = _order_sides(spark, d)
    known = old.select("ord", F.when(C("ord") % 3 == 0, C("keys")).otherwise(F.slice("keys", 1, 1)).alias("keys"))
    by_id = M.minus_ids(fresh, fresh.filter("ord % 10 = 0"), "ord").select((-C("ord")).alias("ord"))
    return M.minus_keys(fresh, known, "ord").select("ord").unionByName(by_id)


@query(
    "not_fetched_now",
    f"""with {S_ORDERS}, s as (select o_orderkey as n, o_orderstatus as s from orders)
    select e.n as ord from e join s y on y.n = e.n where not exists (select 1 from f join s x on x.n = f.n
      where f.n % 50 = 0 and x.s = y.s and (f.c = e.c or (f.p = e.p and f.c % 40 = e.c % 40)))""",
)
def not_fetched_now(spark, d):
    fresh, old = _order_sides(spark, d)
    return M.not_fetched_now(old, fresh.filter("ord % 50 = 0"), "ord").select("ord")


S_COPIES = f"select doc_id as n, md5({s_norm('text')}) as k1, lang || ':' || md5(split_part(text, chr(10), 1)) as k2 from documents"


@query(
    "key_components",
    f"""with recursive k as (select n, unnest([k1, k2]) as key from ({S_COPIES})),
    r as (select n, least(min(n) over (partition by key)) as m from k), e as (select distinct n as a, m as b from r where n <> m),
    g as (select a, b from e union select b, a from e),
    w(n, c) as (select distinct a, a from g union select w.n, g.b from w join g on g.a = w.c)
    select n as node, min(c) as component from w group by n""",
)
def key_components_query(spark, d):
    """Documents joined by equal text or equal first line, transitively."""
    from listwright.functions.text import normalise_text

    docs = table(spark, d, "documents").select(
        C("doc_id").alias("node"),
        F.explode(
            F.array(
                F.md5(normalise_text(C("text"))),
                F.concat_ws(":", "lang", F.md5(F.split("text", "\n")[0])),
            )
        ).alias("key"),
    )
    return key_components(cut(shared_pairs(docs), "shared"))


@query(
    "match_keys",
    f"""{RECORDS_SQL} select id, len(list_distinct(['source:' || ce || ':' || source_id || ':' || n, 'ats:' || ce || ':' || n,
      'application:' || apply_url, 'official:' || canonical_url, 'natural:' || ce || ':' || tt || ':' || n_place || ':' || dv]))
      + (programme_start is not null)::int as keys,
      md5('natural:' || ce || ':' || tt || ':' || n_place || ':' || dv) as natural_key
    from (select *, {s_norm('canonical_employer')} as ce, {s_norm('title')} as tt, {s_norm('division')} as dv from records)""",
)
def match_keys(spark, d):
    df = records(spark, d).select("id", M.match_keys().alias("k"))
    natural = F.filter("k", lambda k: F.startswith(k, F.lit("natural:")))[0]
    return df.select("id", F.size("k").alias("keys"), F.md5(natural).alias("natural_key"))


_S_GROUP = """{{'root': {root}, 'keys': {keys}, 'm': {m}, 'rk': {t}.rk, 'sid': {t}.sid, 'dv': {dv}, 'st': {t}.st, 'loc': {t}.loc, 'multi': {t}.multi, 'london': {t}.london}}"""


def _s_merge(first: str, then: str) -> str:
    """Members of ``first`` come first and its fields stay; the group keeps the number of ``a``."""
    return _S_GROUP.format(
        root="a.root", keys="list_concat(a.keys, b.keys)", m=f"list_concat({first}.m, {then}.m)", t=first, dv=f"coalesce({first}.dv, {then}.dv)"
    )


#: Row by row: each step gives the next row of every component of shared keys to the groups made so far.
S_RESOLVED = f"""with recursive {RECORDS_SQL.removeprefix('with ')}, r_named as (
  select ord, {s_norm('canonical_employer')} as ce, {s_norm('title')} as tt, nullif({s_norm('division')}, '') as dv, coalesce(n_place, '') as loc,
    coalesce(location_type = 'multi_location', false) as multi, source_id || ':' || n as sid, programme_start::varchar as st, n, source_id, apply_url, canonical_url,
    case source_authority when 'official_ats' then 6 when 'official_programme_page' then 5 when 'official_government_portal' then 5
      when 'official_careers_page' then 4 when 'trusted_sector_board' then 3 else 0 end as rk,
    case when programme_start is not null then ['programme:' || {s_norm('canonical_employer')} || ':' || {s_norm('title')} || ':' || programme_start] else [] end as more
  from records),
r_rows as (select ord, rk, sid, dv, st, loc, multi, contains(loc, 'london') or contains(loc, 'westminster') as london,
  list_distinct(list_concat(['source:' || ce || ':' || source_id || ':' || n, 'ats:' || ce || ':' || n, 'application:' || apply_url,
    'official:' || canonical_url, 'natural:' || ce || ':' || tt || ':' || loc || ':' || coalesce(dv, '')], more)) as keys from r_named),
r_held as (select ord, unnest(keys) as key from r_rows),
r_linked as (select distinct x.ord as a, y.ord as b from r_held x join r_held y on x.key = y.key where x.ord <> y.ord),
reached as (select a, b from r_linked union select r.a, l.b from reached r join r_linked l on l.a = r.b),
clusters as (select a as ord, least(a, min(b)) as part from reached group by a),
turns as (select l.*, part, row_number() over (partition by part order by l.ord) as turn from r_rows l join clusters using (ord)),
fold as (
  select part, 1::bigint as turn, [{_S_GROUP.format(root='t.ord', keys='t.keys', m='[t.ord]', t='t', dv='t.dv')}] as made from turns t where t.turn = 1
  union all
  select part, turn, list_sort(list_append(list_filter(made, lambda g: not list_contains(list_transform(hits, lambda h: h.root), g.root)),
    case when len(hits) = 0 then own else list_reduce(list_concat([own], list_reverse(hits[2:])), lambda a, b:
      case when a.rk >= b.rk then {_s_merge('a', 'b')} else {_s_merge('b', 'a')} end, hits[1]) end))
  from (select t.part, t.turn, f.made, {_S_GROUP.format(root='t.ord', keys='t.keys', m='[t.ord]', t='t', dv='t.dv')} as own,
    list_filter(f.made, lambda g: list_has_any(g.keys, t.keys) and (g.sid = t.sid or not (coalesce(g.dv <> t.dv, false) or coalesce(g.st <> t.st, false)
      or not (g.loc = t.loc or g.multi or t.multi or (g.london and t.london))))) as hits
    from fold f join turns t on t.part = f.part and t.turn = f.turn + 1)
),
r_last as (select part, arg_max(made, turn) as made from fold group by part),
r_made as (select unnest(made) as g from r_last),
r_members as (
  select g.root as root, unnest(g.m) as ord, generate_subscripts(g.m, 1) as pos from r_made
  union all select ord, ord, 1 from r_rows where ord not in (select ord from clusters)
),
r_tagged as (select root, unnest(tags) as tag, pos, generate_subscripts(tags, 1) as place from r_members join records using (ord)),
tag_lists as (select root, array_to_string(list(tag order by first), '|') as tags from (
  select root, tag, min((pos, place)) as first from r_tagged group by all) group by root),
r_urls as (select root, count(distinct url) as urls from (
  select root, unnest([source_url, application_url, canonical_url, apply_url]) as url from r_members join records using (ord)) group by root)
"""


@query(
    "resolve_listings",
    f"""{S_RESOLVED} select arg_min(id, pos) as id, root as ord, any_value(urls) as urls, sum(len(evidence))::bigint as evidence,
      coalesce(any_value(t.tags), '') as tags, arg_min(match_score, pos) as match_score
    from r_members join records r using (ord) join r_urls using (root) left join tag_lists t using (root) group by root""",
)
def resolve_listings(spark, d):
    """Ordered greedy merging; the SQL takes the rows of each component one by one."""
    merged = ("first_seen_at", "last_seen_at", "all_source_urls", "secondary_tags", "eligibility_evidence", "match_score")
    filled = [n for n in FILLED if n not in KEYED]
    return resolve(records(spark, d).select(*KEYED, "source_authority", "location_type", *filled, *merged)).select(
        "id", "ord", F.size("all_source_urls").cast("bigint").alias("urls"), F.size("eligibility_evidence").cast("bigint").alias("evidence"),
        F.array_join("secondary_tags", "|").alias("tags"), "match_score",
    )


@query(
    "resolve_copies",
    """with t as (select doc_id as n, md5(text) as k, source, cast(substr(source, 4) as integer) % 6 as a from documents),
    r as (select *, case a when 0 then 6 when 1 then 4 when 2 then 5 when 3 then 5 when 4 then 3 else 0 end as rk from t)
    select min(n) as root, count(*) as rows, arg_max(n, struct_pack(rk := rk, o := -n)) as preferred from r group by k""",
)
def resolve_copies(spark, d):
    """Documents with equal text, no conflicts: groups, sizes and the preferred member."""
    i = F.expr("cast(substring(source, 4) as int)")
    from listwright.queries.tables import authority

    link = F.concat(F.lit("https://c.example.com/"), F.md5("text"))
    n = C("doc_id").cast("string")
    fields = {
        "ord": C("doc_id"), "canonical_employer": n, "title": n, "location": F.lit("London"), "division": F.lit(None).cast("string"),
        "source_registry_id": C("source"), "source_identifier": n, "application_url": link,
        "canonical_url": F.concat(F.lit("https://d.example.com/"), n), "named_office_or_mp": F.lit(None).cast("string"),
        "programme_start": F.lit(None).cast("date"), "programme_end": F.lit(None).cast("date"), "deadline": F.lit(None).cast("date"),
        "source_authority": authority(i), "location_type": F.lit("onsite"),
    }
    rows = table(spark, d, "documents").select(*[c.alias(k) for k, c in fields.items()])
    placed = group_rows(rows)
    return placed.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min_by("ord", "seq").alias("preferred"))


@query(
    "materially_distinct",
    f"""{RECORDS_SQL}, p as (select a.id as a_id, b.id as b_id, case when a.location = b.location then false
      when a.location_type = 'multi_location' or b.location_type = 'multi_location' then false
      else not ((contains(a.n_place, 'london') or contains(a.n_place, 'westminster')) and (contains(b.n_place, 'london') or contains(b.n_place, 'westminster'))) end as place,
      a.division <> b.division as dv, a.programme_start <> b.programme_start as st from records a join records b on b.n = a.n + 1)
    select a_id, coalesce(dv, false) or coalesce(st, false) or place as differs from p""",
)
def materially_distinct_query(spark, d):
    """Conflict test between each listing and the next one."""
    df = records(spark, d).select("id", C("source_identifier").cast("bigint").alias("n"), F.struct(*[c.alias(k) for k, c in traits().items()]).alias("t"))
    pairs = df.select(C("id").alias("a_id"), "n", C("t").alias("a")).join(df.select((C("n") - 1).alias("n"), C("t").alias("b")), "n")
    return pairs.select("a_id", materially_distinct("a", "b").alias("differs"))


# --- windows and streaks --------------------------------------------------------------------


@query("first_last_seen", "select user_id, min(ts) as first_seen_at, max(ts) as last_seen_at from events group by user_id")
def first_last_seen(spark, d):
    return L.seen_bounds(table(spark, d, "events"), "user_id", "ts")


@query(
    "changes_feed",
    """with t as (select *, lag(event_type) over w as pt, lag(floor(value / 10)) over w as pv, row_number() over w as rn from events
      window w as (partition by user_id order by ts, event_id))
    select event_id, case when rn = 1 then 'newly_published' else coalesce(nullif(concat_ws('|',
      case when event_type is distinct from pt then 'event_type_changed' end,
      case when floor(value / 10) is distinct from pv then 'band_changed' end), ''), 'observed_unchanged') end as changes from t""",
)
def changes_feed(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.floor(C("value") / 10).alias("band"))
    flags = L.change_flags(df, "user_id", "ts", ["event_type", "band"])
    return flags.select("event_id", F.array_join("changes", "|").alias("changes"))


@query(
    "hash_changes",
    """with t as (select user_id, ts, md5(event_type) as h, lag(md5(event_type)) over (partition by user_id order by ts) as p from events)
    select cast(user_id as varchar) as source_id, ts as checked_at, coalesce(p <> h, false) as changed from t""",
)
def hash_changes(spark, d):
    history = table(spark, d, "events").select(
        C("user_id").cast("string").alias("source_id"), C("ts").alias("checked_at"), F.md5("event_type").alias("content_hash")
    )
    return H.hash_changes(history).select("source_id", "checked_at", "changed")


S_STREAKS = """days as (select day, row_number() over (order by day) as n from (select distinct cast(ts as date) as day from events)),
  seen as (select distinct user_id, n from events join days on day = cast(ts as date) where user_id % 3 = 0 or n % 4 = 1),
  g as (select user_id, n, lag(n) over (partition by user_id order by n) as p from seen),
  t as (select max(n) as total from days)"""


@query(
    "absence_closure",
    f"""with {S_STREAKS} select user_id, p + 1 as first_missing, n - p - 1 as missing, n - p - 1 >= 3 as closes from g where n - p > 1
    union all select user_id, max(n) + 1, max(total) - max(n), max(total) - max(n) >= 3 from seen, t group by user_id having max(total) > max(n)""",
)
def absence_closure(spark, d):
    """Days are scans; a user unseen for three days in a row would close."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = L.grid_rank(events, "day")
    numbered = events.join(days, "day").filter("user_id % 3 = 0 or n % 4 = 1")
    return L.absence_streaks(numbered.select("user_id", "day"), days, "user_id", "day")


@query(
    "rank_within",
    "select event_id, row_number() over (partition by event_type order by ts, event_id) as rank from events",
)
def rank_within(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", "ts")
    return O.rank_within(df, ["event_type"], ["ts", "event_id"], F.unix_micros(C("ts").cast("timestamp"))).select("event_id", "rank")


@query("global_rank", "select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as position from orders")
def global_rank(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return G.global_rank(df, [F.desc("o_totalprice"), C("o_orderkey")]).select("o_orderkey", "position")


# --- caps, de-duplication, retention --------------------------------------------------------


@query(
    "shard_dedup",
    """select l_orderkey, arg_min(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) as first_part, count(*) as appearances from lineitem group by l_orderkey""",
)
def shard_dedup(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return O.dedupe_first(df, ["l_orderkey"], F.struct("l_linenumber", "l_partkey")).select(
        "l_orderkey", C("l_partkey").alias("first_part"), "appearances"
    )


@query(
    "source_dedup_last",
    """select user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) as event_id, min(ts) as first_ts from events group by user_id""",
)
def source_dedup_last(spark, d):
    df = table(spark, d, "events").select("user_id", "event_id", "ts")
    return O.dedupe_last(df, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", C("first_ord.ts").alias("first_ts"))


@query(
    "result_cap",
    """with r as (select l_orderkey, l_partkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as rn,
      count(*) over (partition by l_orderkey) as n, l_orderkey % 4 as cap from lineitem)
    select l_orderkey, l_partkey, l_linenumber, coalesce(n > nullif(cap, 0), false) as capped from r where cap = 0 or rn <= cap""",
)
def result_cap(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    cap = F.nullif((C("l_orderkey") % 4).cast("int"), F.lit(0))
    # Rows without a cap keep everything, so the map-side bound is left open.
    return O.apply_cap(df, ["l_orderkey"], ["l_linenumber", "l_partkey"], cap, C("l_linenumber"))


@query(
    "retention_tail",
    """select event_id from events where ts >= timestamp '2024-01-30 00:00:00' - interval 20 days order by ts desc, event_id desc limit 5000""",
)
def retention_tail(spark, d):
    at = F.lit("2024-01-30").cast("timestamp")
    return L.retain(table(spark, d, "events"), at, "ts", [F.desc("ts"), F.desc("event_id")], days=20, rows=5000).select("event_id")


@query("run_log_tail", "select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 100")
def run_log_tail(spark, d):
    return O.tail(table(spark, d, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 100).select("o_orderkey")


@query(
    "latest_by_id",
    """select user_id, max(event_id) as event_id from events where event_type in ('view', 'click')
      and (event_type = 'click' or user_id not in (select user_id from events where event_type = 'click')) group by user_id""",
)
def latest_by_id(spark, d):
    """Two tables, the later one wins per id."""
    df = table(spark, d, "events")
    newest = lambda kind: df.filter(C("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return L.latest_by_id(newest("view"), newest("click"), key="user_id")


@query("union_state", "select event_type, count(*) as rows from events where event_type in ('view', 'error', 'signup') group by 1")
def union_state(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type")
    parts = [df.filter(C("event_type") == k) for k in ("view", "error", "signup")]
    return L.union_state(*parts).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "coverage_diff",
    """select o_custkey as key, 'left only' as side from (select o_custkey from orders except all select c_custkey from customer)
    union all select c_custkey, 'right only' from (select c_custkey from customer except all select o_custkey from orders)""",
)
def coverage_diff(spark, d):
    from listwright.operators.quality import coverage_diff as diff

    left = table(spark, d, "orders").select(C("o_custkey").alias("key"))
    return diff(left, table(spark, d, "customer").select(C("c_custkey").alias("key")), "key")


# --- health ---------------------------------------------------------------------------------

S_HEALTH = """h as (select cast(user_id as varchar) as source_id, cast(ts as date) as day, max(ts) as checked_at, count(*) as listing_count,
    count(distinct event_type) as item_count from events group by all),
  s as (select *, case when item_count >= 2 then 'healthy' else 'degraded' end as status, listing_count >= 6 as capped, item_count >= 2 as parser_ok,
    day = date '2024-01-30' as is_now, day = date '2024-01-29' as is_prev, md5(listing_count::varchar) as content_hash from h)"""


def _daily_health(spark, d):
    df = table(spark, d, "events").groupBy(C("user_id").cast("string").alias("source_id"), F.to_date("ts").alias("day")).agg(
        F.max("ts").alias("checked_at"), F.count(F.lit(1)).alias("listing_count"), F.count_distinct("event_type").alias("item_count")
    )
    ok = C("item_count") >= 2
    return df.select(
        "source_id", F.when(ok, "healthy").otherwise("degraded").alias("status"), "checked_at",
        F.when(ok, C("checked_at")).alias("last_success_at"), "item_count", "listing_count", C("item_count").alias("candidate_count"),
        F.lit(1).cast("bigint").alias("pages_scanned"), (C("listing_count") >= 6).alias("capped"), ok.alias("parser_ok"),
        F.md5(C("listing_count").cast("string")).alias("content_hash"), F.lit(False).alias("changed_since_last_success"),
        F.lit(None).cast("string").alias("message"), "day",
    )


def _two_days(spark, d):
    df = _daily_health(spark, d)
    day = lambda text: df.filter(C("day") == F.lit(text).cast("date")).drop("day")
    return day("2024-01-30"), day("2024-01-29")


def _watchers(spark, d):
    return table(spark, d, "events").select(C("user_id").cast("string").alias("id")).distinct().withColumns(
        {"monitor_only": C("id").cast("bigint") % 2 == 0, "poll_interval_minutes": (C("id").cast("int") % 3) * 720,
         "endpoint": F.concat(F.lit("https://u.example.com/"), "id")}
    )


@query(
    "health_rollup",
    """select cast(user_id as varchar) as source_id, case when u >= 4 and n < 60 and not (u >= 5 and cap) and user_id % 7 <> 3 then 'healthy' else 'degraded' end as status,
      least(u, case when cap then 5 else u end) as item_count, n as listing_count, pages as pages_scanned, u >= 5 and cap as capped,
      u >= 4 and n < 60 as parser_ok, h as content_hash
    from (select user_id, user_id % 5 = 0 as cap, count(distinct event_type) as u, count(*) as n, count(distinct cast(ts as date)) as pages,
      sha256(string_agg(distinct sha256(strftime(cast(ts as date), '%Y-%m-%d') || user_id), '' order by sha256(strftime(cast(ts as date), '%Y-%m-%d') || user_id))) as h0
      from events group by user_id) a
    join (select user_id, sha256(string_agg(p, '' order by day)) as h from (select distinct user_id, cast(ts as date) as day,
      sha256(strftime(cast(ts as date), '%Y-%m-%d') || user_id) as p from events) group by user_id) b using (user_id)""",
)
def health_rollup(spark, d):
    """Users are sources, days their pages, event types their listings."""
    events = table(spark, d, "events").select(C("user_id").cast("string").alias("source_id"), "event_type", "ts", F.to_date("ts").alias("day"))
    pages = events.groupBy("source_id", "day").agg(F.max("ts").alias("fetched_at")).select(
        "source_id", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("page_no"),
        F.encode(F.concat(C("day").cast("string"), "source_id"), "UTF-8").alias("payload"), "fetched_at",
    )
    raw = events.select("source_id", C("event_type").alias("source_identifier"))
    registry = events.select(C("source_id").alias("id")).distinct().select(
        "id", F.when(C("id").cast("bigint") % 5 == 0, 5).alias("result_cap"), F.lit(4).alias("expected_min_items"),
        (C("id").cast("bigint") % 7 == 3).alias("monitor_only"),
    )
    # A busy source advertises far more than it shows.
    stated = events.groupBy("source_id").agg(F.when(F.count(F.lit(1)) >= 60, 99).cast("bigint").alias("advertised"))
    return H.health_rollup(pages, raw, registry, stated).select(
        "source_id", "status", "item_count", "listing_count", "pages_scanned", "capped", "parser_ok", "content_hash"
    )


@query(
    "poll_due",
    f"""with {S_HEALTH}, r as (select distinct cast(user_id as varchar) as id, (user_id % 3) * 720 as wait from events)
    select id from r left join s on s.source_id = r.id and is_now where wait = 0 or checked_at is null or status <> 'healthy' or capped or not parser_ok
      or checked_at + to_minutes(wait) <= timestamp '2024-01-31 06:00:00'""",
)
def poll_due(spark, d):
    current, _ = _two_days(spark, d)
    return H.due_sources(_watchers(spark, d), current, F.lit("2024-01-31 06:00:00").cast("timestamp")).select("id")


@query(
    "replaceable_sources",
    f"with {S_HEALTH} select source_id from s where is_now and status = 'healthy' and not capped and parser_ok",
)
def replaceable_sources(spark, d):
    return H.replaceable_sources(_two_days(spark, d)[0])


@query(
    "health_reconcile",
    f"""with {S_HEALTH}, j as (select c.*, p.content_hash as ph, p.checked_at as pc, p.parser_ok as pp,
      cast(c.source_id as bigint) % 2 = 0 and p.content_hash is not null and c.content_hash <> p.content_hash as changed
      from (select * from s where is_now) c left join (select * from s where is_prev) p on p.source_id = c.source_id)
    select source_id, case when cast(source_id as bigint) % 2 = 0 and status = 'healthy' then 'degraded' else status end as status, coalesce(changed, false) as changed,
      case when parser_ok then checked_at when pp then pc end as last_success_at from j""",
)
def health_reconcile(spark, d):
    current, previous = _two_days(spark, d)
    out = H.reconcile_health(current, previous, _watchers(spark, d))
    return out.select("source_id", "status", C("changed_since_last_success").alias("changed"), "last_success_at")


@query(
    "source_changes",
    f"""with {S_HEALTH} select c.source_id, 'https://u.example.com/' || c.source_id as source_url, 'official_source_page_changed' as changes
    from (select * from s where is_now) c join (select * from s where is_prev) p on p.source_id = c.source_id
    where cast(c.source_id as bigint) % 2 = 0 and c.content_hash <> p.content_hash""",
)
def source_changes(spark, d):
    current, previous = _two_days(spark, d)
    watchers = _watchers(spark, d)
    out = H.source_changes(H.reconcile_health(current, previous, watchers), watchers, now())
    return out.select("source_id", "source_url", F.array_join("changes", "|").alias("changes"))


@query(
    "carry_forward",
    f"""with {S_HEALTH} select source_id, checked_at from s where is_now
    union all select source_id, checked_at from s where is_prev and source_id not in (select source_id from s where is_now)""",
)
def carry_forward(spark, d):
    return H.carry_forward(*_two_days(spark, d)).select("source_id", "checked_at")


@query(
    "source_status",
    f"""with {S_HEALTH}, r as (select distinct cast(user_id as varchar) as id, user_id from events)
    select id, case when user_id % 7 = 0 then 'Verified snapshot' when s.source_id is null then 'Awaiting scheduled scan'
      else upper(status[1]) || status[2:] end as source_state, coalesce(listing_count, 0) as listings,
      case when user_id % 2 = 0 then 'Page watch only — no role publication. ' else '' end || 'note ' || id as note
    from r left join s on s.source_id = r.id and is_now where user_id % 4 <> 3""",
)
def source_status(spark, d):
    n = C("id").cast("bigint")
    registry = _watchers(spark, d).withColumns(
        {"enabled": n % 4 != 3, "canonical_name": C("id"), "notes": F.concat(F.lit("note "), "id"),
         "ats_type": F.when(n % 7 == 0, "curated_yaml").otherwise("html")}
    )
    return H.source_status(registry, _two_days(spark, d)[0]).select("id", "source_state", "listings", "note")


@query(
    "source_groups",
    """select case when c_custkey % 3 = 0 then 'watched' else 'publishing' end as source_group, count(*) as rows
    from customer where c_nationkey % 2 = 0 group by all""",
)
def source_groups(spark, d):
    registry = table(spark, d, "customer").select((C("c_nationkey") % 2 == 0).alias("enabled"), (C("c_custkey") % 3 == 0).alias("monitor_only"))
    return H.source_groups(registry).groupBy("source_group").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "inactive_health",
    """select s_name as source_id, 'disabled' as status, 'Credentialed source is ready but inactive; set ' || case when s_suppkey % 2 = 0 then 'KEY_A, KEY_B' else 'KEY_B' end as message
    from supplier where s_suppkey % 3 = 0""",
)
def inactive_health(spark, d):
    k = C("s_suppkey")
    needs = F.when(k % 3 != 0, F.array(F.lit("KEY_C"))).when(k % 2 == 0, F.array(F.lit("KEY_A"), F.lit("KEY_B"))).otherwise(F.array(F.lit("KEY_B")))
    registry = table(spark, d, "supplier").select(C("s_name").alias("id"), needs.alias("required_settings"))
    return H.inactive_health(registry, ["KEY_C"], now()).select("source_id", "status", "message")


# --- lifecycle ------------------------------------------------------------------------------

S_LIFE = f"""{RECORDS_SQL}, ex as (select *, n % 3 as miss from records where n % 2 = 0 and n % 10 <> 8),
  ob as (select * from records where n % 4 <> 2),
  safe as (select id as sid, i % 3 <> 0 as ok from registry)"""


#: What match keys and the order of rows are made of.
KEYED = (
    "id", "ord", "canonical_employer", "title", "location", "division", "named_office_or_mp", "source_registry_id", "source_identifier",
    "application_url", "canonical_url", "programme_start", "programme_end", "deadline",
)


def _life(spark, d, *read):
    """Stored rows, this scan's rows and source health, one listing being one entity.

    ``read`` names the columns that a query uses beside ``KEYED``; others are neither derived nor stored. None given: all.
    """
    base = records(spark, d).withColumn("n", C("source_identifier").cast("bigint"))
    alone = base.withColumns(
        {
            "application_url": F.concat(F.lit("https://one.example.com/"), "n"),
            "canonical_employer": F.concat(F.lit("e"), "n"),
            "ord": C("n"),
        }
    )
    alone = cut(alone.select("n", *KEYED, *read) if read else alone, "life")
    keep = [c for c in alone.columns if c != "n"]
    existing = alone.filter("n % 2 = 0 and n % 10 <> 8").withColumns(
        {"consecutive_missing_count": (C("n") % 3).cast("int"), "first_seen_at": F.lit("2026-01-05").cast("timestamp"),
         "id": F.concat(F.lit("old-"), "id")}
    )
    observed = alone.filter("n % 4 <> 2")
    from listwright.queries.tables import registry

    health = registry(spark, d).select(
        C("id").alias("source_id"), F.when(C("source_ord") % 3 != 0, "healthy").otherwise("failed").alias("status"),
        F.lit(False).alias("capped"), (C("source_ord") % 3 != 0).alias("parser_ok"), F.lit(False).alias("changed_since_last_success"),
    )
    return existing.select(*keep), observed.select(*keep), health


@query(
    "snapshot_lifecycle",
    f"""{S_LIFE}, seen as (select case when e.id is not null then 'old-' || e.id else o.id end as id, 0 as missing, o.status,
      case when e.id is not null then '2026-01-05' else '2026-02-20' end as first_seen from ob o left join ex e on e.n = o.n),
    gone as (select 'old-' || e.id as id, case when ok then miss + 1 else miss end as missing,
      case when ok and miss + 1 >= 3 then 'closed' else e.status end as status, '2026-01-05' as first_seen
      from ex e join safe on sid = source_id where e.n not in (select n from ob) and e.status <> 'closed')
    select * from seen union all select * from gone""",
)
def snapshot_lifecycle(spark, d):
    read = ("status", "first_seen_at", "last_seen_at", "all_source_urls", "consecutive_missing_count", "source_type")
    existing, observed, health = _life(spark, d, *read)
    retained, closed = L.lifecycle(existing, observed, health, now())
    return retained.unionByName(closed).select(
        "id", C("consecutive_missing_count").alias("missing"), "status", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen")
    )


@query(
    "closure_health",
    f"""{S_LIFE} select 'old-' || e.id as id, ok as safe from ex e join safe on sid = source_id""",
)
def closure_health(spark, d):
    existing, _, health = _life(spark, d, "source_type")
    return L.closure_health(existing, health).select("id", "safe")


S_PUBLIC_OPEN = """(eligibility_status in ('verified_eligible', 'likely_eligible', 'manual_approved')
  and (relevance_status in ('strong_match', 'credible_match') or (relevance_status = 'borderline_relevance' and reviewed))
  and not review_required and geographic_scope in ('london', 'uk_priority_exception')
  and source_authority <> 'discovery_only_source' and paid is distinct from false)"""


@query(
    "policy_close",
    f"""{S_LIFE} select 'old-' || e.id as id, o.canonical_url as closure_evidence from ob o join ex e on e.n = o.n
    where o.status <> 'closed' and o.source_authority <> 'discovery_only_source' and not (select {S_PUBLIC_OPEN.replace('paid is', 'x.paid is')} from records x where x.n = o.n)""",
)
def policy_close(spark, d):
    existing, observed, _ = _life(spark, d)
    return L.policy_close(observed, existing, now()).select("id", "closure_evidence")


@query(
    "change_detection",
    f"""{S_LIFE} select o.id as role_id, case when e.id is null then 'newly_published' else coalesce(nullif(concat_ws('|',
      case when o.n % 5 = 0 then 'closing_date_changed' end, case when o.n % 7 = 0 then 'location_changed' end,
      case when o.n % 3 = 0 and o.status <> 'closed' then case o.status when 'open' then 'applications_reopened' else 'future_opening_announced' end end), ''),
      'observed_unchanged') end as changes from ob o left join ex e on e.n = o.n""",
)
def change_detection(spark, d):
    read = ("status", "opening_date", "eligibility_status", "eligibility_evidence", "geographic_scope", "programme_type")
    existing, observed, _ = _life(spark, d, *read)
    n = C("source_identifier").cast("bigint")
    before = existing.withColumns(
        {
            "deadline": F.when(n % 5 == 0, F.lit("2020-01-01").cast("date")).otherwise(C("deadline")),
            "location": F.when(n % 7 == 0, "Elsewhere").otherwise(C("location")),
            "status": F.when(n % 3 == 0, "closed").otherwise(C("status")),
        }
    )
    feed = L.change_feed(before, observed, now())
    return feed.select("role_id", F.array_join("changes", "|").alias("changes"))


@query(
    "tier_replacement",
    f"""{S_LIFE}, tiers as (select n, {s_possible().replace('canonical_employer', "('e' || n)")} as possible,
      status <> 'closed' and eligibility_status = 'uncertain' and relevance_status <> 'irrelevant' as doubtful from records),
    kept as (select 'old-' || e.id as id, e.n from ex e join safe on sid = source_id where not ok and e.n not in (select n from ob)),
    fresh as (select o.id, o.n from ob o)
    select id, 'possible' as tier from (select * from kept union all select * from fresh where n % 9 <> 0) join tiers using (n) where possible
    union all select id, 'review' from kept
    union all select id, 'review' from fresh join tiers using (n) where doubtful and not possible""",
)
def tier_replacement(spark, d):
    """Possible and review tiers after a scan; both end in the order-dependent merge, in which each listing is alone."""
    existing, observed, health = _life(spark, d)
    public = observed.filter("ord % 9 = 0")
    possible = L.next_possible(existing, observed, public, health, RULES, now())
    review = L.next_review(existing, observed, health, RULES)
    return possible.select("id", F.lit("possible").alias("tier")).unionByName(review.select("id", F.lit("review").alias("tier")))


@query(
    "upsert_closed",
    f"""{S_LIFE} select case when o.n is not null then 'new' else 'old' end as origin, count(*) as rows from ex e left join ob o on o.n = e.n group by all""",
)
def upsert_closed(spark, d):
    existing, observed, _ = _life(spark, d)
    newer = observed.join(existing.select("ord"), "ord", "left_semi").withColumns(
        {"id": F.concat(F.lit("old-"), "id"), "closure_reason": F.lit("new")}
    ).select(*existing.columns)
    out = L.upsert_closed(existing.withColumn("closure_reason", F.lit("old")), newer)
    return out.groupBy(C("closure_reason").alias("origin")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "append_observations",
    """with o as (select event_id, user_id, event_type, ts, cast(ts as date) = date '2024-01-30' as fresh from events)
    select cast(event_id as varchar) as role_id from o where fresh or ts >= timestamp '2024-01-31' - interval 15 days
    order by fresh desc, ts desc, cast(user_id as varchar) desc, event_type desc, cast(event_id as varchar) desc limit 2000""",
)
def append_observations(spark, d):
    df = table(spark, d, "events").select(
        C("event_id").cast("string").alias("role_id"), C("user_id").cast("string").alias("source_id"), C("event_type").alias("source_identifier"),
        C("ts").alias("observed_at"), F.lit(None).cast("string").alias("source_url"), F.array(F.lit("seen")).alias("changes"),
    )
    fresh = F.to_date("observed_at") == F.lit("2024-01-30").cast("date")
    at = F.lit("2024-01-31").cast("timestamp")
    return L.append_observations(df.filter(~fresh), df.filter(fresh), at, days=15, rows=2000).select("role_id")


@query(
    "expected_vs_live",
    """with live as (select lower(c_mktsegment) as e, cast(c_nationkey % 5 as varchar) as p, min(c_custkey) as o from customer where c_acctbal > 0 group by all),
    x as (select n_nationkey as id, case n_nationkey % 3 when 0 then 'building' when 1 then 'Machinery' else 'None Such' end as e, cast(n_regionkey as varchar) as p, n_name from nation)
    select cast(x.id as varchar) as id, case when o is null then n_name when o % 2 = 0 then '01 Mar 2026' else '05 Jan 2026' end as opening_window,
      case when o is null then 'estimate' when o % 2 = 0 then 'official_future_opening_date' else 'currently_open' end as evidence_type,
      case when o is null then 'expected' else 'currently open' end as current_status
    from x left join live on live.e = lower(x.e) and live.p = x.p""",
)
def expected_vs_live(spark, d):
    expected = table(spark, d, "nation").select(
        C("n_nationkey").cast("string").alias("id"),
        F.when(C("n_nationkey") % 3 == 0, "building").when(C("n_nationkey") % 3 == 1, "Machinery").otherwise("None Such").alias("employer"),
        C("n_regionkey").cast("string").alias("expected_programme_type"), F.lit("London").alias("expected_location"),
        C("n_name").alias("historical_opening_window"), F.lit("estimate").alias("evidence_type"),
        F.lit("expected").alias("current_status"), F.lit("https://x.example.com").alias("source_url"),
    )
    live = table(spark, d, "customer").select(
        C("c_mktsegment").alias("canonical_employer"), (C("c_nationkey") % 5).cast("string").alias("programme_type"),
        F.when(C("c_acctbal") > 0, "open").otherwise("closed").alias("status"), C("c_custkey").alias("ord"),
        F.when(C("c_custkey") % 2 == 0, F.lit("2026-03-01").cast("date")).alias("opening_date"),
        F.lit("2026-01-05").cast("timestamp").alias("first_seen_at"), C("c_name").alias("canonical_url"),
    )
    return serving.expected_vs_live(expected, live).select("id", "opening_window", "evidence_type", "current_status")


@query(
    "source_keys",
    f"""with o as (select o_orderstatus as s, unnest([o_custkey, -(o_custkey % 40)]) as k from orders) select s as source_registry_id, count(distinct k) as keys from o group by all""",
)
def source_keys(spark, d):
    df = table(spark, d, "orders").select(
        C("o_orderstatus").alias("source_registry_id"), F.explode(F.array(C("o_custkey"), -(C("o_custkey") % 40))).alias("key")
    ).distinct()
    return df.groupBy("source_registry_id").agg(F.count(F.lit(1)).alias("keys"))


# --- metrics and subscribers ----------------------------------------------------------------


@query(
    "scan_metrics",
    f"""{RECORDS_SQL} select count(*) filter (programme_type <> 'cycle_unstated_recent_role') as open_verified_roles,
      count(*) filter (programme_type = 'cycle_unstated_recent_role') as recent_cycle_unstated, count(*) filter (status = 'upcoming') as possible_roles,
      count(*) filter (eligibility_status = 'uncertain') as review_queue, (select count(*) from registry where enabled) as employers_monitored,
      (select count(*) from registry where enabled and not monitor_only) as publishing_sources, (select count(*) from registry where enabled and monitor_only) as monitor_only_sources,
      (select count(*) from registry where i % 3 <> 0) as healthy_sources, (select count(*) from registry where i % 3 = 0) as failed_sources,
      (select sum(i) from registry)::bigint as listings_scanned from records""",
)
def scan_metrics(spark, d):
    from listwright.queries.tables import registry

    df, reg = cut(records(spark, d).select("programme_type", "status", "eligibility_status"), "counted"), registry(spark, d)
    first, second = L.split_open_recent(df)
    health = reg.select(F.when(C("source_ord") % 3 != 0, "healthy").otherwise("failed").alias("status"), C("source_ord").cast("bigint").alias("listing_count"))
    out = serving.scan_metrics(first, second, df.filter("status = 'upcoming'"), df.filter("eligibility_status = 'uncertain'"), health, reg, now())
    return out.drop("data_updated_at")


@query(
    "scan_summary",
    """select count(distinct user_id) filter (user_id % 2 = 0) as sources_attempted, count(distinct user_id) filter (user_id % 2 = 0 and user_id % 3 <> 0) as sources_succeeded,
      count(*) as observations, count(*) filter (event_type = 'view') as public_roles, count(*) filter (event_type = 'click') as possible_roles,
      count(*) filter (event_type = 'error') as review_items from events""",
)
def scan_summary(spark, d):
    df = table(spark, d, "events")
    users = df.select(C("user_id").alias("source_id")).distinct()
    health = users.select("source_id", F.when(C("source_id") % 3 == 0, "failed").otherwise("healthy").alias("status"), now().alias("last_success_at"))
    kind = lambda k: df.filter(C("event_type") == k)
    return serving.scan_summary(health, users.filter("source_id % 2 = 0"), df, kind("view"), kind("click"), kind("error"))


@query(
    "rate_limit_windows",
    "select user_id, date_trunc('hour', ts) as window_started_at, count(*) as request_count, count(*) <= 1 as allowed from events group by all",
)
def rate_limit_windows(spark, d):
    return G.window_counts(table(spark, d, "events"), "user_id", "ts", 60, 1)


@query(
    "rate_limit_pruned",
    """with w as (select user_id, date_trunc('hour', ts) as window_started_at from events)
    select user_id, window_started_at, count(*) as request_count, count(*) <= 5 as allowed from w
    where window_started_at >= timestamp '2024-01-30 18:30:00' - interval 2 hours group by all""",
)
def rate_limit_pruned(spark, d):
    counts = G.window_counts(table(spark, d, "events"), "user_id", "ts", 60, 5)
    return G.prune_windows(counts, F.lit("2024-01-30 18:30:00").cast("timestamp"))


def _subscribers(spark, d):
    k = C("c_custkey")
    statuses = F.array(*[F.lit(s) for s in ("pending", "confirmed", "unsubscribed", "bounced")])
    at = lambda days: F.lit("2026-02-20").cast("timestamp") - F.make_interval(days=days.cast("int"))
    return table(spark, d, "customer").select(
        C("c_name").alias("id"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.element_at(statuses, (k % 4).cast("int") + 1).alias("status"), at(k % 60).alias("created_at"),
        F.lit(None).cast("timestamp").alias("confirmed_at"), F.lit(None).cast("timestamp").alias("unsubscribed_at"),
        F.lit("h").alias("confirmation_token_hash"), F.when(k % 3 > 0, at(k % 5 - 2)).alias("confirmation_expires_at"),
        F.transform(F.sequence(F.lit(1), (k % 30).cast("int") + 1), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("unsubscribe_token_hashes"),
        F.when(k % 5 == 0, "d1").when(k % 5 == 1, "d0").alias("last_digest_sent"), F.lit(None).cast("string").alias("delivery_failure_status"),
    )


S_SUBS = """subs as (select c_custkey as k, lower(c_name) || '@example.com' as email, ['pending', 'confirmed', 'unsubscribed', 'bounced'][c_custkey % 4 + 1] as status,
  c_custkey % 60 as age, case when c_custkey % 3 > 0 then c_custkey % 5 - 2 end as expired_days, case c_custkey % 5 when 0 then 'd1' when 1 then 'd0' end as sent from customer)"""


@query(
    "pending_recipients",
    f"with {S_SUBS} select email, 'd1:' || substr(sha256(email), 1, 16) as delivery_key from subs where status = 'confirmed' and sent is distinct from 'd1'",
)
def pending_recipients(spark, d):
    return G.deliveries(_subscribers(spark, d), F.lit("d1"))


@query(
    "subscription_upsert",
    f"""with {S_SUBS} select email, case when asked and (status in ('unsubscribed', 'bounced') or (status = 'pending' and (expired_days is null or expired_days > 0)))
      then 'pending' else status end as status, asked and (status in ('unsubscribed', 'bounced') or (status = 'pending' and (expired_days is null or expired_days > 0))) as changed
    from (select *, k % 2 = 0 or k % 7 = 0 as asked from subs)
    union all select lower(s_name) || '@example.net', 'pending', true from supplier""",
)
def subscription_upsert(spark, d):
    at = F.lit("2026-02-20").cast("timestamp")
    known = _subscribers(spark, d)
    asked = table(spark, d, "customer").filter("c_custkey % 2 = 0 or c_custkey % 7 = 0").select(F.concat(F.lit(" "), F.upper("c_name"), F.lit("@Example.com ")).alias("email"))
    fresh = table(spark, d, "supplier").select(F.concat("s_name", F.lit("@example.net")).alias("email"))
    requests = asked.unionByName(fresh).select("email", F.lit("tok").alias("token_hash"), at.alias("expires_at"))
    return G.upsert_subscriptions(known, requests, at).select("email", "status", "changed")


@query(
    "subscription_transitions",
    f"""with {S_SUBS}, e as (select *, case when k % 3 = 0 then 'unsubscribe' else 'confirm' end as action from subs),
    x as (select *, case when action = 'confirm' then case when status = 'confirmed' then 'already_confirmed' when status <> 'pending' then 'invalid'
      when expired_days is null or expired_days > 0 then 'expired' else 'confirm' end
      else case when status = 'unsubscribed' then 'already_or_unknown' else 'unsubscribe' end end as decision from e)
    select email, action, decision, case decision when 'confirm' then 'confirmed' when 'unsubscribe' then 'unsubscribed' else status end as next_status from x""",
)
def subscription_transitions(spark, d):
    state = _subscribers(spark, d)
    events = table(spark, d, "customer").select(
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"), F.when(C("c_custkey") % 3 == 0, "unsubscribe").otherwise("confirm").alias("action")
    )
    return G.subscription_transitions(state, events, F.lit("2026-02-20").cast("timestamp"))


@query(
    "token_tail",
    """select lower(c_name) || '@example.com' as email, case when c_custkey % 4 = 1 then least(c_custkey % 30 + 2, 20) else c_custkey % 30 + 1 end as tokens,
      case when c_custkey % 4 = 1 then 't' || greatest(1, c_custkey % 30 + 2 - 19) else 't1' end as first_token from customer""",
)
def token_tail(spark, d):
    state = _subscribers(spark, d)
    tokens = state.select("email", F.concat(F.lit("t"), (F.size("unsubscribe_token_hashes") + 1).cast("string")).alias("token_hash"))
    out = G.add_unsubscribe_token(state, tokens)
    return out.select("email", F.size("unsubscribe_token_hashes").cast("bigint").alias("tokens"), C("unsubscribe_token_hashes")[0].alias("first_token"))


@query(
    "prune_subscribers",
    f"with {S_SUBS} select status, count(*) as rows from subs where not (status = 'pending' and age > 30) group by all",
)
def prune_subscribers(spark, d):
    out = G.prune(_subscribers(spark, d), F.lit("2026-02-20").cast("timestamp"))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


# --- streams --------------------------------------------------------------------------------

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@query(
    "stream_rate_limit",
    "select user_id, date_trunc('hour', ts) as window_started_at, count(*) as request_count, count(*) <= 1 as allowed from events group by all",
)
def stream_rate_limit(spark, d):
    events = jobs.file_stream(spark, d, "events", EVENTS)
    path = jobs.drain(jobs.rate_limit_stream(events, "user_id", "ts", 60, 1), "update")
    return jobs.latest(spark, path, ["user_id", "window_started_at"])


@query(
    "stream_absence",
    """with days as (select day, row_number() over (order by day) as n from (select distinct cast(ts as date) as day from events)),
    l as (select user_id, max(n) as last_n from events join days on day = cast(ts as date) where user_id % 3 = 0 or n % 9 = 1 group by user_id), t as (select max(n) as total from days)
    select user_id as entity, last_n, total - last_n as missing, case when total - last_n >= 3 then 'closed' when total > last_n then 'missing' else 'open' end as status from l, t""",
)
def stream_absence(spark, d):
    """Sightings arrive as a stream; absence is read against the safe scans so far."""
    days = L.grid_rank(table(spark, d, "events").withColumn("day", F.to_date("ts")), "day")
    events = jobs.file_stream(spark, d, "events", EVENTS).withColumn("day", F.to_date("ts"))
    sightings = events.join(days, "day").filter("user_id % 3 = 0 or n % 9 = 1").select(C("user_id").alias("entity"), "n")
    path = jobs.drain(jobs.sightings_stream(sightings), "update")
    return jobs.absence_status(jobs.latest(spark, path, ["entity"]), days)


@query("stream_first_last", "select user_id, min(ts) as first_seen_at, max(ts) as last_seen_at from events group by user_id")
def stream_first_last(spark, d):
    events = jobs.file_stream(spark, d, "events", EVENTS)
    return jobs.latest(spark, jobs.drain(jobs.first_last_stream(events, "user_id", "ts"), "update"), ["user_id"])


@query(
    "stream_subscriptions",
    """with recursive e as (select user_id, floor(epoch(ts))::bigint as t, event_id, event_type as a,
      row_number() over (partition by user_id order by floor(epoch(ts))::bigint, event_id) as k from events where event_type in ('signup', 'purchase', 'error')),
    f as (
      select user_id, 0::bigint as k, null::varchar as status, null::bigint as expires, 0::bigint as changes, 0::bigint as t from (select distinct user_id from e)
      union all
      select user_id, k, case when opened then 'pending' when confirmed then 'confirmed' when ended then 'unsubscribed' else status end,
        case when opened then t + 86400 else expires end, changes + (opened or confirmed or ended)::bigint, t
      from (select f.user_id, e.k, f.status, f.expires, f.changes, e.t,
          a = 'signup' and coalesce(f.status is null or f.status = 'unsubscribed' or (f.status = 'pending' and coalesce(f.expires < e.t, true)), false) as opened,
          coalesce(a = 'purchase' and f.status = 'pending' and f.expires >= e.t, false) as confirmed,
          coalesce(a = 'error' and f.status <> 'unsubscribed', false) as ended
        from f join e on e.user_id = f.user_id and e.k = f.k + 1)
    )
    select user_id::varchar as email, max(t) as "at", max_by(status, k) as status, max(changes) as changes from f group by user_id having max_by(coalesce(status, ''), k) <> ''""",
)
def stream_subscriptions(spark, d):
    """Signups subscribe, purchases confirm, errors cancel: a state machine per address."""
    events = jobs.file_stream(spark, d, "events", EVENTS).filter("event_type in ('signup', 'purchase', 'error')")
    action = F.when(C("event_type") == "signup", "subscribe").when(C("event_type") == "purchase", "confirm").otherwise("unsubscribe")
    shaped = events.select(
        C("user_id").cast("string").alias("email"), "event_id", action.alias("action"), F.unix_timestamp("ts").alias("at"),
        (F.unix_timestamp("ts") + 86400).alias("expires"),
    )
    path = jobs.drain(jobs.subscription_events(shaped), "append")
    return jobs.subscription_status(spark.read.parquet(path))


@query("stream_observations", "select count(*) as rows from (select distinct user_id, event_type, ts from events)")
def stream_observations(spark, d):
    """The event file read as observations, each kept once."""
    events = jobs.file_stream(spark, d, "events", EVENTS)
    obs = events.select(C("user_id").cast("string").alias("source_id"), C("event_type").alias("source_identifier"), C("ts").alias("observed_at"))
    twice = obs.unionByName(obs)
    path = jobs.drain(jobs.deduplicated_observations(twice), "append")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))


