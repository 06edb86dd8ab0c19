"""Function queries: text, URL, date, value and search functions over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from listwright.functions import dates, search, text, urls, values
from listwright.operators import quality
from listwright.queries.base import (
    query,
    s_any,
    s_board,
    s_fragments,
    s_has,
    s_html,
    s_norm,
    s_strip,
    table,
)

C = F.col
DAY = dt.date(1998, 6, 15)
PHRASES = ("mit license", "this is", "und der", "de la", "the the")


@query("text_normalise", f"select doc_id, md5({s_norm('text')}) as h, length({s_norm('text')}) as n from documents")
def text_normalise(spark, d):
    n = text.normalise_text(C("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("n")).select(
        "doc_id", F.md5("n").alias("h"), F.length("n").alias("n")
    )


@query(
    "phrase_match",
    f"select doc_id, {', '.join(f'{s_has(chr(110), p)} as p{i}' for i, p in enumerate(PHRASES))} "
    f"from (select doc_id, {s_norm('text')} as n from documents)",
)
def phrase_match(spark, d):
    df = table(spark, d, "documents").select("doc_id", text.normalise_text(C("text")).alias("n"))
    return df.select("doc_id", *[text.has_phrase(C("n"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)])


S_QUERY = """
array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
  lambda p: p <> '' and not (starts_with(lower(split_part(p, '=', 1)), 'utm_')
    or lower(split_part(p, '=', 1)) in ('gclid', 'fbclid', 'ref', 'source'))),
  lambda p: case when contains(p, '=') then p else p || '=' end), '&')
"""
S_CANONICAL = f"""
select page_id, scheme || '://' || host || case when tidy = '' then '/' else tidy end
  || case when q = '' then '' else '?' || q end as canonical
from (select page_id, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) as scheme,
  lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as host,
  regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/+$', '') as tidy,
  {S_QUERY} as q from pages)
"""


@query("url_canonical", S_CANONICAL)
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_url(C("url")).alias("canonical"))


@query(
    "stable_id",
    f"select doc_id, substr(sha256({s_norm('source')} || '|' || lang || '|' || doc_id), 1, 16) as id from documents",
)
def stable_id(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.stable_id(C("source"), C("lang"), C("doc_id").cast("string")).alias("id")
    )


@query(
    "employer_clean",
    """select p_partkey, case when p_name = 'red widget' then 'RedWidget Group' else
       array_to_string(list_transform(string_split(p_name, ' '),
         lambda w: case when w in ('red', 'ring', 'gear') then upper(w) else w end), ' ') end as name from part""",
)
def employer_clean(spark, d):
    cleaned = text.clean_name(C("p_name"), {"red widget": "RedWidget Group"}, ["RED", "RING", "GEAR"])
    return table(spark, d, "part").select("p_partkey", cleaned.alias("name"))


@query("html_text", f"select page_id, md5({s_html('html')}) as h, length({s_html('html')}) as n from pages")
def html_text(spark, d):
    df = table(spark, d, "pages").select("page_id", text.html_to_text(C("html")).alias("t"))
    return df.select("page_id", F.md5("t").alias("h"), F.length("t").alias("n"))


@query("board_text", f"select conv_id, turn, md5({s_board('text')}) as h from conversations")
def board_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.board_text(C("text"))).alias("h"))


@query(
    "class_text",
    "select page_id, md5(" + s_html("regexp_extract(html, '<div class=\"ad\"[^>]*>(.*?)</[^>]+>', 1, 's')") + ") as h from pages",
)
def class_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.class_text(C("html"), "ad")).alias("h"))


@query(
    "url_resolve",
    """select page_id, pos, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || links[pos] as link,
       regexp_extract(url, '^([^?#]*/)', 1) || substr(links[pos], 2) as sibling
       from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as links from pages),
       unnest(range(1, len(links) + 1)) as u(pos)""",
)
def url_resolve(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    df = table(spark, d, "pages").select("page_id", "url", F.posexplode(links).alias("pos", "href"))
    return df.select(
        "page_id",
        (C("pos") + 1).alias("pos"),
        urls.resolve_url(C("url"), C("href")).alias("link"),
        urls.resolve_url(C("url"), F.expr("substring(href, 2)")).alias("sibling"),
    )


S_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"


@query(
    "email_redact",
    f"""select doc_id, md5(regexp_replace(text, '{S_EMAIL}', '[contact email on source]', 'g')) as h,
        regexp_matches(text, '{S_EMAIL}') as found from documents""",
)
def email_redact(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.md5(text.redact_email(C("text"))).alias("h"), text.has_email(C("text")).alias("found")
    )



@query(
    "secret_scan",
    f"""with t as (select 'documents' as tab, cast(doc_id as varchar) as key, text from documents
        union all select 'conversations', conv_id || '/' || turn, text from conversations)
        select tab, key, rule from t, (values {", ".join(f"('{k}', '{v}')" for k, v in text.SECRETS.items())}) s(rule, pattern)
        where regexp_matches(text, pattern)
        union all select tab, key, 'email address' from t where regexp_matches(text, '{S_EMAIL}')""",
)
def secret_scan(spark, d):
    docs = table(spark, d, "documents").select(C("doc_id").cast("string").alias("key"), "text")
    talk = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("key"), "text")
    return (
        quality.check_leaks(docs, "key", ["text"]).withColumn("tab", F.lit("documents"))
        .unionByName(quality.check_leaks(talk, "key", ["text"]).withColumn("tab", F.lit("conversations")))
        .select("tab", "key", "rule")
    )


@query(
    "location_hint",
    """select doc_id, case when contains(t, 'hybrid') then 'hybrid'
       when contains(t, 'remote') or contains(t, 'homeworking') or contains(t, 'home working') then 'remote_uk'
       when contains(t, 'on-site') or contains(t, 'onsite') or contains(t, 'office based') then 'onsite'
       when contains(t, 'multiple locations') or contains(t, 'various locations') then 'multi_location' else 'unknown' end as kind
       from (select doc_id, lower(lang || ' ' || case doc_id % 5 when 0 then 'Hybrid, Leeds' when 1 then 'Home working'
         when 2 then 'Office based' when 3 then 'Various locations' else 'London' end) as t from documents)""",
)
def location_hint(spark, d):
    place = F.when(C("doc_id") % 5 == 0, "Hybrid, Leeds").when(C("doc_id") % 5 == 1, "Home working")
    place = place.when(C("doc_id") % 5 == 2, "Office based").when(C("doc_id") % 5 == 3, "Various locations").otherwise("London")
    return table(spark, d, "documents").select("doc_id", text.location_hint(C("lang"), place).alias("kind"))


@query(
    "salary_range",
    """with v as (select o_orderkey, o_orderkey % 4 as k, round_even(o_totalprice, 0) as lo,
         round_even(o_totalprice * 2, 0) as hi from orders),
       f as (select *, format('{:,}', cast(lo as bigint)) as l, format('{:,}', cast(hi as bigint)) as h from v)
       select o_orderkey, case k when 0 then '£' || l || '-£' || h when 1 then 'EUR ' || h when 2 then '£' || l end as salary from f""",
)
def salary_range(spark, d):
    k = C("o_orderkey") % 4
    low = F.when(k.isin(0, 2), C("o_totalprice"))
    high = F.when(k.isin(0, 1), C("o_totalprice") * 2).when(k == 2, C("o_totalprice"))
    return table(spark, d, "orders").select(
        "o_orderkey", values.salary_range(low, high, F.when(k == 1, "eur")).alias("salary")
    )


@query(
    "salary_text",
    """select c_custkey, case c_custkey % 3 when 0 then 'GBP ' || c_nationkey || '-' || (c_nationkey + 5)
       when 1 then 'GBP ' || c_nationkey else cast(c_nationkey as varchar) end as salary from customer""",
)
def salary_text(spark, d):
    k, n = C("c_custkey") % 3, C("c_nationkey")
    parts = F.struct(
        F.when(k < 2, " GBP ").alias("currency"),
        n.cast("string").alias("lower"),
        F.when(k == 0, (n + 5).cast("string")).when(k == 1, n.cast("string")).otherwise("").alias("upper"),
    )
    return table(spark, d, "customer").select("c_custkey", values.salary_text(parts).alias("salary"))


@query(
    "org_type",
    """select c_custkey, case when contains(lower(t), 'nhs') or contains(lower(t), 'hospital') then 'public_health'
       when contains(lower(e), 'university') then 'higher_education'
       when contains(lower(e), 'city council') then 'government' else 'corporate' end as kind
       from (select c_custkey, e, e || ' ' || c_mktsegment || ' ' || case when c_custkey % 7 = 0 then 'Hospital ward' else '' end as t
         from (select *, case c_nationkey % 4 when 0 then 'University of ' when 1 then 'Leeds City Council ' when 2 then 'NHS '
           else 'Firm ' end || c_name as e from customer))""",
)
def org_type(spark, d):
    n = C("c_nationkey") % 4
    employer = F.concat(
        F.when(n == 0, "University of ").when(n == 1, "Leeds City Council ").when(n == 2, "NHS ").otherwise("Firm "), "c_name"
    )
    note = F.when(C("c_custkey") % 7 == 0, "Hospital ward").otherwise("")
    return table(spark, d, "customer").select("c_custkey", text.org_type(employer, C("c_mktsegment"), note).alias("kind"))


@query(
    "paid_flag",
    """select p_partkey, case p_partkey % 4 when 0 then false when 1 then true when 2 then true end as paid from part""",
)
def paid_flag(spark, d):
    k = C("p_partkey") % 4
    pay = F.when(k == 0, "Unpaid, no salary").when(k == 1, F.concat(F.lit("£"), "p_size")).when(k == 2, "Good SALARY").otherwise("To agree")
    return table(spark, d, "part").select("p_partkey", text.paid_flag(pay).alias("paid"))


@query(
    "employer_of",
    """select s_suppkey, case when s_suppkey % 5 = 0 then 'Tenant Ltd' when s_suppkey % 5 = 1 then 'SUPPLIER One'
       when s_suppkey % 5 = 2 then 'Employer not stated' else s_name end as employer from supplier""",
)
def employer_of(spark, d):
    k = C("s_suppkey") % 5
    url = F.when(k == 0, "https://T.example.net/x").otherwise("https://o.example.net/x")
    named = F.when(k == 1, "supplier-ONE").when(k == 2, F.lit(" ")).otherwise(C("s_name"))
    found = values.employer_of([F.lit(None).cast("string"), F.lit(""), named], url, {"t.example.net": "Tenant Ltd"}, {"supplier one": "SUPPLIER One"})
    return table(spark, d, "supplier").select("s_suppkey", found.alias("employer"))


@query(
    "slug",
    "select distinct o_orderpriority, array_to_string(list_filter(string_split(replace(lower('Team & ' || o_orderpriority), '&', 'and'), ' '), lambda x: x <> ''), '-') as slug from orders",
)
def slug(spark, d):
    df = table(spark, d, "orders").select("o_orderpriority").distinct()
    return df.select("o_orderpriority", text.slug(F.concat(F.lit("Team & "), "o_orderpriority")).alias("slug"))


@query(
    "display_label",
    """select event_type, case when event_type = 'error' then 'Fault' else upper(event_type[1]) || event_type[2:] || ' Kind' end as label,
       count(*) as n from events group by all""",
)
def display_label(spark, d):
    df = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    named = text.label(F.when(C("event_type") == "error", "error").otherwise(F.concat("event_type", F.lit("_kind"))), {"error": "Fault"})
    return df.select("event_type", named.alias("label"), "n")


@query(
    "text_fragments",
    f"select doc_id, len(f) as n, md5(array_to_string(f, chr(2))) as h from (select doc_id, {s_fragments('text')} as f from documents)",
)
def text_fragments(spark, d):
    df = table(spark, d, "documents").select("doc_id", text.fragments(C("text")).alias("f"))
    return df.select("doc_id", F.size("f").alias("n"), F.md5(F.array_join("f", "\u0002")).alias("h"))


EVIDENCE_TERMS = ("mit license", "apache license", "this is", "und der")


@query(
    "evidence_fragment",
    f"""select doc_id, f[1] as fragment from (select doc_id, list_filter({s_fragments('text')},
        lambda p: {s_any(s_norm('p'), EVIDENCE_TERMS)}) as f from documents)""",
)
def evidence_fragment(spark, d):
    found = text.evidence_fragment({"text": C("text")}, EVIDENCE_TERMS)
    return table(spark, d, "documents").select("doc_id", found["text"].alias("fragment"))


@query(
    "restriction_lists",
    f"""select doc_id, len(f) as n, md5(array_to_string(f, chr(2))) as h from (select doc_id, list_filter({s_fragments('text')},
        lambda p: {s_any(s_norm('p'), ("license", "of the"))}) as raw,
        list_filter(raw, lambda x, i: list_position(raw, x) = i) as f from documents)""",
)
def restriction_lists(spark, d):
    df = table(spark, d, "documents").select("doc_id", text.matching_fragments(C("text"), ("license", "of the")).alias("f"))
    return df.select("doc_id", F.size("f").alias("n"), F.md5(F.array_join("f", "\u0002")).alias("h"))


@query(
    "email_normalise",
    r"""with m as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) as raw from documents)
        select doc_id, raw, case when length(lower(raw)) <= 254 and regexp_matches(lower(raw), '^[^\s@]+@[^\s@]+\.[^\s@]+$')
        then lower(raw) end as email, 'd1:' || substr(sha256(lower(raw)), 1, 16) as delivery_key from m""",
)
def email_normalise(spark, d):
    found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), 0)
    df = table(spark, d, "documents").select("doc_id", F.explode(found).alias("raw"))
    shouted = F.concat(F.lit("  "), F.upper("raw"), F.lit(" "))
    return df.select(
        "doc_id", "raw", text.normalise_email(shouted).alias("email"),
        text.idempotency_key(F.lit("d1"), F.lower("raw")).alias("delivery_key"),
    )


# --- dates ----------------------------------------------------------------------------------


@query(
    "date_parse",
    "select o_orderkey, case when o_orderkey % 7 = 6 then null else cast(o_orderdate as date) end as day from orders",
)
def date_parse(spark, d):
    k, t = C("o_orderkey") % 7, C("o_orderdate")
    shaped = (
        F.when(k == 0, F.date_format(t, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(t, "d MMMM yyyy"))
        .when(k == 2, F.date_format(t, "dd MMM yyyy"))
        .when(k == 3, F.concat(F.date_format(t, "MMMM d"), F.lit("th, "), F.date_format(t, "yyyy")))
        .when(k == 4, F.concat(F.lit("updated "), F.date_format(t, "yyyy-MM-dd'T'HH:mm")))
        .when(k == 5, F.concat(F.date_format(t, "d"), F.lit("ND  "), F.upper(F.date_format(t, "MMM yyyy"))))
        .otherwise(F.date_format(t, "EEE, dd/MM/yyyy"))
    )
    return table(spark, d, "orders").select("o_orderkey", dates.parse_date(shaped).alias("day"))


@query(
    "relative_dates",
    """select o_orderkey, cast(case o_orderkey % 4 when 0 then cast(o_orderdate as date)
       when 1 then cast(o_orderdate as date) - cast(o_orderkey % 10 as integer)
       when 2 then cast(o_orderdate as date) - cast(7 * (o_orderkey % 6) as integer) else date '2001-02-03' end as date) as day from orders""",
)
def relative_dates(spark, d):
    k = C("o_orderkey") % 4
    worded = (
        F.when(k == 0, "Posted today")
        .when(k == 1, F.concat((C("o_orderkey") % 10).cast("string"), F.lit(" days ago")))
        .when(k == 2, F.concat(F.lit("Posted "), (C("o_orderkey") % 6).cast("string"), F.lit(" weeks ago")))
        .otherwise("3 Feb 2001")
    )
    return table(spark, d, "orders").select(
        "o_orderkey", dates.relative_date(worded, F.to_date("o_orderdate")).alias("day")
    )




@query(
    "yearless_dates",
    """with t as (select o_orderkey, cast(o_orderdate as date) as o from orders),
       u as (select *, try_cast('1998' || strftime(o, '-%m-%d') as date) as b from t)
       select o_orderkey,
         case when b < date '1998-06-13' then try_cast('1999' || strftime(o, '-%m-%d') as date) else b end as upcoming,
         case when b > date '1998-06-17' then try_cast('1997' || strftime(o, '-%m-%d') as date) else b end as past
       from u""",
)
def yearless_dates(spark, d):
    worded = F.when(C("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d MMM")).otherwise(F.date_format("o_orderdate", "dd MMMM"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        dates.yearless_date(worded, True, F.lit(DAY)).alias("upcoming"),
        dates.yearless_date(worded, False, F.lit(DAY)).alias("past"),
    )


@query(
    "recency_urgency",
    """with t as (select o_orderkey, cast(o_orderdate as date) as o, date '1998-06-15' as n from orders),
       u as (select o_orderkey, greatest(n - o, 0) as age, o - n as left_days from t)
       select o_orderkey, case when age <= 7 then 1.0 when age <= 30 then 0.5 else 0.0 end as recency,
         case when left_days between 0 and 14 then 1.0 when left_days between 15 and 30 then 0.5 else 0.0 end as urgency from u""",
)
def recency_urgency(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        dates.recency_ratio(day, F.lit(DAY)).alias("recency"),
        dates.urgency_ratio(day, F.lit(DAY)).alias("urgency"),
    )


@query(
    "date_flags",
    """select o_orderkey, o_orderdate >= timestamp '1998-06-14 12:00:00' as is_new,
       cast(o_orderdate as date) <= date '1998-06-22' as is_closing,
       strftime(o_orderdate, '%d %b %Y') as shown,
       year(o_orderdate) = 1997 and month(o_orderdate) in (6, 7, 8) as summer from orders""",
)
def date_flags(spark, d):
    now = F.lit("1998-06-15 12:00:00").cast("timestamp")
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        dates.is_new(C("o_orderdate"), now).alias("is_new"),
        dates.is_closing(day, now).alias("is_closing"),
        dates.date_label(day).alias("shown"),
        dates.programme_window(day, (6, 7, 8), 1997).alias("summer"),
    )


@query(
    "window_floor",
    "select event_id, strftime(time_bucket(interval '45 minutes', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as started from events",
)
def window_floor(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.date_format(dates.window_floor(C("ts"), 45), "yyyy-MM-dd HH:mm:ss").alias("started")
    )


@query(
    "confirm_decision",
    """select o_orderkey, case when o_orderstatus = 'F' then 'already_confirmed' when o_orderstatus <> 'O' then 'invalid'
       when o_orderdate < timestamp '1998-01-01' then 'expired' else 'confirm' end as decision,
       case when o_orderstatus = 'P' then 'already_or_unknown' else 'unsubscribe' end as leave from orders""",
)
def confirm_decision(spark, d):
    status = F.when(C("o_orderstatus") == "F", "confirmed").when(C("o_orderstatus") == "O", "pending").otherwise("unsubscribed")
    now = F.lit("1998-01-01").cast("timestamp")
    return table(spark, d, "orders").select(
        "o_orderkey",
        dates.confirm_decision(status, C("o_orderdate"), now).alias("decision"),
        dates.unsubscribe_decision(C("o_orderkey"), status).alias("leave"),
    )


# --- numbers, arrays, JSON ------------------------------------------------------------------


@query(
    "weighted_parts",
    """select l_orderkey, l_linenumber, round_even(20 * (l_quantity / 50), 0)::int as quantity,
       round_even(35 * least(1.0, l_linenumber / 3.0), 0)::int as line, round_even(5 * (l_discount * 10), 0)::int as discount,
       round_even(20 * (l_quantity / 50), 0)::int + round_even(35 * least(1.0, l_linenumber / 3.0), 0)::int
         + round_even(5 * (l_discount * 10), 0)::int as total from lineitem""",
)
def weighted_parts(spark, d):
    ratios = {
        "quantity": C("l_quantity") / 50,
        "line": values.clamp(C("l_linenumber"), 3),
        "discount": C("l_discount") * 10,
    }
    parts = values.components(ratios, {"quantity": 20, "line": 35, "discount": 5})
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parts.alias("m"))
    return df.select("l_orderkey", "l_linenumber", *[C("m")[n].alias(n) for n in ratios], values.total(C("m")).alias("total"))


@query(
    "list_functions",
    """with t as (select p_partkey, p_brand as b, p_type as t, string_split(p_name, ' ') as w from part)
       select p_partkey, b || '|' || t as parts, len(w || [b]) as joined,
         array_to_string(list_concat(list_filter([b, t, w[1]], lambda x: true), list_filter(w, lambda x: x not in (b, t, w[1]))), '|') as united,
         coalesce(w[1], b) as first_item, array_to_string(list_concat(w, [b, t])[-2:], '|') as tail from t""",
)
def list_functions(spark, d):
    df = table(spark, d, "part").withColumn("w", F.split("p_name", " "))
    pair = F.array("p_brand", "p_type")
    with_first = F.array(C("p_brand"), C("p_type"), C("w")[0])
    return df.select(
        "p_partkey",
        F.array_join(values.split_list(F.concat(F.lit(" "), "p_brand", F.lit(" || "), "p_type", F.lit("|"))), "|").alias("parts"),
        F.size(values.array_union_ordered(C("w"), F.array("p_brand"))).alias("joined"),
        F.array_join(values.evidence_union(with_first, C("w")), "|").alias("united"),
        values.first_of(F.array().cast("array<string>"), C("w"), pair).alias("first_item"),
        F.array_join(values.array_tail(F.concat("w", pair), 2), "|").alias("tail"),
    )


@query(
    "json_extract",
    "select event_id, cast(json_extract(props, '$.k') as bigint) as k, json_valid(props) as readable from events",
)
def json_extract(spark, d):
    return table(spark, d, "events").select(
        "event_id", values.decode_json(C("props"), "k BIGINT")["k"].alias("k"), values.is_json(C("props")).alias("readable")
    )


@query(
    "embedded_json",
    "select page_id, regexp_extract(html, 'track\\((\\d+)\\)', 1)::bigint as n from pages",
)
def embedded_json(spark, d):
    state = F.concat(
        F.regexp_replace("html", r"(?s)^.*?track\((\d+)\).*$", '<script>window.S = {"meta": {"n": $1}};</script>')
    )
    df = table(spark, d, "pages").select("page_id", values.embedded_json(state, r"(?s)window\.S\s*=\s*(\{.*?\});", "meta STRUCT<n:BIGINT>").alias("s"))
    return df.select("page_id", C("s.meta.n").alias("n"))


@query(
    "stable_json",
    """select md5('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as h from nation
       union all select md5('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') from customer""",
)
def stable_json(spark, d):
    nation = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    customer = table(spark, d, "customer").select("c_mktsegment", "c_custkey")
    return nation.select(F.md5(values.stable_json(nation)).alias("h")).unionByName(
        customer.select(F.md5(values.stable_json(customer)).alias("h"))
    )


@query("excerpt", f"select doc_id, md5(substr({s_strip('text')}, 1, 500)) as h from documents")
def excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.excerpt(C("text"))).alias("h"))


# --- search ---------------------------------------------------------------------------------


def s_search(x: str) -> str:
    plain = f"replace(strip_accents(coalesce({x}, '')), '&', ' and ')"
    return f"trim(regexp_replace(lower({plain}), '[^a-z0-9]+', ' ', 'g'))"


@query("search_text", f"select doc_id, md5({s_search('text')}) as h from documents")
def search_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(search.search_text(C("text"))).alias("h"))


def s_score(x: str, phrase: str) -> str:
    every = " and ".join(f"contains({x}, '{w}')" for w in phrase.split())
    return (
        f"case when {x} = '{phrase}' then 100 when starts_with({x}, '{phrase}') then 75 "
        f"when contains({x}, '{phrase}') then 50 when {every} then 20 else 0 end"
    )


@query(
    "search_score",
    f"""select p_partkey, 2 * {s_score('t', 'red ring')} + {s_score('b', 'red ring')} + 3 * {s_score('e', 'brand 1')} as score,
        contains(lower(p_type), 'eco') or contains(lower(p_type), 'prom') as quick
        from (select *, {s_search('p_name')} as t, {s_search("p_type || ' ' || p_name")} as b, {s_search('p_brand')} as e from part)
        where contains(b, 'red') and contains(b, 'ring')""",
)
def search_score(spark, d):
    df = table(spark, d, "part").withColumns(
        {
            "t": search.search_text(C("p_name")),
            "b": search.search_text(F.concat_ws(" ", "p_type", "p_name")),
            "e": search.search_text(C("p_brand")),
        }
    )
    df = df.filter(search.all_words(C("b"), "Ring, réd"))
    scored = search.search_score(C("t"), C("b"), C("e"), "Réd  ring", "Brand#1")
    return df.select("p_partkey", scored.alias("score"), search.any_substring(C("p_type"), ["eco", "prom"]).alias("quick"))


