"""Every payload format that the other extraction queries do not reach, and one job over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.queries.base import query, s_html, table
from listwright.queries.sources import _payloads, _registry
from listwright.session import cut
from listwright.sources import extract

C = F.col


def _n() -> Column:
    return C("at").cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _page(before: str, after: str, sep: str = "\n"):
    return lambda recs: _cat(before, F.array_join(recs, sep), after)


def _case(number: int, *values) -> Column:
    """The value for each remainder of the record's number."""
    out = F.lit(values[-1]) if isinstance(values[-1], str) or values[-1] is None else values[-1]
    for k, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(C("at") % number == k, v).otherwise(out)
    return out


def _numbered(spark, d, name: str, key: str, kind: str, by: str) -> DataFrame:
    """Rows of a table with their number ``at`` and a source ``id`` of the kind."""
    return table(spark, d, name).withColumns({"at": C(key), "id": F.concat(F.lit(f"{kind}-"), F.lower(by))})


def _inputs(spark, d, kind: str, rows: DataFrame, body) -> tuple[DataFrame, DataFrame]:
    return _payloads(rows.select("id", "at", "rec"), body), _registry(spark, d, kind, rows.select("id").distinct())


def workday(spark, d):
    rows = _numbered(spark, d, "orders", "o_orderkey", "workday", "o_orderstatus")
    rec = F.struct(
        _case(5, "", *[_cat("//job/", _n())] * 4).alias("externalPath"), _cat("W", _n()).alias("id"), _cat("Role ", _n()).alias("title"),
        C("o_orderpriority").alias("locationsText"), F.date_format("o_orderdate", "d MMMM yyyy").alias("postedOn"),
        _cat("<p>", C("o_orderpriority"), " &amp; <b>more</b></p>").alias("description"),
    )
    return _inputs(spark, d, "workday", rows.withColumn("rec", F.to_json(rec)), _page('{"total":1,"jobPostings":[', "]}", ","))


@query(
    "extract_workday",
    """select case when o_orderkey % 5 = 0 then 'W' || o_orderkey else '//job/' || o_orderkey end as source_identifier, 'Role ' || o_orderkey as title,
      'https://workday-' || lower(o_orderstatus) || '.example.com/api/jobs/' || case when o_orderkey % 5 = 0 then '' else 'job/' || o_orderkey end as source_url,
      o_orderpriority as location, o_orderpriority || ' & more' as description, cast(o_orderdate as date) as published_date from orders""",
)
def extract_workday(spark, d):
    """Postings of a search result; those without a path take the next filled identifier."""
    raw = extract.extract_json(*workday(spark, d), {"workday": extract.JSON_SPECS["workday"]})
    return raw.select("source_identifier", "title", "source_url", "location", "description", "published_date")


def boards(spark, d):
    attr = lambda name, c: _cat(f' {name}="', c, '"')
    tag = _cat(
        "<li", attr("data-job-id", _n()), attr("data-title", C("p_name")), attr("data-url", _cat("/b/", _n())),
        F.when(C("at") % 3 == 0, attr("data-employer", C("p_brand"))).otherwise(""), F.when(C("at") % 3 == 1, attr("data-office", C("p_type"))).otherwise(""),
        F.when(C("at") % 5 == 0, attr("data-publisher", F.lit("Press &amp; Co"))).otherwise(""), attr("data-political-affiliation", C("p_type")), ">x</li>",
    )
    pages = registry = None
    for k, kind in enumerate(("government_portal", "trusted_board")):
        rows = _numbered(spark, d, "part", "p_partkey", kind, F.regexp_replace("p_brand", "[^0-9]", "")).filter(C("p_size") % 2 == k)
        part, dim = _inputs(spark, d, kind, rows.withColumn("rec", tag), _page("<ul>", "</ul>"))
        pages, registry = (part, dim) if pages is None else (pages.unionByName(part), registry.unionByName(dim))
    return pages, registry


@query(
    "extract_boards",
    """with p as (select *, regexp_replace(p_brand, '[^0-9]', '', 'g') as m from part)
    select cast(p_partkey as varchar) as source_identifier, 'government_portal' as source_type, 'official_government_portal' as source_authority,
      'Name government_portal-' || m as employer, cast(null as varchar) as named_office_or_mp, cast(null as varchar) as listing_publisher,
      p_type as political_affiliation from p where p_size % 2 = 0
    union all select cast(p_partkey as varchar), 'trusted_board', 'trusted_sector_board',
      case when p_partkey % 3 = 0 then p_brand else 'Name trusted_board-' || m end,
      case p_partkey % 3 when 0 then p_brand when 1 then p_type else 'Name trusted_board-' || m end,
      case when p_partkey % 5 = 0 then 'Press & Co' else 'Name trusted_board-' || m end, p_type from p where p_size % 2 = 1""",
)
def extract_boards(spark, d):
    """Listing tags of a government portal and of a sector board, which names employer, office and publisher itself."""
    raw = extract.extract_data_attributes(*boards(spark, d), kinds=["government_portal", "trusted_board"])
    return raw.select("source_identifier", "source_type", "source_authority", "employer", "named_office_or_mp", "listing_publisher", "political_affiliation")


def charityjob(spark, d):
    rows = _numbered(spark, d, "customer", "c_custkey", "charityjob", "c_mktsegment")
    card = _cat(
        '<article class="job-card-wrapper" job-id="', _n(), '">', _case(4, _cat('<a href="#" title="', C("c_name"), ' &amp; Sons" class="job-card-logo">x</a>'), "", "", ""),
        '<div class="job-title big"><a href="/jobs/', _case(4, "any", "alpha-beta", "gamma-trust", "delta"), "/great-role/", _n(), '">',
        F.when(C("at") % 7 == 0, "").otherwise(_cat("T ", _n())), '</a></div><div class="organisation">',
        _case(4, _cat(C("c_name"), " &amp; Sons, Leeds"), "Alpha Beta, Remote", "Gamma Trust", "Other, York"), "</div>",
        _case(3, '<span class="job-summary-item">• £20 an hour</span>', '<span class="job-summary-item">Voluntary</span>', ""),
        '<span class="posted-item">', _case(3, "3 days ago", "1 week ago", "Today"), "</span></article>",
    )
    body = _page('<script>{"total_count":"7"}</script>', "")
    return _inputs(spark, d, "charityjob", rows.withColumn("rec", card), body)


@query(
    "extract_charity_cards",
    """select cast(c_custkey as varchar) as source_identifier, case when c_custkey % 7 = 0 then 'Great Role' else 'T ' || c_custkey end as title,
      case c_custkey % 4 when 0 then c_name || ' & Sons' when 1 then 'Alpha Beta' when 2 then 'Gamma Trust' else 'Delta' end as employer,
      case c_custkey % 4 when 0 then 'Leeds' when 1 then 'Remote within the UK' when 2 then 'London (board search filter)' else 'Other, York' end as location,
      case when c_custkey % 4 = 1 then 'remote_uk' else 'unknown' end as location_type,
      case c_custkey % 3 when 0 then '£20 an hour' when 1 then 'Voluntary' end as salary, case when c_custkey % 3 = 0 then true end as paid,
      case c_custkey % 3 when 0 then 3 when 1 then 7 else 0 end as age from customer""",
)
def extract_charity_cards(spark, d):
    """Employer from logo, from the part of the line that the link names, or from the link; place from the rest."""
    pages, registry = charityjob(spark, d)
    raw = extract.extract_cards(pages, registry, {"charityjob": extract.CARD_SPECS["charityjob"]})
    seen = pages.agg(F.to_date(F.min("fetched_at")).alias("seen"))
    age = F.datediff("seen", "published_date").alias("age")
    return raw.crossJoin(F.broadcast(seen)).select("source_identifier", "title", "employer", "location", "location_type", "salary", "paid", age)


def nhs(spark, d):
    rows = _numbered(spark, d, "customer", "c_custkey", "nhs", "c_mktsegment")
    shown = lambda name, c: _cat(f'<div data-test="search-result-{name}">X: <strong class="v">', c, "</strong></div>")
    card = _cat(
        '<li class="nhsuk-list-panel search-result wide" data-test="search-result"><a href="/candidate/jobadvert/C9-', _n(),
        '?page=1&amp;x=2" data-test="search-result-job-title"> Nurse ', _n(), '</a><div data-test="search-result-location"><h3>', C("c_name"),
        ' <div class="location-font-size"> ', _case(3, "Leeds", "East London E1", ""), " </div></h3></div>",
        F.when(C("at") % 2 == 0, shown("salary", F.lit("£30,000"))).otherwise(""), shown("jobType", F.lit("Fixed term")),
        shown("workingPattern", F.lit("Full time")), shown("publicationDate", F.lit("3 February 2026")), shown("closingDate", F.lit("10 March 2026")), "</li>",
    )
    return _inputs(spark, d, "nhs_jobs", rows.withColumn("rec", card), _page("<p>1,200 jobs found in London</p><ul>", "</ul> <nav></nav>"))


@query(
    "extract_health_cards",
    """select 'C9-' || c_custkey as source_identifier, 'Nurse ' || c_custkey as title, c_name as employer,
      'https://nhs-' || lower(c_mktsegment) || '.example.com/candidate/jobadvert/C9-' || c_custkey || '?page=1&x=2' as source_url,
      case c_custkey % 3 when 0 then 'Leeds, London' when 1 then 'East London E1' else 'London' end as location,
      'Contract: Fixed term. Working pattern: Full time. Open the NHS listing to verify professional and experience requirements.' as description,
      case when c_custkey % 2 = 0 then '£30,000' end as salary, case when c_custkey % 2 = 0 then true end as paid,
      date '2026-02-03' as published_date, date '2026-03-10' as deadline, 'public_health' as organisation_type from customer""",
)
def extract_health_cards(spark, d):
    """Cards with labelled fields; places outside the city name it."""
    raw = extract.extract_cards(*nhs(spark, d), {"nhs_jobs": extract.CARD_SPECS["nhs_jobs"]})
    return raw.select(
        "source_identifier", "title", "employer", "source_url", "location", "description", "salary", "paid", "published_date", "deadline", "organisation_type"
    )


def academic(spark, d):
    rows = _numbered(spark, d, "part", "p_partkey", "ac", F.regexp_replace("p_brand", "[^0-9]", ""))
    card = _cat(
        '<div class="j-search-result__result" data-advert-id="', _n(), '"><a href="/job/A', _n(), '/x"> ', C("p_name"), " </a>",
        F.when(C("at") % 2 == 0, _cat('<div class="j-search-result__department">', C("p_type"), "</div>")).otherwise(""),
        '<div class="j-search-result__employer"><b>Uni ', C("p_brand"), "</b></div> <div>Location: York </div>",
        F.when(C("at") % 3 == 0, '<div class="j-search-result__info"><strong>Salary: </strong> £20 </div>').otherwise(""),
        "<p><strong>Date Placed: </strong> ", _case(2, "3 Feb", "30 Dec"), '</p><span class="j-search-result__date--blue x"> ',
        _case(2, "29 Dec", "2 Jan"), " </span></div>",
    )
    return _inputs(spark, d, "jobs_ac_uk", rows.withColumn("rec", card), _page('<strong class="job-count"> 1,234</strong>', ""))



@query(
    "extract_academic_cards",
    """select cast(p_partkey as varchar) as source_identifier, p_name as title, 'Uni ' || p_brand as employer, 'York' as location,
      'https://ac-' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '.example.com/job/A' || p_partkey || '/x' as source_url,
      case when p_partkey % 2 = 0 then 'Department: ' || p_type || '. ' else '' end || 'Open the jobs.ac.uk listing to verify qualifications and experience.' as description,
      case when p_partkey % 3 = 0 then '£20' end as salary, case when p_partkey % 2 = 0 then date '2026-02-03' else date '2025-12-30' end as published_date,
      case when p_partkey % 2 = 0 then date '2026-12-29' else date '2027-01-02' end as deadline from part""",
)
def extract_academic_cards(spark, d):
    """Cards cut at their starts; days without a year are put before or after the day of the scan."""
    raw = extract.extract_cards(*academic(spark, d), {"jobs_ac_uk": extract.CARD_SPECS["jobs_ac_uk"]})
    return raw.select("source_identifier", "title", "employer", "location", "source_url", "description", "salary", "published_date", "deadline")


def targetjobs(spark, d):
    rows = _numbered(spark, d, "documents", "doc_id", "tj", "source")
    apply = _case(3, "https://cc.wd3.myworkdayjobs.com/x", _cat("https://apply.example.com/", _n()), "mailto:x@example.com")
    rec = F.struct(
        F.when(C("at") % 10 != 9, _n()).alias("uuid"), _cat("e", _n()).alias("externalId"), _cat("Role &amp; ", _n()).alias("title"), _cat("/jobs/", _n()).alias("path"),
        _cat("<p>", C("text"), "</p>").alias("body"), _case(2, C("lang"), "").alias("location"), apply.alias("applicationUrl"),
        (C("at") % 5 != 0).alias("applicationOpen"), F.lit("2026-03-10").alias("applicationDeadline"),
        F.struct(_case(4, "BLACKROCK", _cat("Org ", _n()), "", None).alias("title")).alias("organisation"), F.lit("Parent").alias("parentOrganisationTitle"),
        F.struct(F.lit("GBP").alias("currency"), F.lit("20000").alias("lower"), _case(2, "20000", "30000").alias("upper")).alias("salary"),
        F.array(F.lit("2:1"), F.lit("First")).alias("degreeRequirements"),
    )
    return _inputs(spark, d, "targetjobs", rows.withColumn("rec", F.to_json(rec)), _page('{"search":{"result_count":9,"documents":[', "]}}", ","))


@query(
    "extract_graduate_search",
    f"""select case when doc_id % 10 = 9 then 'e' else '' end || doc_id as source_identifier, 'Role & ' || doc_id as title,
      case when doc_id % 3 = 0 then 'CHANEL' when doc_id % 4 = 0 then 'BlackRock' when doc_id % 4 = 1 then 'Org ' || doc_id else 'Parent' end as employer,
      'https://targetjobs.co.uk/jobs/' || doc_id as source_url,
      case doc_id % 3 when 0 then 'https://cc.wd3.myworkdayjobs.com/x' when 1 then 'https://apply.example.com/' || doc_id
        else 'https://targetjobs.co.uk/jobs/' || doc_id end as application_url, case when doc_id % 2 = 0 then lang else 'London' end as location,
      md5({s_html("text")}) as h, case when doc_id % 2 = 0 then 'GBP 20000' else 'GBP 20000-30000' end as salary, '2:1; First' as eligibility_text,
      doc_id % 5 = 0 as explicitly_closed, date '2026-03-10' as deadline from documents""",
)
def extract_graduate_search(spark, d):
    """A search result with employer precedence, checked tenant and brand names, salary records and degree lists."""
    raw = extract.extract_json(*targetjobs(spark, d), {"targetjobs": extract.JSON_SPECS["targetjobs"]})
    return raw.select(
        "source_identifier", "title", "employer", "source_url", "application_url", "location", F.md5("description").alias("h"), "salary", "eligibility_text",
        "explicitly_closed", "deadline",
    )


def w4mp(spark, d):
    rows = _numbered(spark, d, "customer", "c_custkey", "w4mp", "c_mktsegment")
    prop = lambda name, c: _cat(f'<p itemprop="{name}">', c, "</p>")
    card = _cat(
        '<article class="row job-advert"><a href="JobDetails.aspx?jobid=', _n(), '">More</a>', prop("title", _cat("Caseworker ", _n())),
        prop("hiringOrganization", _case(3, _cat(C("c_name"), " MP"), "House of Parliament", "MPower Ltd")),
        prop("jobLocation", _case(2, "Location: Leeds", "")), prop("baseSalary", _case(3, "Salary: £20", "Unpaid", "")),
        prop("datePosted", F.lit("3rd February 2026")), "<i>This closes on 10 March 2026.</i></article>",
    )
    return _inputs(spark, d, "w4mp", rows.withColumn("rec", card), _page("<main>", "</main>"))


@query(
    "extract_office_cards",
    """select cast(c_custkey as varchar) as source_identifier, 'Caseworker ' || c_custkey as title,
      case c_custkey % 3 when 0 then c_name || ' MP' when 1 then 'House of Parliament' else 'MPower Ltd' end as employer,
      'https://w4mp-' || lower(c_mktsegment) || '.example.com/api/JobDetails.aspx?jobid=' || c_custkey as source_url,
      case when c_custkey % 2 = 0 then 'Leeds' else 'Unknown' end as location, case c_custkey % 3 when 0 then '£20' when 1 then 'Unpaid' end as salary,
      case c_custkey % 3 when 0 then true when 1 then false end as paid, case c_custkey % 3 when 0 then c_name || ' MP' when 1 then 'House of Parliament' end as named_office_or_mp,
      case when c_custkey % 3 = 2 then 'politics_public_affairs' else 'parliamentary_office' end as organisation_type,
      date '2026-02-03' as published_date, date '2026-03-10' as deadline from customer""",
)
def extract_office_cards(spark, d):
    """Cards of item properties; members and parliament become offices."""
    raw = extract.extract_cards(*w4mp(spark, d), {"w4mp": extract.CARD_SPECS["w4mp"]})
    return raw.select(
        "source_identifier", "title", "employer", "source_url", "location", "salary", "paid", "named_office_or_mp", "organisation_type", "published_date", "deadline"
    )


def legalcheek(spark, d):
    rows = _numbered(spark, d, "customer", "c_custkey", "lc", "c_mktsegment")
    link = _case(2, _cat('class="card-job__link" href="/job/', _n(), '/x"'), _cat('href="/lead/', _n(), '" class="card-job__link"'))
    card = _cat(
        '<div class="card card-job"><div><div><a ', link, '>Go</a><h1 class="card-job__heading">Seat ', _n(), '</h1><h2 class="card-job__recruiter">',
        F.when(C("at") % 11 == 0, "").otherwise(_cat(C("c_name"), " &amp; Co")), '</h2><p class="card-job__location">', _case(3, "Leeds", "York", ""), "</p></div></div></div>",
    )
    return _inputs(spark, d, "legalcheek", rows.withColumn("rec", card), _page("<h1>Noticeboard</h1>", ""))


@query(
    "extract_noticeboard",
    """select case when c_custkey % 2 = 0 then cast(c_custkey as varchar) else '/lead/' || c_custkey end as source_identifier, 'Seat ' || c_custkey as title,
      c_name || ' & Co' as employer, case c_custkey % 3 when 0 then 'Leeds' when 1 then 'York' else 'Unknown' end as location,
      'https://lc-' || lower(c_mktsegment) || '.example.com' || case when c_custkey % 2 = 0 then '/job/' || c_custkey || '/x' else '/lead/' || c_custkey end as source_url
    from customer where c_custkey % 11 <> 0""",
)
def extract_noticeboard(spark, d):
    """Noticeboard cards with the link's attributes in either order; cards without an employer are left out."""
    raw = extract.extract_cards(*legalcheek(spark, d), {"legalcheek": extract.CARD_SPECS["legalcheek"]})
    return raw.select("source_identifier", "title", "employer", "location", "source_url")


def curated(spark, d):
    rows = _numbered(spark, d, "supplier", "s_suppkey", "hand", F.lit("x"))
    rec = F.struct(
        _cat("h", _n()).alias("source_identifier"), C("s_name").alias("title"), C("s_name").alias("employer"), _cat("https://h.example.com/", _n()).alias("source_url"),
        _case(2, "given", None).alias("source_type"), _case(3, "hybrid", None, None).alias("location_type"), F.array(F.lit("a"), C("s_nationkey").cast("string")).alias("secondary_tags"),
        F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (C("at") % 90).cast("int")), "yyyy-MM-dd").alias("deadline"), (C("at") % 4 == 0).alias("paid"),
    )
    return _inputs(spark, d, "curated_yaml", rows.withColumn("rec", F.to_json(rec)), _page('{"roles":[', "]}", ","))


@query(
    "extract_curated",
    """select 'hand-x' as source_id, 'h' || s_suppkey as source_identifier, s_name as title, 'https://h.example.com/' || s_suppkey as source_url,
      case when s_suppkey % 2 = 0 then 'given' else 'curated_yaml' end as source_type, case when s_suppkey % 3 = 0 then 'hybrid' else 'unknown' end as location_type,
      'a|' || s_nationkey as tags, date '2026-01-01' + cast(s_suppkey % 90 as integer) as deadline, s_suppkey % 4 = 0 as paid from supplier""",
)
def extract_curated(spark, d):
    """Rows written by hand in the raw schema."""
    raw = extract.extract_curated(*curated(spark, d))
    tags = F.array_join("secondary_tags", "|").alias("tags")
    return raw.select("source_id", "source_identifier", "title", "source_url", "source_type", "location_type", tags, "deadline", "paid")


@query(
    "extract_all_kinds",
    """select 'workday' as source_type, 'rows' as result, count(*) as n from orders
    union all select case when p_size % 2 = 0 then 'government_portal' else 'trusted_board' end, 'rows', count(*) from part group by p_size % 2
    union all select unnest(['charityjob', 'nhs_jobs', 'w4mp']), 'rows', count(*) from customer
    union all select 'legalcheek', 'rows', count(*) from customer where c_custkey % 11 <> 0
    union all select 'jobs_ac_uk', 'rows', count(*) from part union all select 'targetjobs', 'rows', count(*) from documents
    union all select 'given', 'rows', count(*) from supplier where s_suppkey % 2 = 0 union all select 'curated_yaml', 'rows', count(*) from supplier where s_suppkey % 2 = 1
    union all select 'carrier_pigeon', 'Unsupported kind: carrier_pigeon', count(distinct c_mktsegment) from customer""",
)
def extract_all_kinds(spark, d):
    """One job over payloads of many kinds; sources of an unknown kind fail and give no row."""
    pages, registry = workday(spark, d)
    for made in (boards, charityjob, nhs, academic, targetjobs, w4mp, legalcheek, curated):
        part, dim = made(spark, d)
        pages, registry = pages.unionByName(part), registry.unionByName(dim)
    lost = _numbered(spark, d, "customer", "c_custkey", "pigeon", "c_mktsegment").withColumn("rec", _n())
    part, dim = _inputs(spark, d, "carrier_pigeon", lost, _page("", ""))
    # Every kind reads the pages and the registry: stored, they are made once and the registry has its real, small size.
    pages, registry = cut(pages.unionByName(part), "pages"), cut(registry.unionByName(dim), "registry")
    raw = extract.extract_all(pages, registry)
    raw = cut(raw.groupBy("source_type", "source_id", "page_no").agg(F.count(F.lit(1)).alias("n")), "counted")
    failed = extract.structure_failures(pages, raw, registry).join(registry.select(C("id").alias("source_id"), C("ats_type").alias("source_type")), "source_id")
    rows = raw.groupBy("source_type").agg(F.sum("n").alias("n")).select("source_type", F.lit("rows").alias("result"), "n")
    return rows.unionByName(failed.groupBy("source_type", C("message").alias("result")).agg(F.count(F.lit(1)).alias("n")))
