"""Extraction and state queries. Payloads are built by Spark from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright import schema
from listwright.operators.health import failed_health
from listwright.queries.base import query, s_html, table
from listwright.queries.tables import now, schema_fields
from listwright.session import new_path
from listwright.sources import extract
from listwright.sources.payloads import build_raw, quarantined
from listwright.sources.state import current_versions, read_state, write_state

C = F.col
PER_PAGE = 64


def _registry(spark, d, kind, sources, **given):
    """One source row per distinct value of a column; every field has a default."""
    ident = C("id")
    cols = {
        "id": ident, "canonical_name": F.concat(F.lit("Name "), ident), "organisation_type": F.lit("corporate"),
        "endpoint": F.concat(F.lit("https://"), ident, F.lit(".example.com/api/jobs")), "ats_type": F.lit(kind),
        "source_authority": F.lit("official_ats"), "enabled": F.lit(True), "monitor_only": F.lit(False),
        "manual_review_required": F.lit(False), "source_ord": F.lit(1), **given,
    }
    return sources.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_fields(schema.REGISTRY)])


def _payloads(df, body):
    """Pages of at most ``PER_PAGE`` records: ``df`` has ``id``, ``at`` (a number) and ``rec``."""
    pages = df.groupBy(C("id").alias("source_id"), F.floor(C("at") / PER_PAGE).cast("int").alias("page_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "rec"))), lambda x: x["rec"]).alias("recs")
    )
    return pages.select(
        "source_id", F.lit("s1").alias("scan_id"), "page_no", F.lit(None).cast("string").alias("query"), F.lit("x").alias("content_type"),
        F.encode(body(C("recs")), "UTF-8").alias("payload"), now().alias("fetched_at"),
    )


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", C("source").alias("id"), C("doc_id").alias("at"))


def _in(kind, df):
    """Rows of one kind: documents are dealt to six kinds by number, each with sources of its own."""
    i = ("greenhouse", "lever", "ashby", "smartrecruiters", "teamtailor", "generic_json").index(kind)
    return df.filter(C("doc_id") % 6 == i).withColumn("id", F.concat(F.lit(f"{kind}-"), "id"))


def _json_inputs(spark, d):
    docs = _documents(spark, d)
    n, day = C("doc_id").cast("string"), F.date_add(F.lit("2026-01-01").cast("date"), (C("doc_id") % 50).cast("int"))
    iso, link = day.cast("string"), F.concat(F.lit("/j/"), n)
    title, body = F.concat(F.lit("T "), n), F.concat(F.lit("<p>"), C("text"), F.lit("</p>"))
    s = lambda **k: F.struct(*[v.alias(a) for a, v in k.items()])
    shapes = {
        "greenhouse": s(id=C("doc_id"), title=title, absolute_url=link, location=s(name=C("lang")), content=body, published_at=iso),
        "lever": s(id=n, text=title, hostedUrl=F.lit(""), applyUrl=link, categories=s(location=C("lang")), descriptionPlain=F.lit(""),
                   description=body, createdAt=F.unix_timestamp(day.cast("timestamp")) * 1000),
        "ashby": s(jobUrl=link, id=n, title=title, location=C("lang"), descriptionHtml=body, publishedAt=iso),
        "smartrecruiters": s(id=n, name=title, ref=link, location=s(city=C("lang"), country=F.lit("")), releasedDate=iso,
                             jobAd=s(sections=s(jobDescription=s(text=body)))),
        "teamtailor": F.struct(n.alias("id"), F.struct(title.alias("title"), C("lang").alias("location"), body.alias("body"),
                               iso.alias("created-at")).alias("attributes"), s(self=link).alias("links")),
        "generic_json": s(id=n, title=title, url=link, location=C("lang"), description=body, published_date=iso, paid=C("doc_id") % 4 == 0),
    }
    wraps = {"greenhouse": "jobs", "lever": None, "ashby": "jobs", "smartrecruiters": "content", "teamtailor": "data", "generic_json": "jobs"}
    pages, registry = None, None
    for kind, rec in shapes.items():
        rows = _in(kind, docs).withColumn("rec", F.to_json(rec))
        listed = lambda r: F.concat(F.lit("["), F.array_join(r, ","), F.lit("]"))
        key = wraps[kind]
        body_of = listed if key is None else (lambda r, k=key: F.concat(F.lit('{"' + k + '":['), F.array_join(r, ","), F.lit("]}")))
        part, dim = _payloads(rows, body_of), _registry(spark, d, kind, rows.select("id").distinct())
        pages = part if pages is None else pages.unionByName(part)
        registry = dim if registry is None else registry.unionByName(dim)
    return pages, registry


S_KIND = "['greenhouse', 'lever', 'ashby', 'smartrecruiters', 'teamtailor', 'generic_json'][doc_id % 6 + 1]"


@query(
    "extract_json_kinds",
    f"""select {S_KIND} || '-' || source as source_id, cast(doc_id as varchar) as source_identifier, {S_KIND} as source_type, 'T ' || doc_id as title,
      'https://' || {S_KIND} || '-' || source || '.example.com/j/' || doc_id as source_url, lang as location,
      md5({s_html("text")}) as h, date '2026-01-01' + cast(doc_id % 50 as integer) as published_date,
      case when doc_id % 6 = 5 then doc_id % 4 = 0 end as paid from documents""",
)
def extract_json_kinds(spark, d):
    """Six JSON formats decoded, exploded and mapped by their specs."""
    raw = extract.extract_json(*_json_inputs(spark, d), {k: v for k, v in extract.JSON_SPECS.items() if k not in ("targetjobs", "adzuna", "reed", "workday")})
    return raw.select("source_id", "source_identifier", "source_type", "title", "source_url", "location", F.md5("description").alias("h"), "published_date", "paid")


@query(
    "extract_search_apis",
    """select cast(o_orderkey as varchar) as source_identifier, case when o_orderkey % 2 = 0 then 'adzuna' else 'reed' end as source_type,
      case when o_orderkey % 2 = 0 then '£' else 'EUR ' end || format('{:,}', cast(round_even(o_totalprice, 0) as bigint)) as salary,
      case when o_orderkey % 2 = 0 then o_orderpriority || '. full_time contract' else o_orderpriority end as description,
      cast(o_orderdate as date) as published_date, 'discovery_only_source' as source_authority,
      case when o_orderkey % 2 = 0 then 'https://a.example.com/' || o_orderkey else 'https://www.reed.co.uk/jobs/' || o_orderkey end as source_url
    from orders""",
)
def extract_search_apis(spark, d):
    o = table(spark, d, "orders").withColumn("at", C("o_orderkey"))
    s = lambda **k: F.to_json(F.struct(*[v.alias(a) for a, v in k.items()]))
    n = C("o_orderkey").cast("string")
    first = o.filter("o_orderkey % 2 = 0").select(F.concat(F.lit("a"), "o_orderstatus").alias("id"), "at", s(
        id=n, title=F.lit("T"), redirect_url=F.concat(F.lit("https://a.example.com/"), n), description=C("o_orderpriority"),
        contract_time=F.lit("full_time"), contract_type=F.lit("contract"), salary_min=C("o_totalprice"), created=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    ).alias("rec"))
    second = o.filter("o_orderkey % 2 = 1").select(F.concat(F.lit("r"), "o_orderstatus").alias("id"), "at", s(
        jobId=C("o_orderkey"), jobTitle=F.lit("T"), jobUrl=F.lit(""), jobDescription=C("o_orderpriority"), minimumSalary=C("o_totalprice"),
        maximumSalary=C("o_totalprice"), currency=F.lit("eur"), date=F.date_format("o_orderdate", "yyyy-MM-dd"),
    ).alias("rec"))
    wrap = lambda r: F.concat(F.lit('{"results":['), F.array_join(r, ","), F.lit("]}"))
    pages = _payloads(first, wrap).unionByName(_payloads(second, wrap))
    registry = _registry(spark, d, "adzuna", first.select("id").distinct()).unionByName(_registry(spark, d, "reed", second.select("id").distinct()))
    raw = extract.extract_json(pages, registry, {k: extract.JSON_SPECS[k] for k in ("adzuna", "reed")})
    return raw.select("source_identifier", "source_type", "salary", "description", "published_date", "source_authority", "source_url")


def _attribute_inputs(spark, d, broken=False):
    p = table(spark, d, "part")
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), c, F.lit('"'))
    tag = F.concat(
        F.lit("<div"), attr("data-job-id", C("p_partkey").cast("string")), attr("data-title", F.concat("p_name", F.lit(" R&amp;D"))),
        attr("data-url", F.concat(F.lit("/p/"), C("p_partkey").cast("string"))), attr("data-paid", F.when(C("p_size") % 2 == 0, "TRUE").otherwise("false")),
        attr("data-deadline", F.lit("3rd March 2026")), attr("data-nationality-requirements", F.lit("British | Irish||")), F.lit(">x</div>"),
    )
    rows = p.select(C("p_brand").alias("id"), C("p_partkey").alias("at"), tag.alias("rec"))
    rows = rows.withColumn("id", F.regexp_replace("id", "#", "-"))
    pages = _payloads(rows, lambda r: F.concat(F.lit("<html>"), F.array_join(r, "\n"), F.lit("</html>")))
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    if broken:
        pages = pages.withColumn("payload", F.when(F.regexp_extract("source_id", r"(\d+)$", 1).cast("int") % 5 == 0, F.encode(F.lit('<i data-job=1>'), "UTF-8")).otherwise(C("payload")))
    return pages, _registry(spark, d, "html", rows.select("id").distinct(), monitor_only=n % 4 == 0)


@query(
    "extract_data_attributes",
    """select cast(p_partkey as varchar) as source_identifier, p_name || ' R&D' as title,
      'https://' || replace(p_brand, '#', '-') || '.example.com/p/' || p_partkey as source_url, p_size % 2 = 0 as paid, date '2026-03-03' as deadline,
      'British|Irish' as nations from part where cast(substr(p_brand, 7) as integer) % 4 <> 0""",
)
def extract_data_attributes(spark, d):
    """Listing tags in pages; watched sources give none."""
    raw = extract.extract_data_attributes(*_attribute_inputs(spark, d), kinds=["html"])
    return raw.select("source_identifier", "title", "source_url", "paid", "deadline", F.array_join("nationality_requirements", "|").alias("nations"))


@query(
    "structure_failures",
    """select distinct replace(p_brand, '#', '-') as source_id, 'failed' as status, false as parser_ok from part
      where cast(substr(p_brand, 7) as integer) % 5 = 0 and cast(substr(p_brand, 7) as integer) % 4 <> 0""",
)
def structure_failures(spark, d):
    """Pages that show record markers but yield no record fail their source."""
    pages, registry = _attribute_inputs(spark, d, broken=True)
    raw = extract.extract_data_attributes(pages, registry, kinds=["html"])
    failures = extract.structure_failures(pages, raw, registry)
    return failed_health(failures, now(), C("message")).select("source_id", "status", "parser_ok")


@query(
    "extract_cards",
    """select cast(c_custkey as varchar) as source_identifier, 'Employer ' || c_name as employer, 'T' || c_custkey || ' & co' as title,
      'https://' || c_mktsegment || '.example.com/api/o-' || c_custkey as source_url, case when c_custkey % 3 = 0 then '£20' when c_custkey % 3 = 1 then 'Unpaid' end as salary,
      case when c_custkey % 3 = 0 then true when c_custkey % 3 = 1 then false end as paid, 'hybrid' as location_type from customer""",
)
def extract_cards(spark, d):
    """Result cards cut from pages by a block pattern, one pattern per field."""
    n = C("c_custkey").cast("string")
    pay = F.when(C("c_custkey") % 3 == 0, "<li>£20</li>").when(C("c_custkey") % 3 == 1, "<li> Unpaid </li>").otherwise("")
    card = F.concat(
        F.lit('<li><div class="card-secondary"><div class="card-secondary-kicker">Job</div><h3 class="card-secondary-title">T'), n, F.lit(" &amp; co</h3>"),
        F.lit('<ul class="card-secondary-meta"><li>Employer <b>'), "c_name", F.lit("</b></li><li>London (hybrid)</li>"), pay,
        F.lit('</ul><a href="o-'), n, F.lit('" class="card-secondary-action">Go</a></div></li>'),
    )
    rows = table(spark, d, "customer").select(C("c_mktsegment").alias("id"), C("c_custkey").alias("at"), card.alias("rec"))
    pages = _payloads(rows, lambda r: F.concat(F.lit("<ul>"), F.array_join(r, "\n"), F.lit("</ul>")))
    raw = extract.extract_cards(pages, _registry(spark, d, "prospects", rows.select("id").distinct()), {"prospects": extract.CARD_SPECS["prospects"]})
    return raw.select("source_identifier", "employer", "title", "source_url", "salary", "paid", "location_type")


@query(
    "extract_nested_cards",
    """select cast(s_suppkey as varchar) as source_identifier, s_name || ' - North' as employer, 'Leeds' as location, 'Role ' || s_suppkey as title,
      '£' || s_nationkey || ' a year' as salary, true as paid, 'hybrid' as location_type, date '2026-02-03' as published_date,
      'Write to [contact email on source]. Hybrid remote' as description from supplier""",
)
def extract_nested_cards(spark, d):
    """Cards with nested blocks, read by an HTML parser in Arrow batches."""
    n = C("s_suppkey").cast("string")
    card = F.concat(
        F.lit('<div data-testid="searchResultCard-'), n, F.lit('"><div><h3><a data-testid="jobTitle-'), n, F.lit('" href="/job/'), n, F.lit('">Role '), n,
        F.lit('</a></h3></div><span data-testid="searchResultCardEmployer">'), "s_name", F.lit(" - North - Leeds</span>"),
        F.lit('<div data-testid="searchResultsCardTags">Hybrid remote</div><p class="font-weight-bold">£'), C("s_nationkey").cast("string"),
        F.lit(' a year</p><div data-testid="searchResultCardJobDescription">Write to me@x.example.com</div><p>Added on 3 February 2026</p></div>'),
    )
    rows = table(spark, d, "supplier").select(F.lit("hub").alias("id"), C("s_suppkey").alias("at"), card.alias("rec"))
    pages = _payloads(rows, lambda r: F.concat(F.lit("<html>"), F.array_join(r, "\n"), F.lit("</html>")))
    raw = extract.extract_nested_cards(pages, _registry(spark, d, "work_hub", rows.select("id").distinct()))
    return raw.select("source_identifier", "employer", "location", "title", "salary", "paid", "location_type", "published_date", "description")


@query(
    "extract_embedded_json",
    """select cast(c_custkey as varchar) as source_identifier, trim(c_name) as employer, 'Job. 2nd years' as description, 'Relevant for: 2nd years' as eligibility_text,
      case when c_custkey % 2 = 0 then false end as paid from customer""",
)
def extract_embedded_json(spark, d):
    """A JSON state object inside each page."""
    rec = F.to_json(F.struct(
        C("c_custkey").alias("jobId"), F.lit("T").alias("jobTitle"), F.lit("/x").alias("url"), F.concat(F.lit(" "), "c_name").alias("companyName"),
        F.lit("2nd years").alias("relevantFor"), F.lit("Job").alias("jobTypeName"), F.when(C("c_custkey") % 2 == 0, "UNPAID trial").otherwise("Paid").alias("salary"),
    ))
    rows = table(spark, d, "customer").select(C("c_mktsegment").alias("id"), C("c_custkey").alias("at"), rec.alias("rec"))
    pages = _payloads(rows, lambda r: F.concat(
        F.lit('<script>window.__RMP_SEARCH_RESULTS_INITIAL_STATE__ = {"meta":{},"data":['), F.array_join(r, ","), F.lit("]};</script>")))
    raw = extract.extract_embedded_json(pages, _registry(spark, d, "higherin", rows.select("id").distinct()))
    return raw.select("source_identifier", "employer", "description", "eligibility_text", "paid")


@query(
    "extract_feed",
    """select 'g' || s_suppkey as source_identifier, 'S & ' || s_name as title, case when s_suppkey % 2 = 0 then 'Unknown' else 'Leeds' end as location,
      'a b' as description, date '2026-02-03' as published_date, 'https://f' || s_suppkey % 2 || '.example.com/i/' || s_suppkey as source_url from supplier""",
)
def extract_feed(spark, d):
    """RSS items and Atom entries."""
    n, even = C("s_suppkey").cast("string"), C("s_suppkey") % 2 == 0
    title = F.concat(F.lit("<title>S &amp; "), "s_name", F.lit("</title>"))
    item = F.concat(
        F.lit("<item><guid>g"), n, F.lit("</guid>"), title, F.lit("<link>/i/"), n,
        F.lit("</link><description>&lt;p&gt;a&lt;/p&gt; <![CDATA[ ]]>b</description><pubDate>3 February 2026</pubDate></item>"),
    )
    entry = F.concat(
        F.lit("<entry><id>g"), n, F.lit("</id>"), title, F.lit('<link rel="alternate" href="/i/'), n,
        F.lit('"/><x:location>Leeds</x:location><summary>a <![CDATA[]]> b</summary><updated>2026-02-03T00:00:00Z</updated></entry>'),
    )
    rows = table(spark, d, "supplier").select(F.when(even, "f0").otherwise("f1").alias("id"), C("s_suppkey").alias("at"), F.when(even, item).otherwise(entry).alias("rec"))
    pages = _payloads(rows, lambda r: F.concat(F.lit("<feed>"), F.array_join(r, "\n"), F.lit("</feed>")))
    raw = extract.extract_feed(pages, _registry(spark, d, "feed", rows.select("id").distinct()))
    plain = F.regexp_replace(F.regexp_replace("description", r"<!\[CDATA\[\s*\]\]>|</?p>|\]\]>", " "), r"\s+", " ")
    return raw.select("source_identifier", "title", "location", F.trim(plain).alias("description"), "published_date", "source_url")


@query(
    "detail_enrichment",
    """select c_mktsegment as source_id, 'R' || c_custkey as source_identifier, case when c_custkey % 2 = 0 then 'New ' || c_name else 'Old' end as title,
      case when c_custkey % 3 = 0 then 'hybrid' else 'unknown' end as location_type, c_custkey % 5 = 0 as explicitly_closed, date '2026-02-03' as published_date
    from customer where c_mktsegment <> 'MACHINERY'""",
)
def detail_enrichment(spark, d):
    """Second payload per listing; a source with one unreadable detail drops out whole."""
    cust = table(spark, d, "customer").select("c_custkey", "c_name", C("c_mktsegment").alias("id"))
    extracted = cust.join(_registry(spark, d, "workday", cust.select("id").distinct()).select("id", F.struct(*[f.name for f in schema_fields(schema.REGISTRY)]).alias("src")), "id")
    n = C("c_custkey")
    raw = build_raw(extracted.select(
        "src", F.lit("workday").alias("kind"), F.concat(F.lit("/job/"), n.cast("string")).alias("source_identifier"), F.lit("Old").alias("title"),
        F.lit("/old").alias("url"), F.lit("2026-02-03").cast("date").alias("published_date"),
    ))
    info = F.struct(
        F.when(n % 2 == 0, F.concat(F.lit("New "), "c_name")).otherwise("").alias("title"), F.concat(F.lit("R"), n.cast("string")).alias("jobReqId"),
        F.when(n % 3 == 0, "Hybrid").alias("remoteType"), (n % 5 != 0).alias("canApply"),
    )
    # The first customer of one segment has a detail page that is not JSON.
    bad = cust.filter("id = 'MACHINERY'").agg(F.min("c_custkey").alias("bad"))
    details = cust.crossJoin(F.broadcast(bad)).select(
        C("id").alias("source_id"), F.concat(F.lit("/job/"), n.cast("string")).alias("source_identifier"),
        F.when(n == C("bad"), "<html>").otherwise(F.to_json(F.struct(info.alias("jobPostingInfo")))).alias("body"),
    )
    return extract.enrich_detail(raw, details).select("source_id", "source_identifier", "title", "location_type", "explicitly_closed", "published_date")


@query(
    "payload_scan",
    "select page_id, sha256(html) as content_hash, length(html) as chars from pages",
)
def payload_scan(spark, d):
    from listwright.sources.payloads import with_text

    pages = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("payload"))
    return with_text(pages).select("page_id", C("payload_hash").alias("content_hash"), F.length("body").alias("chars"))


@query(
    "raw_builder",
    """select page_id, url as source_url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/apply/' || page_id as application_url, false as lost from pages
    where page_id % 10 <> 0 union all select page_id, null, null, true from pages where page_id % 10 = 0""",
)
def raw_builder(spark, d):
    """Defaults and absolute links from the source; rows without a web link are set apart."""
    p = table(spark, d, "pages")
    given = {f.name: F.lit(None).cast(f.dataType) for f in schema_fields(schema.REGISTRY)}
    link = F.when(C("page_id") % 10 == 0, F.concat(F.lit("mailto:x"), C("page_id").cast("string"))).otherwise(C("url"))
    src = F.struct(*[(C("url") if k == "endpoint" else v).alias(k) for k, v in given.items()])
    extracted = p.select(
        src.alias("src"), F.lit("html").alias("kind"), C("page_id").cast("string").alias("source_identifier"), link.alias("url"),
        F.concat(F.lit("/apply/"), C("page_id").cast("string")).alias("application_url"),
    )
    kept = build_raw(extracted).select(C("source_identifier").cast("bigint").alias("page_id"), "source_url", "application_url", F.lit(False).alias("lost"))
    none = F.lit(None).cast("string")
    lost = quarantined(extracted).select(C("source_identifier").cast("bigint").alias("page_id"), none.alias("source_url"), none.alias("application_url"), F.lit(True).alias("lost"))
    return kept.unionByName(lost)


@query(
    "state_roundtrip",
    """select 'first' as step, true as written, count(*) as rows from customer union all select 'same', false, count(*) from customer
    union all select 'changed', true, count(*) from customer where c_custkey % 2 = 0""",
)
def state_roundtrip(spark, d):
    """Write, write the same again, write a change: only real changes make a version."""
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    root, ddl, out = new_path(spark, "state"), "c_custkey BIGINT, c_name STRING", []
    assert current_versions(spark, root) == (-1, {})
    for step, rows in (("first", df), ("same", df.orderBy(F.desc("c_custkey"))), ("changed", df.filter("c_custkey % 2 = 0"))):
        written = write_state(rows, root, "t", step)
        out.append(
            read_state(spark, root, "t", ddl).agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(step).alias("step"), F.lit(written).alias("written"), "rows"
            )
        )
    return out[0].unionByName(out[1]).unionByName(out[2])
