"""Extraction specs: one entry per payload kind, fields as SQL over the record ``j``.

Fixed values: record paths, field names and page patterns belong to the payload formats.
"""

from __future__ import annotations

from dataclasses import dataclass, field

DISCOVERY = "'discovery_only_source'"


@dataclass(frozen=True)
class JsonSpec:
    """``rows`` names the record list; '' reads a bare list; each field is (cleaner, SQL)."""

    schema: str
    rows: str
    fields: dict[str, tuple[str, str]]
    keep: str = "true"
    bare_list: bool = False
    counter: str | None = None
    counter_schema: str | None = None


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ")"


GREENHOUSE = JsonSpec(
    schema="id STRING, title STRING, absolute_url STRING, location STRUCT<name:STRING>, published_at STRING, "
    "first_published STRING, content STRING",
    rows="jobs",
    fields={
        "source_identifier": ("raw", "j.id"),
        "title": ("raw", "j.title"),
        "url": ("raw", "j.absolute_url"),
        "location": ("raw", "j.location.name"),
        "description": ("html", "j.content"),
        "published_date": ("date", _first("j.published_at", "j.first_published")),
    },
)

LEVER = JsonSpec(
    schema="id STRING, text STRING, hostedUrl STRING, applyUrl STRING, categories STRUCT<location:STRING>, "
    "descriptionPlain STRING, description STRING, createdAt STRING",
    rows="",
    bare_list=True,
    fields={
        "source_identifier": ("raw", "j.id"),
        "title": ("raw", "j.text"),
        "url": ("raw", _first("j.hostedUrl", "j.applyUrl")),
        "location": ("raw", "j.categories.location"),
        "description": ("html", _first("j.descriptionPlain", "j.description")),
        "published_date": ("moment", "j.createdAt"),
    },
)

ASHBY = JsonSpec(
    schema="id STRING, title STRING, jobUrl STRING, location STRING, descriptionHtml STRING, "
    "descriptionPlain STRING, publishedAt STRING",
    rows="jobs",
    fields={
        "source_identifier": ("raw", _first("j.id", "j.jobUrl")),
        "title": ("raw", "j.title"),
        "url": ("raw", "j.jobUrl"),
        "location": ("raw", "j.location"),
        "description": ("html", _first("j.descriptionHtml", "j.descriptionPlain")),
        "published_date": ("date", "j.publishedAt"),
    },
)

SMARTRECRUITERS = JsonSpec(
    schema="id STRING, name STRING, ref STRING, applyUrl STRING, location STRUCT<city:STRING,country:STRING>, "
    "releasedDate STRING, jobAd STRUCT<sections:STRUCT<jobDescription:STRUCT<text:STRING>>>",
    rows="content",
    fields={
        "source_identifier": ("raw", "j.id"),
        "title": ("raw", "j.name"),
        "url": ("raw", _first("j.ref", "j.applyUrl")),
        "location": ("raw", "concat_ws(', ', nullif(j.location.city, ''), nullif(j.location.country, ''))"),
        "description": ("html", "j.jobAd.sections.jobDescription.text"),
        "published_date": ("date", "j.releasedDate"),
    },
)

WORKDAY = JsonSpec(
    schema="id STRING, title STRING, externalPath STRING, locationsText STRING, postedOn STRING, description STRING",
    rows="jobPostings",
    fields={
        "source_identifier": ("raw", _first("j.externalPath", "j.id", "j.title")),
        "title": ("raw", "j.title"),
        "url": (
            "raw",
            "concat(regexp_replace(" + _first("src.careers_url", "src.endpoint", "''")
            + ", '/+$', ''), '/', regexp_replace(j.externalPath, '^/+', ''))",
        ),
        "location": ("raw", "j.locationsText"),
        "description": ("html", "j.description"),
        "published_date": ("date", "j.postedOn"),
    },
)

TEAMTAILOR = JsonSpec(
    schema="id STRING, attributes STRUCT<title:STRING,url:STRING,location:STRING,body:STRING,`created-at`:STRING>, "
    "links STRUCT<self:STRING>",
    rows="data",
    fields={
        "source_identifier": ("raw", "j.id"),
        "title": ("raw", "j.attributes.title"),
        "url": ("raw", "coalesce(nullif(j.attributes.url, ''), nullif(j.links.self, ''), concat('jobs/', j.id))"),
        "location": ("raw", "j.attributes.location"),
        "description": ("html", "j.attributes.body"),
        "published_date": ("date", "j.attributes.`created-at`"),
    },
)

_PLAIN = ("salary", "paid_evidence", "division", "application_method", "date_provenance", "cycle_provenance")
_DATES = ("published_date", "deadline", "opening_date", "programme_start", "programme_end")
_LISTS = ("secondary_tags", "nationality_requirements", "residency_requirements", "clearance_requirements")

GENERIC = JsonSpec(
    schema="id STRING, title STRING, url STRING, application_url STRING, location STRING, description STRING, "
    + ", ".join(f"{n} STRING" for n in (*_PLAIN, *_DATES))
    + ", eligibility STRING, cycle STRING, category STRING, paid BOOLEAN, explicitly_closed BOOLEAN, "
    + ", ".join(f"{n} ARRAY<STRING>" for n in _LISTS),
    rows="jobs",
    bare_list=True,
    fields={
        "source_identifier": ("raw", _first("j.id", "j.url")),
        "title": ("raw", "j.title"),
        "url": ("raw", _first("j.url", "j.application_url")),
        "application_url": ("raw", "nullif(j.application_url, '')"),
        "location": ("raw", "j.location"),
        "description": ("html", "j.description"),
        "eligibility_text": ("raw", "j.eligibility"),
        "cycle_hint": ("raw", "j.cycle"),
        "category_hint": ("raw", "j.category"),
        "paid": ("raw", "j.paid"),
        "explicitly_closed": ("raw", "j.explicitly_closed"),
        **{n: ("raw", f"j.{n}") for n in (*_PLAIN, *_LISTS)},
        **{n: ("date", f"j.{n}") for n in _DATES},
    },
)

TARGETJOBS = JsonSpec(
    schema="type STRING, title STRING, path STRING, url STRING, uuid STRING, nid STRING, externalId STRING, "
    "body STRING, abstract STRING, location STRING, applicationUrl STRING, applicationOpen BOOLEAN, "
    "applicationDeadline STRING, opportunityStartDate STRING, degreeRequirements STRING, "
    "organisation STRUCT<title:STRING>, parentOrganisationTitle STRING, organisationName STRING, "
    "sourceOrganisationName STRING, salary STRUCT<currency:STRING,lower:STRING,upper:STRING>",
    rows="search.documents",
    counter="search.result_count",
    counter_schema="search STRUCT<result_count:BIGINT>",
    keep="title <> '' and link <> '' and source_identifier <> ''",
    fields={
        "source_identifier": ("raw", "coalesce(nullif(j.uuid, ''), nullif(j.nid, ''), nullif(j.externalId, ''), '')"),
        "title": ("html", "j.title"),
        "link": ("raw", "coalesce(nullif(j.path, ''), nullif(j.url, ''), '')"),
        "apply_link": ("raw", "nullif(j.applicationUrl, '')"),
        "location": ("html", "coalesce(nullif(j.location, ''), 'London')"),
        "description": ("html", "coalesce(nullif(j.body, ''), nullif(j.abstract, ''), '')"),
        "deadline": ("date", "j.applicationDeadline"),
        "programme_start": ("date", "j.opportunityStartDate"),
        "degrees": ("raw", "j.degreeRequirements"),
        "salary_parts": ("raw", "j.salary"),
        "explicitly_closed": ("raw", "not coalesce(j.applicationOpen, true)"),
        "name_1": ("raw", "j.organisation.title"),
        "name_2": ("raw", "j.parentOrganisationTitle"),
        "name_3": ("raw", "j.organisationName"),
        "name_4": ("raw", "j.sourceOrganisationName"),
        "source_authority": ("raw", DISCOVERY),
        "organisation_type": ("raw", "'corporate'"),
    },
)

ADZUNA = JsonSpec(
    schema="id STRING, title STRING, description STRING, created STRING, redirect_url STRING, contract_time STRING, "
    "contract_type STRING, location STRUCT<display_name:STRING>, company STRUCT<display_name:STRING>, "
    "salary_min STRING, salary_max STRING",
    rows="results",
    counter="count",
    counter_schema="count BIGINT",
    keep="title <> '' and url <> '' and source_identifier <> ''",
    fields={
        "source_identifier": ("raw", "trim(coalesce(nullif(j.id, ''), j.redirect_url, ''))"),
        "title": ("html", "j.title"),
        "url": ("raw", "trim(coalesce(j.redirect_url, ''))"),
        "employer": ("raw", "coalesce(nullif(j.company.display_name, ''), 'Employer not stated')"),
        "location": ("raw", "coalesce(nullif(j.location.display_name, ''), 'Unknown')"),
        "body_text": ("html", "j.description"),
        "contract": ("raw", "concat_ws(' ', nullif(trim(j.contract_time), ''), nullif(trim(j.contract_type), ''))"),
        "published_date": ("date", "j.created"),
        "low": ("raw", "j.salary_min"),
        "high": ("raw", "j.salary_max"),
        "currency": ("raw", "'GBP'"),
        "source_authority": ("raw", DISCOVERY),
        "organisation_type": ("raw", "'corporate'"),
    },
)

REED = JsonSpec(
    schema="jobId STRING, employerName STRING, jobTitle STRING, locationName STRING, currency STRING, "
    "expirationDate STRING, date STRING, jobDescription STRING, jobUrl STRING, minimumSalary STRING, maximumSalary STRING",
    rows="results",
    counter="totalResults",
    counter_schema="totalResults BIGINT",
    keep="title <> '' and url <> '' and source_identifier <> ''",
    fields={
        "source_identifier": ("raw", "trim(coalesce(j.jobId, ''))"),
        "title": ("html", "j.jobTitle"),
        "url": (
            "raw",
            "case when coalesce(trim(j.jobUrl), '') = '' and coalesce(trim(j.jobId), '') <> '' "
            "then concat('https://www.reed.co.uk/jobs/', trim(j.jobId)) "
            "when startswith(trim(j.jobUrl), '/') then concat('https://www.reed.co.uk', trim(j.jobUrl)) "
            "else coalesce(trim(j.jobUrl), '') end",
        ),
        "employer": ("raw", "coalesce(nullif(j.employerName, ''), 'Employer not stated')"),
        "location": ("raw", "coalesce(nullif(j.locationName, ''), 'Unknown')"),
        "body_text": ("html", "j.jobDescription"),
        "contract": ("raw", "''"),
        "published_date": ("date", "j.date"),
        "deadline": ("date", "j.expirationDate"),
        "low": ("raw", "j.minimumSalary"),
        "high": ("raw", "j.maximumSalary"),
        "currency": ("raw", "coalesce(nullif(j.currency, ''), 'GBP')"),
        "source_authority": ("raw", DISCOVERY),
        "organisation_type": ("raw", "'corporate'"),
    },
)

HIGHERIN = JsonSpec(
    schema="jobId STRING, id STRING, jobTitle STRING, url STRING, companyName STRING, relevantFor STRING, "
    "jobTypeName STRING, salary STRING, deadline STRING, employmentStartDate STRING, "
    "jobLocationNamesTrimmed STRING, jobLocationNames STRING",
    rows="data",
    keep="title <> '' and url <> ''",
    fields={
        "source_identifier": ("raw", _first("j.jobId", "j.id", "j.url")),
        "title": ("raw", "coalesce(j.jobTitle, '')"),
        "url": ("raw", "coalesce(j.url, '')"),
        "employer": ("raw", "trim(coalesce(nullif(j.companyName, ''), 'Employer not stated'))"),
        "location": ("raw", "coalesce(nullif(j.jobLocationNamesTrimmed, ''), nullif(j.jobLocationNames, ''), 'Unknown')"),
        "description": ("raw", "concat_ws('. ', nullif(trim(j.jobTypeName), ''), nullif(trim(j.relevantFor), ''))"),
        "eligibility_text": (
            "raw", "coalesce(concat('Relevant for: ', nullif(trim(j.relevantFor), '')), '')",
        ),
        "deadline": ("date", "j.deadline"),
        "programme_start": ("date", "j.employmentStartDate"),
        "salary": ("raw", "nullif(trim(j.salary), '')"),
        "paid": ("raw", "case when contains(lower(j.salary), 'unpaid') then false end"),
        "paid_evidence": ("raw", "nullif(trim(j.salary), '')"),
        "source_authority": ("raw", DISCOVERY),
        "organisation_type": ("raw", "'corporate'"),
        "listing_publisher": ("raw", "src.canonical_name"),
    },
)

JSON_SPECS = {
    "greenhouse": GREENHOUSE,
    "lever": LEVER,
    "ashby": ASHBY,
    "smartrecruiters": SMARTRECRUITERS,
    "workday": WORKDAY,
    "teamtailor": TEAMTAILOR,
    "generic_json": GENERIC,
    "targetjobs": TARGETJOBS,
    "adzuna": ADZUNA,
    "reed": REED,
}

EMBEDDED_SPECS = {
    "higherin": (
        HIGHERIN,
        r"(?s)window\.__RMP_SEARCH_RESULTS_INITIAL_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>",
    ),
}


@dataclass(frozen=True)
class CardSpec:
    """``block`` finds one record's markup; each field is (cleaner, pattern with one group)."""

    block: str
    marker: str
    fields: dict[str, tuple[str, str]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    count_pattern: str | None = None
    group: int = 0


def class_pattern(name: str) -> str:
    return rf'(?is)<[^>]+class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</[^>]+>'


def labelled(name: str) -> str:
    return rf'(?is)data-test="{name}".*?<strong[^>]*>(.*?)</strong>'


def item_property(name: str) -> str:
    return rf'(?is)<[^>]+itemprop="{name}"[^>]*>(.*?)</[^>]+>'


_AC_TITLE = r'(?is)<a href="(/job/[^"]+)">\s*.*?\s*</a>'

CARD_SPECS = {
    "charityjob": CardSpec(
        block=r'(?is)<article[^>]+job-id="\d+"[^>]*>.*?</article>',
        marker="job-card-wrapper",
        fields={
            "source_identifier": ("raw", r'(?is)<article[^>]+job-id="(\d+)"'),
            "url": ("reference", r'(?is)<div class="job-title[^"]*">.*?<a href="([^"]+)"[^>]*>.*?</a>'),
            "title_shown": ("html", r'(?is)<div class="job-title[^"]*">.*?<a href="[^"]+"[^>]*>(.*?)</a>'),
            "logo_title": ("html", r'(?i)<a[^>]+title="([^"]+)"[^>]+class="job-card-logo"'),
            "organisation": ("html", class_pattern("organisation")),
            "salary_shown": ("html", class_pattern("job-summary-item")),
            "posted": ("html", class_pattern("posted-item")),
        },
        required=("url",),
        count_pattern=r'"total_count"\s*:\s*"?(\d+)',
    ),
    "nhs_jobs": CardSpec(
        block=r'(?is)<li class="nhsuk-list-panel search-result[^>]*data-test="search-result"[^>]*>'
        r'.*?(?=<li class="nhsuk-list-panel search-result|</ul>\s*<nav)',
        marker='data-test="search-result"',
        fields={
            "url": (
                "reference",
                r'(?is)<a href="([^"]*?/candidate/jobadvert/[^?"]+[^"]*)"[^>]*data-test="search-result-job-title"[^>]*>',
            ),
            "source_identifier": (
                "raw",
                r'(?is)<a href="[^"]*?/candidate/jobadvert/([^?"]+)[^"]*"[^>]*data-test="search-result-job-title"[^>]*>',
            ),
            "title": (
                "html",
                r'(?is)<a href="[^"]*?/candidate/jobadvert/[^"]*"[^>]*data-test="search-result-job-title"[^>]*>(.*?)</a>',
            ),
            "employer": (
                "html",
                r'(?is)data-test="search-result-location".*?<h3[^>]*>\s*(.*?)\s*<div class="location-font-size">',
            ),
            "place": (
                "html",
                r'(?is)data-test="search-result-location".*?<div class="location-font-size">\s*(.*?)\s*</div>',
            ),
            "salary": ("html", labelled("search-result-salary")),
            "contract": ("html", labelled("search-result-jobType")),
            "working": ("html", labelled("search-result-workingPattern")),
            "published": ("html", labelled("search-result-publicationDate")),
            "closes": ("html", labelled("search-result-closingDate")),
        },
        required=("url", "employer"),
        count_pattern=r"(?i)([\d,]+)\s+jobs found in London",
    ),
    "jobs_ac_uk": CardSpec(
        block=r'(?is)<div class="j-search-result__result\b.*?(?=<div class="j-search-result__result\b|\z)',
        marker="j-search-result__result",
        fields={
            "source_identifier": ("raw", r'data-advert-id="(\d+)"'),
            "url": ("reference", _AC_TITLE),
            "title": ("html", r'(?is)<a href="/job/[^"]+">\s*(.*?)\s*</a>'),
            "employer": ("html", r'(?is)class="j-search-result__employer"[^>]*>\s*<b>(.*?)</b>'),
            "location": ("html", r"(?is)</div>\s*<div>Location:\s*(.*?)\s*</div>"),
            "department": ("html", class_pattern("j-search-result__department")),
            "salary": (
                "html", r'(?is)class="j-search-result__info"[^>]*>\s*<strong>Salary:\s*</strong>(.*?)</div>',
            ),
            "placed": ("raw", r"(?i)<strong>Date Placed:\s*</strong>\s*([^<]+)"),
            "closes": ("raw", r'(?i)class="j-search-result__date--blue[^"]*">\s*([^<]+)'),
        },
        required=("source_identifier", "url", "employer", "location"),
        count_pattern=r'(?i)<strong class="job-count">\s*([\d,]+)',
    ),
    "w4mp": CardSpec(
        block=r'(?is)<article[^>]*class="[^"]*job-advert[^"]*"[^>]*>.*?</article>',
        marker="job-advert",
        fields={
            "url": ("raw", r'(?i)href="(JobDetails\.aspx\?jobid=\d+)"'),
            "source_identifier": ("raw", r'(?i)href="JobDetails\.aspx\?jobid=(\d+)"'),
            "title": ("html", item_property("title")),
            "employer": ("html", item_property("hiringOrganization")),
            "place": ("html", item_property("jobLocation")),
            "pay": ("html", item_property("baseSalary")),
            "posted": ("html", item_property("datePosted")),
            "all_text": ("html", r"(?s)^(.*)$"),
        },
        required=("url", "title", "employer"),
    ),
    "prospects": CardSpec(
        block=r'(?is)<div class="card-secondary">.*?</div>\s*</li>',
        marker="card-secondary",
        fields={
            "title": ("html", r'(?is)class="card-secondary-title"[^>]*>(.*?)</h3>'),
            "url": ("raw", r'(?i)href="([^"]+)"[^>]*class="card-secondary-action"'),
            "kind_shown": ("html", r'(?is)class="card-secondary-kicker"[^>]*>(.*?)</div>'),
            "meta": ("raw", r'(?is)class="card-secondary-meta"[^>]*>(.*?)</ul>'),
        },
        required=("title", "url", "meta"),
    ),
    "legalcheek": CardSpec(
        block=r'(?is)<div class="card card-job">.*?</div>\s*</div>\s*</div>',
        marker="card-job",
        fields={
            "url_after": ("raw", r'(?i)class="card-job__link"[^>]*href="([^"]+)"'),
            "url_before": ("raw", r'(?i)href="([^"]+)"[^>]*class="card-job__link"'),
            "title": ("html", r'(?is)class="card-job__heading"[^>]*>(.*?)</h1>'),
            "employer": ("html", r'(?is)class="card-job__recruiter"[^>]*>(.*?)</h2>'),
            "place": ("html", r'(?is)class="card-job__location"[^>]*>(.*?)</p>'),
        },
        required=("title", "employer"),
    ),
}

# Attributes of a listing tag, by the raw column they fill.
DATA_ATTRIBUTES = {
    "source_identifier": "data-job-id",
    "title": "data-title",
    "url": "data-url",
    "location": "data-location",
    "description": "data-description",
    "eligibility_text": "data-eligibility",
    "application_url": "data-application-url",
    "application_method": "data-application-method",
    "division": "data-division",
    "political_affiliation": "data-political-affiliation",
    "paid": "data-paid",
    "published_date": "data-published-date",
    "deadline": "data-deadline",
    "opening_date": "data-opening-date",
    "programme_start": "data-programme-start",
    "programme_end": "data-programme-end",
    "salary": "data-salary",
    "paid_evidence": "data-paid-evidence",
    "cycle_hint": "data-cycle",
    "nationality_requirements": "data-nationality-requirements",
    "residency_requirements": "data-residency-requirements",
    "clearance_requirements": "data-clearance-requirements",
    "explicitly_closed": "data-closed",
    "shown_employer": "data-employer",
    "shown_office": "data-office",
    "shown_publisher": "data-publisher",
}
ATTRIBUTE_KINDS = ("html", "government_portal", "trusted_board")
KINDS = (*JSON_SPECS, *EMBEDDED_SPECS, *CARD_SPECS, *ATTRIBUTE_KINDS, "feed", "work_hub", "curated_yaml")
