"""URL functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.functions.text import casefold, strip

# Query parameters that only track the visitor.
TRACKING = ("gclid", "fbclid", "ref", "source")
# Hosts whose last path part names the vacancy, and requisition parameters.
ATS_HOSTS = (
    "workdayjobs.com",
    "successfactors.",
    "greenhouse.io",
    "smartrecruiters.com",
    "teamtailor.com",
)
REQUISITION_PARAMETERS = ("career_job_req_id", "jobid", "job_id", "gh_jid")

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return casefold(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def _decode(c: Column) -> Column:
    # A stray percent sign stands for itself.
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    # url_encode leaves '*' and escapes '~'; the canonical form is the other way round.
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column) -> Column:
    """Decoded ``array<struct<name,value>>`` in order, repeats and blank values kept."""
    pieces = F.filter(F.split(query(url), "&"), lambda piece: piece != "")
    return F.transform(
        pieces,
        lambda piece: F.struct(
            _decode(F.substring_index(piece, "=", 1)).alias("name"),
            _decode(F.regexp_extract(piece, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )


def canonical_url(url: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """Lower-case scheme and host, no tracking parameters, no fragment, tidy path."""
    text = strip(url)
    kept = F.filter(
        query_pairs(text),
        lambda p: ~(F.startswith(F.lower(p["name"]), F.lit("utm_")) | F.lower(p["name"]).isin(*tracking)),
    )
    rendered = F.array_join(
        F.transform(kept, lambda p: F.concat(_encode(p["name"]), F.lit("="), _encode(p["value"]))), "&"
    )
    tidy = F.regexp_replace(F.regexp_replace(path(text), r"/{2,}", "/"), r"/+$", "")
    tidy = F.when(tidy == "", "/").otherwise(tidy)
    # Without a host the path may be relative; a host always meets an absolute path.
    site = F.lower(_part(text, 2))
    return F.concat(
        F.when(scheme(text) != "", F.concat(scheme(text), F.lit(":"))).otherwise(""),
        F.when(site != "", F.concat(F.lit("//"), site)).otherwise(""),
        tidy,
        F.when(rendered != "", F.concat(F.lit("?"), rendered)).otherwise(""),
    )


def _remove_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.slice(F.split(p, "/"), 2, 1 << 30)
    last = F.try_element_at(segments, F.lit(-1))
    stacked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda stack, seg: F.when(seg == ".", stack)
        .when(seg == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
        .otherwise(F.concat(stack, F.array(seg))),
    )
    tail = F.when(last.isin(".", "..") & (F.size(stacked) > 0), "/").otherwise("")
    return F.when(
        F.rlike(p, F.lit(r"(^|/)\.{1,2}(/|$)")),
        F.concat(F.lit("/"), F.array_join(stacked, "/"), tail),
    ).otherwise(p)


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` against ``base`` (RFC 3986 reference resolution)."""
    b, r = F.coalesce(base, F.lit("")), F.coalesce(strip(ref), F.lit(""))
    root = F.concat(scheme(b), F.lit(":"), F.when(_part(b, 2) != "", F.concat(F.lit("//"), _part(b, 2))).otherwise(""))
    base_path = F.when(path(b) == "", "/").otherwise(path(b))
    folder = F.regexp_extract(base_path, r"(?s)^(.*/)", 1)
    ref_path = path(r)
    ref_tail = F.regexp_extract(r, r"(?s)([?#].*)$", 1)
    return (
        F.when((b == "") | (scheme(r) != ""), r)
        .when(r == "", b)
        .when(F.startswith(r, F.lit("//")), F.concat(scheme(b), F.lit(":"), r))
        .when(F.startswith(ref_path, F.lit("/")), F.concat(root, _remove_dots(ref_path), ref_tail))
        .when(F.startswith(r, F.lit("?")), F.concat(root, path(b), ref_tail))
        .when(F.startswith(r, F.lit("#")), F.concat(F.substring_index(b, "#", 1), r))
        .otherwise(F.concat(root, _remove_dots(F.concat(folder, ref_path)), ref_tail))
    )


def is_web_url(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"^(?i:https?)://[^/?#]+")), F.lit(False))


def _first_value(pairs: Column, name: str) -> Column:
    named = F.filter(pairs, lambda pair: (pair["name"] == name) & (pair["value"] != ""))
    return F.try_element_at(named, F.lit(1))["value"]


def requisition_keys(url: Column) -> Column:
    """Keys that name the vacancy on the applicant system behind ``url``."""
    site = F.regexp_replace(host(url), r"^www\.", "")
    parts = F.filter(F.split(casefold(path(url)), "/"), lambda part: part != "")
    last = F.try_element_at(parts, F.lit(-1))
    on_ats = F.lit(False)
    for marker in ATS_HOSTS:
        on_ats = on_ats | F.contains(site, F.lit(marker))
    external = F.when(
        on_ats & (F.length(last) >= 6) & ~last.isin("apply", "application"),
        F.concat(F.lit("external-ats:"), site, F.lit(":"), last),
    )
    pairs = query_pairs(url)
    keys = [external]
    for name in REQUISITION_PARAMETERS:
        value = _first_value(pairs, name)
        keys.append(F.concat(F.lit("external-requisition:"), site, F.lit(f":{name}:"), value))
    return F.array_compact(F.array(*keys))
