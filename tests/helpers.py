"""Row builders and brute-force models the distributed operators are checked against."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.schema import AUTHORITY_RANK, RECORD

NOW = dt.datetime(2026, 8, 22, 12, 0, 0)


def record(**given) -> dict:
    base = {
        "id": "r",
        "canonical_employer": "Acme",
        "organisation_type": "corporate",
        "source_authority": "official_ats",
        "title": "Analyst",
        "canonical_url": "https://acme.test/1",
        "application_url": "https://acme.test/1",
        "all_source_urls": ["https://acme.test/1"],
        "source_registry_id": "s1",
        "source_type": "generic_json",
        "source_identifier": "1",
        "location": "London",
        "location_type": "onsite",
        "geographic_scope": "london",
        "programme_type": "summer_internship_2027",
        "primary_category": "Other Relevant",
        "secondary_tags": [],
        "description_excerpt": "",
        "first_seen_at": NOW,
        "last_seen_at": NOW,
        "eligibility_status": "verified_eligible",
        "eligibility_evidence": [],
        "eligibility_rule_ids": [],
        "relevance_status": "strong_match",
        "relevance_reasons": [],
        "match_score": 80,
        "nationality_requirements": [],
        "employer_quality_tier": "priority",
        "publication_review_required": False,
        "status": "open",
        "consecutive_missing_count": 0,
        "source_health_at_last_check": "healthy",
        "email_approved": False,
        "ord": 0,
    }
    base.update(given)
    return base


def table(spark: SparkSession, ddl: str, rows: list[dict]) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields) for row in rows], schema)


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return table(spark, RECORD, rows)


def norm(value) -> str:
    return " ".join(re.findall("[a-z0-9]+", (value or "").casefold()))


def conflict(a: dict, b: dict) -> bool:
    if (a["source_registry_id"], a["source_identifier"]) == (b["source_registry_id"], b["source_identifier"]):
        return False
    for name in ("named_office_or_mp", "division"):
        if a.get(name) and b.get(name) and norm(a[name]) != norm(b[name]):
            return True
    if a.get("programme_start") and b.get("programme_start") and a["programme_start"] != b["programme_start"]:
        return True
    la, lb = norm(a["location"]), norm(b["location"])
    if la == lb or "multi_location" in (a["location_type"], b["location_type"]):
        return False
    return not all("london" in x or "westminster" in x for x in (la, lb))


def join_two(a: dict, b: dict) -> dict:
    better = AUTHORITY_RANK[a["source_authority"]] >= AUTHORITY_RANK[b["source_authority"]]
    keep, other = (a, b) if better else (b, a)
    out = dict(keep)
    out["all_source_urls"] = list(dict.fromkeys(keep["all_source_urls"] + other["all_source_urls"]))
    out["secondary_tags"] = list(dict.fromkeys(keep["secondary_tags"] + other["secondary_tags"]))
    out["eligibility_evidence"] = keep["eligibility_evidence"] + [
        e for e in other["eligibility_evidence"] if e not in keep["eligibility_evidence"]
    ]
    out["first_seen_at"] = min(a["first_seen_at"], b["first_seen_at"])
    out["last_seen_at"] = max(a["last_seen_at"], b["last_seen_at"])
    for name in ("listing_publisher", "division", "application_method", "political_affiliation"):
        if not out.get(name):
            out[name] = other.get(name)
    return out


def brute_resolve(rows: list[dict], keys: dict[int, set]) -> list[dict]:
    """Row-by-row greedy over the given keys."""
    groups: list[list] = []
    for row in sorted(rows, key=lambda r: r["ord"]):
        mine = set(keys[row["ord"]])
        hits = [g for g in groups if g[0] & mine and not conflict(g[1], row)]
        if not hits:
            groups.append([mine, row, row["ord"]])
            continue
        base = hits[0]
        base[0] |= mine
        base[1] = join_two(base[1], row)
        for extra in reversed(hits[1:]):
            base[0] |= extra[0]
            base[1] = join_two(base[1], extra[1])
            groups = [g for g in groups if g is not extra]
    return [{**g[1], "ord": g[2]} for g in groups]


def brute_greedy(fresh: list[tuple[int, set]], old: list[tuple[int, set]]) -> set:
    taken, out = set(), set()
    for f, fk in sorted(fresh):
        for o, ok in sorted(old):
            if o not in taken and fk & ok:
                taken.add(o)
                out.add((f, o))
                break
    return out


def as_dict(row) -> dict:
    return row.asDict(recursive=True)


