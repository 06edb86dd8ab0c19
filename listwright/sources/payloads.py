"""Captured payloads as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions import urls
from listwright.operators.phrases import barrier
from listwright.schema import PAYLOADS, RAW
from pyspark.sql.types import StructType

C = F.col


def read_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Payload table, or a folder ``source_id=…/page`` of files read as binary."""
    if fmt != "binaryFile":
        return spark.read.schema(PAYLOADS).format(fmt).load(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    source = F.regexp_extract(C("path"), r"source_id=([^/]+)", 1)
    return files.select(
        source.alias("source_id"),
        F.regexp_extract(C("path"), r"scan_id=([^/]+)", 1).alias("scan_id"),
        F.coalesce(F.nullif(F.regexp_extract(C("path"), r"(\d+)[^/]*$", 1), F.lit("")).try_cast("int"), F.lit(1)).alias("page_no"),
        F.lit(None).cast("string").alias("query"),
        F.regexp_extract(C("path"), r"\.([A-Za-z0-9]+)$", 1).alias("content_type"),
        C("content").alias("payload"),
        C("modificationTime").alias("fetched_at"),
    )


def with_text(payloads: DataFrame) -> DataFrame:
    """Decoded body and hash; bytes that are not UTF-8 become the replacement character, so no page ends the job."""
    body = F.make_valid_utf8(C("payload").cast("string"))
    return payloads.withColumns({"body": body, "payload_hash": F.sha2("payload", 256)})


def of_kind(payloads: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
    """Payloads of the sources of one kind, with the source row as ``src``."""
    chosen = registry.filter(C("ats_type") == kind)
    dimension = chosen.select(C("id").alias("source_id"), F.struct(*[C(n) for n in registry.columns]).alias("src"))
    return payloads.join(dimension, "source_id")


def build_raw(extracted: DataFrame, overwritten: dict[str, Column] | None = None) -> DataFrame:
    """Raw rows with defaults from the source: names, authority, type, absolute links.

    ``extracted`` has ``src``, ``kind``, ``source_identifier``, ``title``, ``url`` and any raw columns.
    """
    have = set(extracted.columns)
    own = lambda name, default: F.coalesce(C(name), default) if name in have else default
    base = F.coalesce(F.nullif(C("src.endpoint"), F.lit("")), F.nullif(C("src.careers_url"), F.lit("")), F.lit(""))
    given = F.nullif(C("application_url"), F.lit("")) if "application_url" in have else F.lit(None).cast("string")
    extracted = extracted.withColumns({"_base": base, "_given": given})
    # Each link is resolved once and then reused by name.
    extracted = extracted.withColumn("_link", urls.resolve_url(C("_base"), C("url")))
    if "application_url" in have:
        apply = F.when(C("_given").isNotNull(), urls.resolve_url(C("_base"), C("_given"))).otherwise(C("_link"))
    else:
        apply = C("_link")
    # A row without an absolute web link is not a listing. The barrier keeps the test above the parsing.
    extracted = barrier(extracted.withColumn("_apply", apply)).filter(urls.is_web_url(C("_link")))
    link = C("_link")
    empty = F.array().cast("array<string>")
    made = {
        "source_id": C("src.id"),
        "employer": own("employer", C("src.canonical_name")),
        "source_url": link,
        "application_url": C("_apply"),
        "source_type": C("kind"),
        "source_authority": own("source_authority", C("src.source_authority")),
        "organisation_type": own("organisation_type", C("src.organisation_type")),
        "location": own("location", F.lit("Unknown")),
        "location_type": own("location_type", F.lit("unknown")),
        "description": own("description", F.lit("")),
        "eligibility_text": own("eligibility_text", F.lit("")),
        "nationality_requirements": own("nationality_requirements", empty),
        "residency_requirements": own("residency_requirements", empty),
        "clearance_requirements": own("clearance_requirements", empty),
        "secondary_tags": own("secondary_tags", empty),
        "explicitly_closed": own("explicitly_closed", F.lit(False)),
        "all_source_urls": F.array(link),
        "source_ord": F.coalesce(C("src.source_ord"), F.lit(0)),
        **(overwritten or {}),
    }
    fields = StructType.fromDDL(RAW).fields
    out = []
    for field in fields:
        value = made.get(field.name, C(field.name) if field.name in have else F.lit(None))
        out.append(value.cast(field.dataType).alias(field.name))
    return extracted.select(*out)


def quarantined(extracted: DataFrame) -> DataFrame:
    """Extracted rows whose link does not resolve to a web address."""
    base = F.coalesce(F.nullif(C("src.endpoint"), F.lit("")), C("src.careers_url"), F.lit(""))
    return extracted.filter(~urls.is_web_url(urls.resolve_url(base, C("url"))))
