"""Source health: roll-up, reconciliation, cadence and status."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.operators.ordered import hash_tree, previous_row, rank_within
from listwright.session import cut

C = F.col

WATCHED_NOTE = "Watched page retrieved; its listings are reviewed by hand"
CHANGED_NOTE = "Official source content changed; review the source before closure decisions"


def coverage_ok(advertised: Column, found: Column) -> Column:
    """At most one advertised listing may be missing."""
    return advertised.isNull() | (found >= F.greatest(F.lit(1), advertised - 1))


def ordered_digest(df: DataFrame, keys: list[str], position: str, value: str, into: str, fan: int = 4096) -> DataFrame:
    """Hash tree over the values in position order: it depends on their order, not on their numbers."""
    narrow = cut(df.select(*keys, position, value), "values")
    ranked = rank_within(narrow, keys, [position, value], C(position), "_rank").withColumn("_rank", C("_rank") - 1)
    return hash_tree(ranked, keys, "_rank", value, into, fan=fan)


def health_rollup(payloads: DataFrame, raw: DataFrame, registry: DataFrame, advertised: DataFrame | None = None) -> DataFrame:
    """One health row per source of a scan.

    ``payloads`` gives pages and hashes, ``raw`` the extracted rows before de-duplication (their
    count is the number of appearances), ``advertised`` optionally ``(source_id, advertised)``.
    """
    pages = payloads.withColumn("_hash", F.sha2("payload", 256))
    counted = pages.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("pages_scanned"), F.max("fetched_at").alias("checked_at")
    )
    digest = ordered_digest(pages, ["source_id"], "page_no", "_hash", "content_hash")
    per_item = raw.groupBy("source_id", "source_identifier").agg(F.count(F.lit(1)).alias("_n"))
    items = per_item.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("found"), F.sum("_n").alias("listing_count")
    )
    source = registry.select(C("id").alias("source_id"), "result_cap", "expected_min_items", F.coalesce("monitor_only", F.lit(False)).alias("_watched"))
    df = counted.join(digest, "source_id").join(items, "source_id", "left").join(source, "source_id")
    df = df.join(advertised, "source_id", "left") if advertised is not None else df.withColumn(
        "advertised", F.lit(None).cast("bigint")
    )
    found = F.coalesce(C("found"), F.lit(0))
    kept = F.least(found, F.coalesce(C("result_cap").cast("bigint"), found))
    capped = F.coalesce(found >= C("result_cap"), F.lit(False))
    parser_ok = (kept >= F.coalesce(C("expected_min_items"), F.lit(0))) & coverage_ok(C("advertised"), kept)
    return df.select(
        "source_id",
        # A page that is only watched gives no rows, so its silence must never close any.
        F.when(parser_ok & ~capped & ~C("_watched"), "healthy").otherwise("degraded").alias("status"),
        "checked_at",
        C("checked_at").alias("last_success_at"),
        kept.alias("item_count"),
        F.coalesce("listing_count", F.lit(0)).alias("listing_count"),
        kept.alias("candidate_count"),
        "pages_scanned",
        capped.alias("capped"),
        parser_ok.alias("parser_ok"),
        "content_hash",
        F.lit(False).alias("changed_since_last_success"),
        F.concat(
            F.lit("Scanned "), kept.cast("string"), F.lit(" unique listings across "), C("pages_scanned").cast("string"),
            F.lit(" pages"),
        ).alias("message"),
    )


def failed_health(sources: DataFrame, now: Column, message: Column) -> DataFrame:
    """Health rows of sources whose extraction failed: zero rows, parser not OK."""
    return _bare(sources, "failed", now, F.lit(False), message)


def missing_settings(have: Column) -> Column:
    return F.array_except(F.coalesce(C("required_settings"), F.array().cast("array<string>")), have)


def active_sources(registry: DataFrame, available: Iterable[str]) -> DataFrame:
    """Sources that have all the settings they need; the others give no listings."""
    have = F.array(*[F.lit(x) for x in available]) if available else F.array().cast("array<string>")
    return registry.filter(F.size(missing_settings(have)) == 0)


def inactive_health(registry: DataFrame, available: Iterable[str], now: Column) -> DataFrame:
    """Sources whose required settings are absent produce a DISABLED row and no listings."""
    have = F.array(*[F.lit(x) for x in available]) if available else F.array().cast("array<string>")
    missing = missing_settings(have)
    idle = registry.filter(F.size(missing) > 0).select(C("id").alias("source_id"), missing.alias("_missing"))
    note = F.concat(
        F.lit("Credentialed source is ready but inactive; set "), F.array_join("_missing", ", ")
    )
    return _bare(idle, "disabled", now, F.lit(True), note)


def _bare(df: DataFrame, status: str, now: Column, parser_ok: Column, message: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return df.select(
        "source_id",
        F.lit(status).alias("status"),
        now.alias("checked_at"),
        F.lit(None).cast("timestamp").alias("last_success_at"),
        zero.alias("item_count"),
        zero.alias("listing_count"),
        zero.alias("candidate_count"),
        zero.alias("pages_scanned"),
        F.lit(False).alias("capped"),
        parser_ok.alias("parser_ok"),
        F.lit(None).cast("string").alias("content_hash"),
        F.lit(False).alias("changed_since_last_success"),
        message.alias("message"),
    )


def safe_scan() -> Column:
    """Only such a scan is evidence of absence."""
    return (C("status") == "healthy") & ~C("capped") & C("parser_ok")


def replaceable_sources(health: DataFrame) -> DataFrame:
    return health.filter(safe_scan() & ~C("changed_since_last_success")).select("source_id")


def due_sources(registry: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Sources to scan: never checked, not cleanly checked, or past their interval."""
    last = health.select(
        C("source_id").alias("id"), C("checked_at").alias("_at"), (safe_scan()).alias("_clean")
    )
    wait = F.make_interval(mins=C("poll_interval_minutes"))
    due = (
        (C("poll_interval_minutes") == 0)
        | C("_at").isNull()
        | ~C("_clean")
        | (C("_at") + wait <= now)
    )
    return registry.join(last, "id", "left").filter(due).drop("_at", "_clean")


def join_previous_health(health: DataFrame, previous: DataFrame) -> DataFrame:
    packed = previous.select("source_id", F.struct(*[C(n) for n in previous.columns]).alias("previous"))
    return health.join(packed, "source_id", "left")


def reconcile_health(current: DataFrame, previous: DataFrame, registry: DataFrame) -> DataFrame:
    """Watched pages degrade, changed or not; a failed run keeps its last success and last good hash."""
    watched = registry.select(C("id").alias("source_id"), C("monitor_only").alias("_watched"))
    df = join_previous_health(current, previous).join(watched, "source_id", "left")
    changed = F.coalesce(
        C("_watched") & (C("content_hash") != C("previous.content_hash")), F.lit(False)
    )
    keep = C("last_success_at").isNull() & C("previous.source_id").isNotNull()
    replaced = {
        "status": F.when(F.coalesce("_watched", F.lit(False)) & (C("status") == "healthy"), "degraded").otherwise(C("status")),
        "changed_since_last_success": changed | C("changed_since_last_success"),
        "message": F.when(changed, CHANGED_NOTE)
        .when(F.coalesce("_watched", F.lit(False)) & (C("status") == "healthy"), WATCHED_NOTE)
        .otherwise(C("message")),
        "last_success_at": F.when(keep, C("previous.last_success_at")).otherwise(C("last_success_at")),
        "content_hash": F.when(keep, F.coalesce("content_hash", C("previous.content_hash"))).otherwise(C("content_hash")),
    }
    return df.select(*[replaced[n].alias(n) if n in replaced else C(n) for n in current.columns])


def source_changes(health: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """Observation rows for sources whose watched page changed."""
    where = registry.select(C("id").alias("source_id"), C("endpoint").alias("source_url"))
    return (
        health.filter("changed_since_last_success")
        .join(where, "source_id", "left")
        .select(
            F.lit(None).cast("string").alias("role_id"),
            "source_id",
            F.lit(None).cast("string").alias("source_identifier"),
            now.alias("observed_at"),
            "source_url",
            F.array(F.lit("official_source_page_changed")).alias("changes"),
        )
    )


def hash_changes(history: DataFrame) -> DataFrame:
    """Per scan of a source: did the content hash change against the scan before it?"""
    number = F.unix_micros(C("checked_at").cast("timestamp"))
    df = previous_row(history, ["source_id"], ["checked_at"], number, {"hash": C("content_hash")})
    return df.withColumn(
        "changed", F.coalesce(C("prev.hash") != C("content_hash"), F.lit(False))
    ).drop("prev")


def carry_forward(current: DataFrame, previous: DataFrame, key: str = "source_id") -> DataFrame:
    """Current rows plus the previous rows of everything not scanned now."""
    return current.unionByName(previous.join(current.select(key), key, "left_anti").select(*current.columns))


def source_groups(registry: DataFrame) -> DataFrame:
    """Each enabled source as ``publishing`` or ``watched``."""
    return registry.filter("enabled").withColumn(
        "source_group", F.when(C("monitor_only"), "watched").otherwise("publishing")
    )


def source_status(registry: DataFrame, health: DataFrame) -> DataFrame:
    """Status table of the enabled sources."""
    from listwright.functions.text import label

    seen = health.select(
        C("source_id").alias("id"), C("status").alias("_status"), C("listing_count").alias("_n"), C("message").alias("_message")
    )
    df = registry.filter("enabled").join(seen, "id", "left")
    note = F.coalesce(F.nullif(C("_message"), F.lit("")), C("notes"))
    return df.select(
        "id",
        "canonical_name",
        F.when(C("ats_type") == "curated_yaml", "Verified snapshot")
        .otherwise(F.coalesce(label(C("_status")), F.lit("Awaiting scheduled scan")))
        .alias("source_state"),
        F.coalesce("_n", F.lit(0)).alias("listings"),
        F.concat(
            F.when(C("monitor_only"), "Page watch only — no role publication. ").otherwise(""),
            F.coalesce(note, F.lit("")),
        ).alias("note"),
    )
