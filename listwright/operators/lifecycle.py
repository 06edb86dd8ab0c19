"""Snapshot lifecycle: changes, absence, closure, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions.values import array_union_ordered
from listwright.operators.classify import is_public, needs_review, with_possible
from listwright.operators.health import replaceable_sources, safe_scan
from listwright.operators.matching import (
    first_match,
    greedy_match,
    minus_ids,
    minus_keys,
    not_fetched_now,
    policy_matches,
    with_keys,
)
from listwright.operators.ordered import pick_last, previous_row
from listwright.operators.resolve import resolve
from listwright.rules.ruleset import RuleSet
from listwright.session import cut, shuffled

C = F.col

ABSENCES_TO_CLOSE = 3
ABSENCE_REASON = "Absent from three consecutive successful uncapped scans"
POLICY_REASON = "Current official evidence no longer meets the publication boundary"


# --- change labels --------------------------------------------------------------------------


#: Columns that ``change_labels`` compares.
COMPARED = (
    "application_url", "opening_date", "deadline", "programme_start", "programme_end", "eligibility_status",
    "eligibility_evidence", "location", "geographic_scope", "programme_type", "status",
)


def change_labels(prev: str, cur: str) -> Column:
    """Labels for a pair of record structs; ``prev`` NULL means first publication."""
    p, c = (lambda n: C(f"{prev}.{n}")), (lambda n: C(f"{cur}.{n}"))
    differs = lambda *names: ~F.struct(*[p(n) for n in names]).eqNullSafe(F.struct(*[c(n) for n in names]))
    texts = lambda side: F.transform(side("eligibility_evidence"), lambda e: e["text"])
    moved = differs("status")
    found = F.array_compact(
        F.array(
            F.when(differs("application_url"), "application_link_changed"),
            F.when(differs("opening_date"), "opening_date_changed"),
            F.when(differs("deadline"), "closing_date_changed"),
            F.when(differs("programme_start", "programme_end"), "programme_dates_changed"),
            F.when(
                differs("eligibility_status") | ~texts(p).eqNullSafe(texts(c)), "eligibility_wording_changed"
            ),
            F.when(differs("location", "geographic_scope"), "location_changed"),
            F.when(differs("programme_type"), "cycle_or_programme_type_changed"),
            F.when(moved & (c("status") == "open"), "applications_reopened")
            .when(moved & (c("status") == "closed"), "confirmed_closure")
            .when(moved & (c("status") == "upcoming"), "future_opening_announced"),
        )
    )
    return (
        F.when(p("id").isNull(), F.array(F.lit("newly_published")))
        .when(F.size(found) > 0, found)
        .otherwise(F.array(F.lit("observed_unchanged")))
    )


def change_feed(previous: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """Observation rows of a scan: each current record against its first stored match."""
    old = with_keys(previous)
    matches = first_match(with_keys(current), old, "ord", "ord_old", "ord_old") if "ord_old" in old.columns else (
        first_match(with_keys(current), old.withColumn("ord_old", C("ord")), "ord", "ord_old", "ord_old")
    )
    # What a note is made of; the other columns need not meet.
    seen = ("id", "source_registry_id", "source_identifier", "canonical_url", *COMPARED)
    before = previous.select(C("ord").alias("match_id"), F.struct("id", *COMPARED).alias("p"))
    pairs = (
        current.select("ord", F.struct(*seen).alias("c"))
        .join(shuffled(matches.select("ord", "match_id")), "ord", "left")
        .join(shuffled(before), "match_id", "left")
    )
    return pairs.select(
        C("c.id").alias("role_id"),
        C("c.source_registry_id").alias("source_id"),
        C("c.source_identifier").alias("source_identifier"),
        now.alias("observed_at"),
        C("c.canonical_url").alias("source_url"),
        change_labels("p", "c").alias("changes"),
    )


def change_flags(obs: DataFrame, key: str, order: str, columns: list[str], number: Column | None = None) -> DataFrame:
    """Names of the columns that changed against the previous observation of the same key."""
    number = F.unix_micros(C(order).cast("timestamp")) if number is None else number
    df = previous_row(obs, [key], [order], number, {"_seen": F.lit(True), **{n: C(n) for n in columns}})
    changed = F.array_compact(
        F.array(*[F.when(~C(n).eqNullSafe(C(f"prev.{n}")), F.lit(f"{n}_changed")) for n in columns])
    )
    return df.withColumn(
        "changes",
        F.when(C("prev").isNull(), F.array(F.lit("newly_published")))
        .when(F.size(changed) > 0, changed)
        .otherwise(F.array(F.lit("observed_unchanged"))),
    ).drop("prev")


# --- seen and missing -----------------------------------------------------------------------


def seen_bounds(obs: DataFrame, key: str, at: str) -> DataFrame:
    return obs.groupBy(key).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))


def absence_streaks(obs: DataFrame, scans: DataFrame, entity: str, scan: str, limit: int = ABSENCES_TO_CLOSE) -> DataFrame:
    """Runs of safe scans between two sightings (or after the last) in which an entity was absent.

    ``obs`` holds sightings ``(entity, scan)``; ``scans`` the safe scans as ``(scan, n)`` with ``n``
    numbering them 1, 2, 3 ... A streak is the gap between neighbouring sightings, so nothing is
    expanded to an entity-by-scan grid.
    """
    total = scans.agg(F.max("n").alias("_total"))
    seen = obs.select(entity, scan).distinct().join(scans, scan)
    # The sighting before each one; slices of the scan number keep a frequent entity spread out.
    gaps = previous_row(seen, [entity], ["n"], C("n"), {"n": C("n")})
    inner = gaps.filter(C("prev").isNotNull() & (C("n") - C("prev.n") > 1)).select(
        entity, (C("prev.n") + 1).alias("first_missing"), (C("n") - C("prev.n") - 1).alias("missing")
    )
    ends = seen.groupBy(entity).agg(F.max("n").alias("_last")).crossJoin(F.broadcast(total))
    trailing = ends.filter("_total > _last").select(
        entity, (C("_last") + 1).alias("first_missing"), (C("_total") - C("_last")).alias("missing")
    )
    return inner.unionByName(trailing).withColumn("closes", C("missing") >= limit)


# --- closure --------------------------------------------------------------------------------


def closure_health(existing: DataFrame, health: DataFrame) -> DataFrame:
    """Health of a row's source, by source id, else by source type."""
    flags = health.select(C("source_id"), safe_scan().alias("_safe"))
    by_id = flags.select(C("source_id").alias("source_registry_id"), C("_safe").alias("_safe_id"), C("source_id").alias("_hid"))
    by_type = flags.select(C("source_id").alias("source_type"), C("_safe").alias("_safe_type"), C("source_id").alias("_htype"))
    return (
        existing.join(by_id, "source_registry_id", "left")
        .join(by_type, "source_type", "left")
        .withColumns(
            {
                "safe": F.coalesce("_safe_id", "_safe_type", F.lit(False)),
                "health_source": F.coalesce("_hid", "_htype"),
            }
        )
        .drop("_safe_id", "_safe_type", "_hid", "_htype")
    )


def lifecycle(existing: DataFrame, observed: DataFrame, health: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(retained, newly_closed)`` after one scan. Both inputs carry unique ``ord`` numbers."""
    columns = observed.columns
    # Both the rows seen again and those unseen read the pairs.
    pairs = cut(greedy_match(with_keys(observed), with_keys(existing), "ord", "ord"), "pairs")
    old = existing.select(
        C("ord").alias("old_ord"),
        F.struct("id", "first_seen_at", "last_seen_at", "all_source_urls").alias("o"),
    )
    fresh = observed.join(shuffled(pairs), observed["ord"] == pairs["fresh_ord"], "left").drop("fresh_ord").join(shuffled(old), "old_ord", "left")
    found = C("o").isNotNull()
    kept = {
        "id": F.coalesce("o.id", "id"),
        "first_seen_at": F.least("o.first_seen_at", "first_seen_at"),
        "last_seen_at": F.greatest("o.last_seen_at", "last_seen_at"),
        "consecutive_missing_count": F.when(found, F.lit(0)).otherwise(C("consecutive_missing_count")),
        "all_source_urls": F.when(found, array_union_ordered(C("o.all_source_urls"), C("all_source_urls"))).otherwise(
            C("all_source_urls")
        ),
    }
    seen = fresh.select(*[kept[n].alias(n) if n in kept else C(n) for n in columns])
    unseen = existing.join(shuffled(pairs.select(C("old_ord").alias("ord"))), "ord", "left_anti").filter(C("status") != "closed")
    judged = closure_health(unseen, health).withColumn(
        "_missing", C("consecutive_missing_count") + C("safe").cast("int")
    )
    gone = C("safe") & (C("_missing") >= ABSENCES_TO_CLOSE)
    counted = judged.withColumn("consecutive_missing_count", C("_missing"))
    retained = seen.unionByName(counted.filter(~gone).select(*columns))
    closing = {
        "status": F.lit("closed"),
        "closed_at": now,
        "closure_reason": F.lit(ABSENCE_REASON),
        "closure_evidence": C("health_source"),
    }
    closed = counted.filter(gone).select(*[closing[n].alias(n) if n in closing else C(n) for n in columns])
    return retained, closed


def policy_close(fresh: DataFrame, public: DataFrame, now: Column) -> DataFrame:
    """A refetched row that fails the boundary closes its own earlier public row at once."""
    columns = fresh.columns
    failing = fresh.filter((C("status") != "closed") & ~is_public(assume_open=True))
    old = with_keys(public).withColumn("old_ord", C("ord"))
    matches = policy_matches(with_keys(failing), old, "ord", "old_ord", "old_ord")
    before = public.select(C("ord").alias("match_id"), C("id").alias("_id"), C("first_seen_at").alias("_first"))
    closing = {
        "id": C("_id"),
        "first_seen_at": C("_first"),
        "status": F.lit("closed"),
        "closed_at": now,
        "closure_reason": F.lit(POLICY_REASON),
        "closure_evidence": C("canonical_url"),
        "consecutive_missing_count": F.lit(0),
    }
    joined = failing.join(shuffled(matches.select("ord", "match_id")), "ord").join(shuffled(before), "match_id")
    return joined.select(*[closing[n].alias(n) if n in closing else C(n) for n in columns])


def removal_notes(closed: DataFrame, now: Column) -> DataFrame:
    return closed.select(
        C("id").alias("role_id"),
        C("source_registry_id").alias("source_id"),
        "source_identifier",
        now.alias("observed_at"),
        C("canonical_url").alias("source_url"),
        F.array(F.lit("confirmed_removal_after_three_scans")).alias("changes"),
    )


def latest_by_id(*tables: DataFrame, key: str = "id") -> DataFrame:
    """Union in which the last table's row wins per id."""
    numbered = None
    for i, df in enumerate(tables):
        part = df.withColumn("_table", F.lit(i))
        numbered = part if numbered is None else numbered.unionByName(part)
    return pick_last(numbered, [key], C("_table")).drop("_table")


def upsert_closed(closed: DataFrame, *newly: DataFrame) -> DataFrame:
    return latest_by_id(closed, *newly)


def union_state(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def split_open_recent(public: DataFrame, unstated: str = "cycle_unstated_recent_role") -> tuple[DataFrame, DataFrame]:
    return public.filter(C("programme_type") != unstated), public.filter(C("programme_type") == unstated)


def renumber(first: DataFrame, second: DataFrame) -> DataFrame:
    """Stack two ordered tables: all of ``first`` comes before all of ``second``."""
    lift = second.agg((F.max("ord") - F.min("ord") + 1).alias("w"), F.min("ord").alias("lo"))
    top = first.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("hi"))
    shift = top.crossJoin(lift)
    moved = second.crossJoin(F.broadcast(shift)).withColumn("ord", C("ord") - C("lo") + C("hi") + 1).drop("hi", "lo", "w")
    return first.unionByName(moved.select(*first.columns))


def next_possible(
    old: DataFrame, current: DataFrame, public: DataFrame, health: DataFrame, rules: RuleSet, now: Column
) -> DataFrame:
    """Possible tier after a scan: still valid unfetched rows plus current ones, never a public one."""
    columns = [n for n in current.columns if n != "is_possible"]
    fresh = with_possible(current, rules).filter("is_possible").drop("is_possible")
    known = with_keys(old).withColumn("old_ord", C("ord"))
    seen = first_match(with_keys(fresh), known, "ord", "old_ord", "old_ord")
    firsts = old.select(C("ord").alias("match_id"), C("first_seen_at").alias("_first"))
    fresh = fresh.join(shuffled(seen.select("ord", "match_id")), "ord", "left").join(shuffled(firsts), "match_id", "left")
    fresh = fresh.withColumns(
        {"first_seen_at": F.coalesce("_first", "first_seen_at"), "last_seen_at": now}
    ).select(*columns)
    kept = with_possible(old, rules).filter("is_possible").drop("is_possible")
    kept = _unreplaced(kept, current, health)
    merged = resolve(renumber(kept.select(*columns), fresh))
    merged = minus_ids(merged, public)
    return minus_keys(with_keys(merged), with_keys(public), "ord").select(*columns)


def next_review(old: DataFrame, current: DataFrame, health: DataFrame, rules: RuleSet) -> DataFrame:
    columns = [n for n in current.columns if n != "is_possible"]
    fresh = with_possible(current, rules).filter(needs_review(C("is_possible"))).drop("is_possible")
    return resolve(renumber(_unreplaced(old, current, health).select(*columns), fresh.select(*columns)))


def _unreplaced(old: DataFrame, current: DataFrame, health: DataFrame) -> DataFrame:
    clean = replaceable_sources(health).withColumnRenamed("source_id", "source_registry_id")
    left = old.join(clean, "source_registry_id", "left_anti")
    found = not_fetched_now(with_keys(left), with_keys(current), "ord")
    return found if "keys" in old.columns else found.drop("keys")


# --- observations ---------------------------------------------------------------------------


def retain(obs: DataFrame, now: Column, at: str, order: list[Column], days: int = 90, rows: int | None = None) -> DataFrame:
    """Rows of the last ``days``; of them the last ``rows`` if that is given. ``order`` is newest first."""
    young = obs.filter(C(at) >= now - F.expr(f"INTERVAL {days} DAYS"))
    return young if rows is None else young.orderBy(*order).limit(rows)


def append_observations(old: DataFrame, new: DataFrame, now: Column, days: int = 90, rows: int | None = None) -> DataFrame:
    """Retained history plus this scan's rows; unreadable times are dropped."""
    young = old.filter(C("observed_at").isNotNull() & (C("observed_at") >= now - F.expr(f"INTERVAL {days} DAYS")))
    stacked = young.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    order = [F.desc("_batch"), F.desc("observed_at"), F.desc("source_id"), F.desc("source_identifier"), F.desc("role_id")]
    return (stacked if rows is None else stacked.orderBy(*order).limit(rows)).drop("_batch")


def grid_rank(scans: DataFrame, scan: str) -> DataFrame:
    """Number safe scans 1, 2, 3 ...; one row per scan of the whole system, so one window is fine."""
    return scans.select(scan).distinct().withColumn("n", F.row_number().over(Window.orderBy(scan)).cast("bigint"))
