"""One scan: payloads and stored state in, new state out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright import schema
from listwright.operators import health as H
from listwright.operators import lifecycle as L
from listwright.operators import serving
from listwright.operators.classify import classify, is_public, with_possible
from listwright.operators.matching import minus_ids, with_keys
from listwright.operators.ordered import apply_cap, dedupe_first, dedupe_last, rank_within
from listwright.operators.resolve import resolve
from listwright.rules.ruleset import RuleSet
from listwright.session import cut, shuffled
from listwright.sources import extract, payloads as P
from listwright.sources.state import commit_state, current_versions, read_state

C = F.col


@dataclass
class Dimensions:
    registry: DataFrame
    overrides: DataFrame | None
    expected: DataFrame | None
    rules: RuleSet


@dataclass
class State:
    open: DataFrame
    recent: DataFrame
    possible: DataFrame
    review: DataFrame
    closed: DataFrame
    observations: DataFrame
    health: DataFrame
    metrics: DataFrame | None = None
    summary: DataFrame | None = None


TABLES = {
    "open": schema.RECORD,
    "recent": schema.RECORD,
    "possible": schema.RECORD,
    "review": schema.RECORD,
    "closed": schema.RECORD,
    "observations": schema.OBSERVATIONS,
    "health": schema.HEALTH,
}


def load_dimensions(spark: SparkSession, root: str, rules: RuleSet) -> Dimensions:
    """Registry, overrides and expected programmes from JSON tables in ``root``."""
    read = lambda name, ddl: spark.read.schema(ddl).json(f"{root}/{name}")
    return Dimensions(
        read("registry", schema.REGISTRY), read("overrides", schema.OVERRIDES), read("expected", schema.EXPECTED), rules
    )


def load_state(spark: SparkSession, root: str) -> State:
    _, versions = current_versions(spark, root)
    return State(**{name: read_state(spark, root, name, ddl, versions) for name, ddl in TABLES.items()})


def save_state(state: State, root: str, scan_id: str) -> int:
    """Number of tables that changed; all of them become current in one step."""
    return len(commit_state({name: getattr(state, name) for name in TABLES}, root, scan_id))


# Kinds whose pages are shards of queries are cut at their cap, first appearance first; paged boards
# keep the last appearance; rows of the other kinds all go on, repeats meet in the merge.
SHARD_KINDS = ("work_hub", "adzuna", "reed")
LAST_WINS = ("charityjob", "nhs_jobs", "jobs_ac_uk", "targetjobs", "higherin", "w4mp")


def in_order(payloads: DataFrame) -> DataFrame:
    """Pages numbered per source over all of its query shards, so that no two rows share a place.

    Shards follow each other by their first fetch, then by their query. Only page numbers are ranked, in slices of the
    fetch times.
    """
    pages = payloads.select("source_id", "query", "page_no", "fetched_at")
    shards = pages.groupBy("source_id", "query").agg(F.min("fetched_at").alias("_at"))
    numbered = pages.select("source_id", "query", "page_no").distinct().alias("p").join(
        shards.alias("s"), (C("p.source_id") == C("s.source_id")) & C("p.query").eqNullSafe(C("s.query"))
    ).select("p.source_id", "p.query", "p.page_no", "s._at")
    numbered = rank_within(cut(numbered, "pages"), ["source_id"], ["_at", "query", "page_no"], F.coalesce(F.unix_micros("_at"), F.lit(-(1 << 62))), "_n")
    numbered = numbered.select(C("source_id").alias("_s"), C("query").alias("_q"), C("page_no").alias("_p"), "_n")
    same = (C("source_id") == C("_s")) & C("query").eqNullSafe(C("_q")) & C("page_no").eqNullSafe(C("_p"))
    return payloads.join(shuffled(numbered), same).withColumn("page_no", C("_n").cast("int")).select(*payloads.columns)


def distinct_order(registry: DataFrame) -> DataFrame:
    """Sources numbered by their order, then by id: no two share a number. The registry is a small dimension."""
    number = F.row_number().over(Window.orderBy(F.coalesce("source_ord", F.lit(0)), "id"))
    return registry.withColumn("source_ord", number.cast(registry.schema["source_ord"].dataType))


#: Rows that one task classifies.
PART_ROWS = 10_000


def spread_rows(raw: DataFrame, rows: int) -> DataFrame:
    """Raw rows dealt to every core: their rules take long and their bytes are few, so that files and shuffles by size
    make too few parts."""
    parts = max(raw.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS))
    return raw.repartition(parts, "source_id", "page_no", "position")


def unique_rows(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of each source without repeats, as its kind wants it; only query shards are cut at their cap."""
    order = F.struct("page_no", "position")
    kinds = registry.select(C("id").alias("source_id"), C("ats_type").alias("_kind"), "result_cap")
    typed = raw.join(kinds, "source_id")
    names = [*raw.columns, "_kind", "result_cap"]
    sharded = dedupe_first(typed.filter(C("_kind").isin(*SHARD_KINDS)), ["source_id", "source_identifier"], order)
    number = C("first_ord.page_no").cast("bigint") * (1 << 31) + C("first_ord.position")
    sharded = apply_cap(sharded, ["source_id"], ["first_ord"], C("result_cap"), number).select(*names)
    paged = dedupe_last(typed.filter(C("_kind").isin(*LAST_WINS)), ["source_id", "source_identifier"], order)
    # The last appearance takes the place of the first.
    paged = paged.withColumns({"page_no": C("first_ord.page_no"), "position": C("first_ord.position")}).select(*names)
    plain = typed.filter(~C("_kind").isin(*SHARD_KINDS, *LAST_WINS)).select(*names)
    return plain.unionByName(sharded).unionByName(paged).select(*raw.columns)


def run_scan(
    payloads: DataFrame,
    state: State,
    dims: Dimensions,
    now: Column,
    available_settings: Iterable[str] = (),
    category: str | None = None,
    include_absence_closed: bool = True,
) -> State:
    """Extract, classify, resolve, compare, close, tier.

    Rows keep input order through ``ord``. Stored tables are renumbered behind one another where
    their order matters.
    """
    whole, rules = distinct_order(dims.registry), dims.rules
    # A source that lacks its settings gives a disabled health row and nothing else.
    registry = H.active_sources(whole, list(available_settings))
    payloads = cut(in_order(payloads.join(registry.select(C("id").alias("source_id")), "source_id", "left_semi")), "payloads")
    raw = cut(extract.extract_all(payloads, registry), "raw")
    extracted = raw.count()
    failures = cut(extract.structure_failures(payloads, raw, registry), "failures")
    sources = registry.join(failures.select(C("source_id").alias("id")), "id", "left_anti")
    raw = raw.join(failures.select("source_id"), "source_id", "left_anti")
    rolled = H.health_rollup(
        payloads.join(sources.select(C("id").alias("source_id")), "source_id", "left_semi"),
        raw, sources, extract.advertised_counts(payloads, registry),
    )
    current = rolled.unionByName(H.failed_health(failures, now, C("message"))).unionByName(
        H.inactive_health(whole, list(available_settings), now)
    )
    current = cut(H.reconcile_health(current, state.health, registry), "health")

    unique = spread_rows(unique_rows(raw, registry), extracted)
    records = classify(unique, registry, dims.overrides, rules, now)
    records = records.drop("source_health_at_last_check").join(
        current.select(C("source_id").alias("source_registry_id"), C("status").alias("source_health_at_last_check")),
        "source_registry_id", "left",
    ).select(*records.columns)
    # Keys and tiers are costly: made once for each row and kept with it until the state is stored.
    records = cut(with_keys(serving.restrict(records, category=category)), "classified")
    tiered = cut(with_possible(resolve(records), rules), "resolved")
    roles = tiered.drop("is_possible")

    old_public = L.renumber(state.open, state.recent)
    old_all = cut(with_keys(L.renumber(old_public, state.closed)), "old")
    old_public = old_all.join(shuffled(state.closed.select("id")), "id", "left_anti")
    old_possible, old_review = (cut(with_keys(df), "old") for df in (state.possible, state.review))
    notes = cut(L.change_feed(L.renumber(old_all, old_possible), roles, now), "notes")
    candidates = roles.filter(is_public(assume_open=True))
    judged = current.limit(0) if category else current
    processed, missing = L.lifecycle(old_all, candidates, judged, now)
    closing = cut(L.policy_close(roles, old_public, now), "policy")
    # A refetched row that fails the boundary is not a missing row: policy closure takes precedence.
    processed = cut(minus_ids(processed, closing), "processed")
    missing = cut(minus_ids(missing, closing), "missing")
    public = processed.filter(C("status") != "closed")
    closed_now = processed.filter(C("status") == "closed").unionByName(closing)
    if include_absence_closed:
        closed_now = closed_now.unionByName(missing)
    closed = L.upsert_closed(state.closed, closed_now.drop("keys"))
    open_rows, recent = L.split_open_recent(public.drop("keys"))
    possible = cut(L.next_possible(old_possible, tiered, public, current, rules, now).drop("keys"), "possible")
    review = cut(L.next_review(old_review, tiered, current, rules).drop("keys"), "review")
    fresh_notes = (
        H.source_changes(current, registry, now).unionByName(notes).unionByName(L.removal_notes(missing, now))
    )
    observations = L.append_observations(state.observations, fresh_notes, now)
    all_health = H.carry_forward(current, state.health)
    out = State(open_rows, recent, possible, review, closed, observations, all_health)
    out.metrics = serving.scan_metrics(open_rows, recent, possible, review, all_health, registry, now)
    out.summary = serving.scan_summary(all_health, current, records, public, possible, review)
    return out


def payloads_due(payloads: DataFrame, registry: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Only payloads of sources that are due: the join prunes the scan by source."""
    due = H.due_sources(registry.filter("enabled"), health, now).select(C("id").alias("source_id"))
    return payloads.join(due, "source_id", "left_semi")


__all__ = ["Dimensions", "P", "State", "load_dimensions", "load_state", "payloads_due", "run_scan", "save_state"]
