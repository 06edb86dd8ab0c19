import datetime as dt
import json

from pyspark.sql import functions as F

from helpers import NOW, table
from listwright import schema
from listwright.operators.ordered import previous_row, rank_within
from listwright.plans.scan import Dimensions, State, load_state, run_scan, save_state
from listwright.rules import default_rules

RULES = default_rules()


def job(i, **given):
    base = {
        "id": f"j{i}", "title": f"Policy research internship {i}", "url": f"/jobs/{i}", "location": "London",
        "description": "Legal and compliance research.", "eligibility": "Penultimate year students of any degree.",
        "paid": True, "cycle": "2026/27",
    }
    base.update(given)
    return base


def page(source, jobs, at):
    body = json.dumps({"jobs": jobs}).encode()
    return {"source_id": source, "scan_id": "x", "page_no": 1, "content_type": "json", "payload": body, "fetched_at": at}


def source(name, **given):
    base = {
        "id": name, "canonical_name": name.title(), "organisation_type": "corporate", "endpoint": f"https://{name}.test/jobs",
        "ats_type": "generic_json", "source_authority": "official_ats", "enabled": True, "priority_tier": "priority",
        "uk_priority_exception": False, "monitor_only": False, "manual_review_required": False, "source_ord": 1,
        "poll_interval_minutes": 0, "expected_min_items": 0,
    }
    base.update(given)
    return base


def test_two_scans_track_rows(spark, tmp_path):
    root = str(tmp_path / "state")
    registry = table(spark, schema.REGISTRY, [source("acme"), source("bolt", source_ord=2)])
    dims = Dimensions(registry, table(spark, schema.OVERRIDES, []), None, RULES)
    first = [
        page("acme", [job(1), job(2), job(3, location="Leeds")], NOW),
        page("bolt", [job(4), job(5, eligibility="", description="Research analysis.")], NOW),
    ]
    state = run_scan(table(spark, schema.PAYLOADS, first), load_state(spark, root), dims, F.lit(NOW).cast("timestamp"))
    assert save_state(state, root, "1") > 0
    stored = load_state(spark, root)
    public = {r.source_identifier: r.id for r in stored.open.collect()}
    assert set(public) == {"j1", "j2", "j4"}
    assert {r.source_identifier for r in stored.possible.collect()} == {"j5"}
    assert stored.observations.count() == 5 and stored.health.count() == 2

    later = NOW + dt.timedelta(days=1)
    second = [
        # j1 moves, j2 is now for final years only, j4 is absent from a page that cannot be read.
        page("acme", [job(1, deadline="2026-12-01"), job(2, eligibility="Final year only")], later),
        {**page("bolt", [], later), "payload": b"not json"},
    ]
    state = run_scan(table(spark, schema.PAYLOADS, second), stored, dims, F.lit(later).cast("timestamp"))
    rows = {r.source_identifier: r for r in state.open.collect()}
    assert set(rows) == {"j1", "j4"} and rows["j1"].id == public["j1"]
    assert rows["j1"].first_seen_at == NOW and rows["j1"].last_seen_at == later
    assert rows["j4"].consecutive_missing_count == 0
    closed = {r.source_identifier: r.closure_reason for r in state.closed.collect()}
    assert list(closed) == ["j2"] and "publication boundary" in closed["j2"]
    assert {r.source_identifier for r in state.possible.collect()} == {"j5"}
    health = {r.source_id: r.status for r in state.health.collect()}
    assert health == {"acme": "healthy", "bolt": "failed"}
    notes = {r.source_identifier: list(r.changes) for r in state.observations.filter(F.col("observed_at") == F.lit(later)).collect()}
    assert notes["j1"] == ["closing_date_changed"] and notes["j2"] == ["eligibility_wording_changed"]


def test_previous_row_crosses_slices(spark):
    rows = [("hot", i, i * 10) for i in range(200)] + [("cold", 3, 1), ("cold", 150, 2)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = previous_row(df, ["k"], ["t"], F.col("t"), {"v": F.col("v")}, buckets=7).collect()
    prev = {(r.k, r.t): (r.prev.v if r.prev else None) for r in got}
    assert prev[("hot", 0)] is None and prev[("cold", 3)] is None and prev[("cold", 150)] == 1
    assert all(prev[("hot", i)] == (i - 1) * 10 for i in range(1, 200))


def test_rank_within_equals_row_number(spark):
    df = spark.createDataFrame([(i % 2, (i * 37) % 101) for i in range(101)], "k int, t long")
    got = rank_within(df, ["k"], ["t"], F.col("t"), buckets=5).collect()
    for k in (0, 1):
        ordered = sorted((r.t, r["rank"]) for r in got if r.k == k)
        assert [rank for _, rank in ordered] == list(range(1, len(ordered) + 1))
