"""Rows that a scan keeps, payloads that fail their source, and streams over many files."""

import datetime as dt
import json
import random

import pytest
from helpers import NOW, table
from listwright import schema
from listwright.plans import scan
from listwright.sources import extract
from listwright.streaming import jobs
from pyspark.sql import functions as F


def source(name, kind, **given):
    return {"id": name, "canonical_name": name, "ats_type": kind, "enabled": True, "monitor_only": False, "source_ord": 0, **given}


def raw(source_id, rows):
    return [{"source_id": source_id, "source_identifier": i, "page_no": p, "position": k, "title": t} for k, (i, p, t) in enumerate(rows)]


def test_unique_rows_by_kind(spark):
    registry = table(spark, schema.REGISTRY, [source("a", "adzuna", result_cap=2), source("b", "generic_json"), source("c", "nhs_jobs", result_cap=1), source("d", "reed")])
    rows = raw("a", [("1", 1, "x"), ("2", 1, "x"), ("1", 2, "y"), ("3", 2, "x")])
    rows += raw("b", [("1", 1, "x"), ("1", 1, "y"), ("2", 1, "x")])
    rows += raw("c", [("1", 1, "x"), ("2", 1, "x"), ("1", 2, "y")])
    rows += raw("d", [(str(k), 1, "x") for k in range(6)])
    got = scan.unique_rows(table(spark, schema.RAW, rows), registry).collect()
    kept = sorted((r["source_id"], r["source_identifier"], r["title"], r["page_no"]) for r in got)
    assert kept == sorted(
        [("a", "1", "x", 1), ("a", "2", "x", 1), ("b", "1", "x", 1), ("b", "1", "y", 1), ("b", "2", "x", 1), ("c", "1", "y", 1), ("c", "2", "x", 1)]
        + [("d", str(k), "x", 1) for k in range(6)]
    )


def test_shards_share_no_page_numbers(spark):
    at = lambda minute: NOW + dt.timedelta(minutes=minute)
    rows = [
        {"source_id": "a", "query": "law", "page_no": 1, "payload": b"1", "fetched_at": at(0)},
        {"source_id": "a", "query": "law", "page_no": 2, "payload": b"2", "fetched_at": at(1)},
        {"source_id": "a", "query": "art", "page_no": 1, "payload": b"3", "fetched_at": at(2)},
        {"source_id": "b", "query": None, "page_no": 7, "payload": b"4", "fetched_at": at(0)},
    ]
    got = {bytes(r["payload"]): r["page_no"] for r in scan.in_order(table(spark, schema.PAYLOADS, rows)).collect()}
    assert got == {b"1": 1, b"2": 2, b"3": 3, b"4": 1}
    registry = scan.distinct_order(table(spark, schema.REGISTRY, [source("b", "lever"), source("a", "lever")]))
    assert {r["id"]: r["source_ord"] for r in registry.collect()} == {"a": 1, "b": 2}


BROKEN = {
    "lever": b'{"jobs": []}', "generic_json": b'{"other": 1}', "adzuna": b'{"count": 3}', "reed": b"[]", "greenhouse": b"not json",
    "targetjobs": b'{"search": {"documents": []}}', "charityjob": b"<html>new</html>", "jobs_ac_uk": b"<html>new</html>", "prospects": b"<ul></ul>",
    "legalcheek": b"<html>new</html>", "work_hub": b"<html>new</html>", "feed": b"not \xff xml", "higherin": b"<html></html>", "unheard_of": b"{}",
}
SOUND = {
    "lever": b"[]", "generic_json": b'{"jobs": []}', "adzuna": b'{"results": []}', "reed": b'{"results": []}', "greenhouse": b'{"jobs": []}',
    "targetjobs": b'{"search": {"documents": [], "result_count": 0}}', "charityjob": b"Page 1 of 1", "jobs_ac_uk": b'<strong class="job-count"> 0</strong>',
    "legalcheek": b"Noticeboard <div class='pagination'></div>", "work_hub": b"No jobs", "feed": b"<rss><channel></channel></rss>",
}


def test_sources_fail_closed(spark):
    payloads, sources = [], []
    for state, bodies in (("bad", BROKEN), ("good", SOUND)):
        for kind, body in bodies.items():
            sources.append(source(f"{state}-{kind}", kind))
            payloads.append({"source_id": f"{state}-{kind}", "page_no": 1, "payload": body, "fetched_at": NOW})
    sources.append(source("watched", "legalcheek", monitor_only=True))
    payloads.append({"source_id": "watched", "page_no": 1, "payload": b"changed", "fetched_at": NOW})
    failed = extract.structure_failures(table(spark, schema.PAYLOADS, payloads), table(spark, schema.RAW, []), table(spark, schema.REGISTRY, sources))
    assert {r["source_id"] for r in failed.collect()} == {f"bad-{kind}" for kind in BROKEN}


@pytest.mark.parametrize("files", [1, 20])
def test_streams_count_late_rows(spark, tmp_path, files):
    rnd = random.Random(files)
    start = dt.datetime(2026, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=rnd.randrange(60 * 24 * 10)), rnd.randrange(9)) for k in range(400)]
    for k in range(files):
        part = rows[k::files]
        spark.createDataFrame(part, "event_id bigint, ts timestamp, user_id bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    events = jobs.file_stream(spark, str(tmp_path), "events", "event_id bigint, ts timestamp, user_id bigint", files=5)
    got = jobs.latest(spark, jobs.drain(jobs.rate_limit_stream(events, "user_id", "ts", 60, 3), "update"), ["user_id", "window_started_at"])
    want = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).count()
    assert sorted((r["user_id"], r["window_started_at"], r["request_count"]) for r in got.collect()) == sorted((r["user_id"], r["h"], r["count"]) for r in want.collect())


def test_subscriptions_do_not_depend_on_arrival(spark):
    events = [("a", 1, "subscribe", 10, 100), ("a", 2, "confirm", 50, 150), ("b", 3, "subscribe", 10, 20), ("b", 4, "confirm", 30, 40),
              ("b", 5, "subscribe", 35, 90), ("c", 6, "unsubscribe", 5, 9), ("a", 7, "unsubscribe", 60, 0)]
    ddl = "email string, event_id bigint, action string, at bigint, expires bigint"
    for order in (events, events[::-1]):
        got = {r["email"]: (r["at"], r["status"], r["changes"]) for r in jobs.subscription_status(spark.createDataFrame(order, ddl)).collect()}
        assert got == {"a": (60, "unsubscribed", 3), "b": (35, "pending", 2)}
    assert json.dumps(sorted(got)) == '["a", "b"]'
