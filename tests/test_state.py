"""Hash trees and commits of several tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from listwright.operators.digest import digest_id
from listwright.operators.health import ordered_digest
from listwright.operators.ordered import hash_tree
from listwright.sources.state import commit_state, current_versions, read_state, write_state
from listwright.streaming.jobs import subscription_status

DDL = "id bigint, v string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(items, fan, separator=""):
    level = [sha(separator.join(items[k : k + fan])) for k in range(0, len(items), fan)]
    while len(level) > 1:
        parts = [level[k : k + fan] for k in range(0, len(level), fan)]
        level = [p[0] if len(p) == 1 else sha("".join(p)) for p in parts]
    return level[0]


@pytest.mark.parametrize("partitions", [1, 13])
def test_hash_tree(spark, partitions):
    sizes = {"a": 1, "b": 4, "c": 5, "d": 17, "e": 200}
    rows = [(k, i, f"{k}{i * 7 % 11}") for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at long, v string").orderBy(F.rand(3)).repartition(partitions)
    got = {r["k"]: r["h"] for r in hash_tree(df, ["k"], "at", "v", "h", "|", fan=4).collect()}
    assert got == {k: tree([v for kk, _, v in rows if kk == k], 4, "|") for k in sizes}
    # Up to one slice it is the hash of the joined list.
    assert hash_tree(df.filter("k = 'd'"), [], "at", "v", "h", "|").first()["h"] == sha("|".join(v for k, _, v in rows if k == "d"))


def test_digest_id_and_page_digest(spark):
    ids = [f"id{i}" for i in range(10)]
    ranked = spark.createDataFrame(list(enumerate(ids)), "position int, id string")
    assert digest_id(ranked).first()["digest_id"] == sha("|".join(ids))[:20]
    assert digest_id(ranked, fan=3).first()["digest_id"] == tree(ids, 3, "|")[:20]
    assert digest_id(ranked.limit(0)).first()["digest_id"] == sha("")[:20]
    pages = spark.createDataFrame([("s", 5, "x"), ("s", 2, "y"), ("s", 90, "z"), ("t", 1, "q")], "source_id string, page_no int, h string")
    got = {r["source_id"]: r["d"] for r in ordered_digest(pages, ["source_id"], "page_no", "h", "d", fan=2).collect()}
    assert got == {"s": tree(["y", "x", "z"], 2), "t": sha("q")}


def rows(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), DDL)


def test_a_scan_that_stops_leaves_the_old_state_whole(spark, tmp_path):
    root = str(tmp_path / "state")
    names = ["a", "b", "c", "d"]
    assert commit_state({n: rows(spark, "one", n) for n in names}, root, "1") == names
    before = current_versions(spark, root)
    broken = rows(spark, "two").withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        commit_state({**{n: rows(spark, "two", n) for n in names[:3]}, "d": broken}, root, "2")
    assert current_versions(spark, root) == before
    assert {r["v"] for n in names for r in read_state(spark, root, n, DDL).collect()} == {"one", *names}
    assert commit_state({n: rows(spark, "one" if n == "b" else "two", n) for n in names}, root, "2") == ["a", "c", "d"]
    assert current_versions(spark, root)[1]["b"] == before[1]["b"]
    assert {r["v"] for n in names for r in read_state(spark, root, n, DDL).collect()} == {"one", "two", *names}


def test_single_tables_and_missing_state(spark, tmp_path):
    root = str(tmp_path / "state")
    assert read_state(spark, root, "a", DDL).collect() == [] and current_versions(spark, root) == (-1, {})
    assert write_state(rows(spark, "x"), root, "a", "1") and not write_state(rows(spark, "x"), root, "a", "2")
    assert write_state(rows(spark), root, "b", "2") and read_state(spark, root, "b", DDL).collect() == []
    assert [r["v"] for r in read_state(spark, root, "a", DDL).collect()] == ["x"]


def serial_status(events):
    out = {}
    for email, _, action, at, expires in sorted(events, key=lambda e: (e[3], e[1])):
        status, until, changes, _ = out.get(email, (None, None, 0, None))
        lapsed = until is None or until < at
        if action == "subscribe" and (status in (None, "unsubscribed") or (status == "pending" and lapsed)):
            status, until, changes = "pending", expires, changes + 1
        elif action == "confirm" and status == "pending" and not lapsed:
            status, changes = "confirmed", changes + 1
        elif action == "unsubscribe" and status not in (None, "unsubscribed"):
            status, changes = "unsubscribed", changes + 1
        out[email] = (status, until, changes, at)
    return {k: (at, status, changes) for k, (status, _, changes, at) in out.items() if status is not None}


@pytest.mark.parametrize("slice_rows", [2, 7, 10_000])
def test_subscriptions_fold_alike_in_slices_of_any_size(spark, slice_rows):
    rnd = random.Random(slice_rows)
    events = []
    for k in range(260):
        email = "hot" if k % 2 else f"a{rnd.randrange(12)}"
        events.append((email, f"e{k:04d}", rnd.choice(["subscribe", "confirm", "confirm", "unsubscribe"]), rnd.randrange(400), rnd.randrange(500)))
    # A pending request that lapses only many slices later.
    events += [("slow", "s0", "subscribe", 0, 900), *[("slow", f"s{i:03d}", "subscribe", i, 5) for i in range(1, 40)], ("slow", "s99", "confirm", 899, 0)]
    df = spark.createDataFrame(events, "email string, event_id string, action string, at bigint, expires bigint").repartition(5)
    got = {r["email"]: (r["at"], r["status"], r["changes"]) for r in subscription_status(df, slice_rows).collect()}
    assert got == serial_status(events)
