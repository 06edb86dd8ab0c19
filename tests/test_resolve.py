import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import as_dict, brute_greedy, brute_resolve, record, records
from listwright.operators import matching
from listwright.operators.resolve import group_rows, merge_group, resolve

AUTHORITIES = [
    "official_ats", "official_programme_page", "official_careers_page", "trusted_sector_board", "discovery_only_source",
]


def random_rows(seed: int, n: int = 60, hot: bool = False) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = f"https://x.test/{rng.randrange(3 if hot else n // 2)}"
        rows.append(
            record(
                ord=i * 3 + 1,
                id=f"r{i}",
                source_registry_id=f"s{rng.randrange(4)}",
                source_identifier=str(rng.randrange(n if hot else n // 2)),
                canonical_employer=rng.choice(["Acme", "Bolt", "Crux"]),
                title=rng.choice(["Analyst", "Clerk", "Tutor"]) + ("" if hot else str(rng.randrange(8))),
                application_url=url,
                canonical_url=f"https://y.test/{rng.randrange(n)}",
                all_source_urls=[url, f"https://z.test/{rng.randrange(6)}"],
                secondary_tags=rng.sample(["a", "b", "c", "d"], 2),
                eligibility_evidence=[
                    {"rule_id": f"e{rng.randrange(4)}", "text": "t", "source_url": "u", "structured_field": None}
                    for _ in range(2)
                ],
                source_authority=rng.choice(AUTHORITIES),
                division=rng.choice([None, None, "", "North", "South"]),
                named_office_or_mp=rng.choice([None, None, None, "Office A", "Office B"]),
                programme_start=rng.choice([None, None, dt.date(2027, 6, 1), dt.date(2027, 7, 1)]),
                location=rng.choice(["London", "Westminster, London", "Leeds", "Bath"]),
                location_type=rng.choice(["onsite", "onsite", "multi_location"]),
                listing_publisher=rng.choice([None, "", f"p{i}"]),
                application_method=rng.choice([None, f"m{i}"]),
                first_seen_at=dt.datetime(2026, 8, 1) + dt.timedelta(hours=rng.randrange(400)),
                last_seen_at=dt.datetime(2026, 8, 20) + dt.timedelta(hours=rng.randrange(40)),
            )
        )
    return rows


def comparable(rows: list[dict]) -> list[tuple]:
    return sorted(
        (
            r["ord"], r["id"], r["all_source_urls"], r["secondary_tags"],
            [e["rule_id"] for e in r["eligibility_evidence"]], r["first_seen_at"], r["last_seen_at"],
            r["listing_publisher"] or None, r["division"] or None, r["application_method"],
        )
        for r in rows
    )


@pytest.mark.parametrize("seed,hot,n", [(1, False, 40), (2, True, 14)])
def test_resolve_equals_row_by_row_greedy(spark, seed, hot, n):
    rows = random_rows(seed, n, hot=hot)
    df = records(spark, rows)
    keys = {r["ord"]: set(r["k"]) for r in df.select("ord", matching.match_keys().alias("k")).collect()}
    expected = comparable(brute_resolve(rows, keys))
    got = comparable([as_dict(r) for r in resolve(df).collect()])
    assert got == expected


def test_large_calm_component_needs_no_fold(spark):
    rng = random.Random(9)
    rows = [
        record(
            ord=i, id=f"r{i}", source_identifier=str(i), title=f"T{i}", location=rng.choice(["London", "Westminster"]),
            canonical_url=f"https://y.test/{i}", source_authority=rng.choice(AUTHORITIES),
            all_source_urls=[f"https://z.test/{rng.randrange(9)}"], secondary_tags=[rng.choice("abc")],
            eligibility_evidence=[
                {"rule_id": f"e{rng.randrange(3)}", "text": "t", "source_url": "u", "structured_field": None}
            ],
        )
        for i in range(40)
    ]
    df = records(spark, rows)
    keys = {r["ord"]: set(r["k"]) for r in df.select("ord", matching.match_keys().alias("k")).collect()}
    expected = comparable(brute_resolve(rows, keys))
    assert len(expected) == 1
    assert comparable([as_dict(r) for r in resolve(df).collect()]) == expected


def key_table(spark, side):
    return spark.createDataFrame([(n, sorted(k)) for n, k in side], "ord long, keys array<string>")


@pytest.mark.parametrize("seed,hot,limit,chunk", [(1, False, 1000, 100), (2, True, 3, 13)])
def test_greedy_match_equals_serial_choice(spark, seed, hot, limit, chunk):
    rng = random.Random(seed)
    pool = [f"k{i}" for i in range(5 if hot else 30)]
    fresh = [(i, set(rng.sample(pool, rng.randrange(1, 3)))) for i in range(25)]
    old = [(i, set(rng.sample(pool, rng.randrange(1, 3)))) for i in range(30)]
    got = matching.greedy_match(key_table(spark, fresh), key_table(spark, old), "ord", "ord", limit, chunk)
    assert {(r.fresh_ord, r.old_ord) for r in got.collect()} == brute_greedy(fresh, old)


def test_greedy_match_pairs_ranks_when_all_share_one_key(spark):
    fresh = [(i * 2, {"hot", f"f{i}"}) for i in range(40)]
    old = [(i * 5, {"hot", f"o{i}"}) for i in range(25)]
    got = matching.greedy_match(key_table(spark, fresh), key_table(spark, old), "ord", "ord", 4, 6)
    assert {(r.fresh_ord, r.old_ord) for r in got.collect()} == brute_greedy(fresh, old)


def test_first_match_takes_least_order_over_all_keys(spark):
    left = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("c", ["q"])], "id string, keys array<string>")
    right = spark.createDataFrame(
        [("p", 3, ["x"]), ("q", 1, ["y", "z"]), ("r", 2, ["z"])], "rid string, o int, keys array<string>"
    )
    got = {r.id: r.match_id for r in matching.first_match(left, right, "id", "rid", "o").collect()}
    assert got == {"a": "q", "b": "q"}


def test_minus_keys_and_scope(spark):
    a = spark.createDataFrame(
        [("a", "s1", ["x"]), ("b", "s2", ["x"]), ("c", "s1", ["n"])], "id string, source_registry_id string, keys array<string>"
    )
    b = spark.createDataFrame([("s1", ["x"])], "source_registry_id string, keys array<string>")
    assert {r.id for r in matching.minus_keys(a, b, "id").collect()} == {"c"}
    assert {r.id for r in matching.not_fetched_now(a, b, "id").collect()} == {"b", "c"}


def test_same_application_link_with_tracking_is_one_record(spark):
    rows = [
        record(ord=1, id="a", source_identifier="1", application_url="https://a.test/j?utm_source=x", title="One"),
        record(ord=2, id="b", source_identifier="2", application_url="https://a.test/j?ref=y", title="Two"),
        record(ord=3, id="c", source_identifier="3", application_url="https://a.test/k", title="Three", canonical_url="https://o.test"),
    ]
    for i, row in enumerate(rows):
        row["canonical_url"] = f"https://o.test/{i}"
    got = resolve(records(spark, rows))
    assert {r.ord for r in got.select("ord").collect()} == {1, 3}
    assert merge_group is not None and group_rows is not None and F is not None
