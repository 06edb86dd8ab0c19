"""Joins of stored rows: the planner sees small files, yet nothing that grows with the input goes through the driver."""

import pytest
from helpers import brute_greedy
from pyspark.sql import functions as F

from listwright.operators import components, matching
from listwright.session import cut


@pytest.fixture(scope="module")
def stored(spark):
    keys = F.array(F.concat(F.lit("a"), F.col("id") % 40), F.concat(F.lit("b"), "id"))
    rows = spark.range(200).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), keys.alias("keys"))
    return cut(rows, "stored")


def joins(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["first_match", "minus_ids", "minus_keys", "shared_pairs"])
def test_rows_are_not_broadcast(stored, how):
    half = stored.filter("ord < 50")
    made = {
        "first_match": lambda: matching.first_match(stored, half.withColumn("old", F.col("ord")), "ord", "old", "old"),
        "minus_ids": lambda: matching.minus_ids(stored, half),
        "minus_keys": lambda: matching.minus_keys(stored, half, "ord"),
        "shared_pairs": lambda: components.shared_pairs(matching.exploded(stored, "ord")),
    }[how]()
    plan = joins(made)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_results_stay(stored):
    half = stored.filter("ord < 50")
    assert matching.minus_ids(stored, half).count() == 150
    assert matching.minus_keys(stored, half, "ord").count() == 0
    first = matching.first_match(stored, half.withColumn("old", F.col("ord")), "ord", "old", "old")
    assert all(r.match_id == r.ord % 40 for r in first.collect())


def test_steps_of_a_greedy_match_get_a_share_of_the_old_rows(spark, monkeypatch):
    fresh = [(i, {"a"} if i < 60 else {"b"}) for i in range(70)]
    old = [(i, {"a", "b"}) for i in range(80)] + [(i, {"b"}) for i in range(80, 300)]
    sides = [spark.createDataFrame([(n, sorted(k)) for n, k in side], "ord long, keys array<string>") for side in (fresh, old)]
    given, write = [], matching.cut

    def spy(df, label="cut"):
        kept = write(df, label)
        if label == "near":
            given.append(kept.count())
        return kept

    monkeypatch.setattr(matching, "cut", spy)
    got = matching.greedy_match(*sides, "ord", "ord", 3, 35)
    assert {(r.fresh_ord, r.old_ord) for r in got.collect()} == brute_greedy(fresh, old)
    # Two keys are asked for at most twice the chunk's rows each, of 380 old rows with their keys.
    assert given and max(given) <= 2 * 35 + 2 * 16
