"""Rounds of the one-to-one match follow the largest component, and its graph has no edge for rows of one key."""

import random

import pytest
from helpers import brute_greedy

from listwright.operators import components, matching


def sides_of(spark, fresh, old):
    return [spark.createDataFrame([(n, sorted(k)) for n, k in side], "ord long, keys array<string>") for side in (fresh, old)]


def side(rng, n):
    """Rows of four components, each with two common keys and keys of its own."""
    return [(i, {f"p{i % 4}{rng.randrange(2)}", f"c{i % 4}{rng.randrange(6)}"}) for i in range(n)]


@pytest.fixture
def written(monkeypatch):
    seen = []
    for module in (matching, components):
        monkeypatch.setattr(module, "cut", lambda df, label="cut", write=module.cut: seen.append((label, write(df, label))) or seen[-1][1])
    return lambda label: [df for name, df in seen if name == label]


def test_components_take_their_chunks_side_by_side(spark, written):
    rng = random.Random(4)
    fresh, old = side(rng, 80), side(rng, 96)
    got = matching.greedy_match(*sides_of(spark, fresh, old), "ord", "ord", 3, 8)
    assert {(r.fresh_ord, r.old_ord) for r in got.collect()} == brute_greedy(fresh, old)
    # Each component's twenty fresh rows go four by four in five rounds, or in a few more; in one order they took twenty.
    assert 0 < len(written("step")) < 12


def test_components_of_a_few_chunks_are_settled_whole(spark, written):
    rng = random.Random(5)
    fresh, old = side(rng, 40), side(rng, 48)
    got = matching.greedy_match(*sides_of(spark, fresh, old), "ord", "ord", 3, 10)
    assert {(r.fresh_ord, r.old_ord) for r in got.collect()} == brute_greedy(fresh, old)
    assert not written("step")


def test_rows_that_come_twice_or_have_no_number_change_nothing(spark):
    rng = random.Random(6)
    fresh, old = side(rng, 20), side(rng, 24)
    frames = [df.unionByName(df).unionByName(spark.createDataFrame([(None, ["p00", "c00"])], df.schema)) for df in sides_of(spark, fresh, old)]
    for limits in ((1000, 100), (3, 2)):
        got = matching.greedy_match(*frames, "ord", "ord", *limits)
        assert {(r.fresh_ord, r.old_ord) for r in got.collect()} == brute_greedy(fresh, old)


def test_rows_of_one_key_make_no_edge(spark, written):
    fresh, old = [(i, {f"k{i % 3}"}) for i in range(60)], [(i, {f"k{i % 3}"}) for i in range(60)]
    got = matching.greedy_match(*sides_of(spark, fresh, old), "ord", "ord")
    assert {(r.fresh_ord, r.old_ord) for r in got.collect()} == brute_greedy(fresh, old)
    assert sum(df.count() for df in written("edges")) == 0
