"""Recall of the random walks at every length of an item, and what they tell apart."""

import numpy as np
import pytest
from listwright.llm import decontaminate as d
from listwright.llm.words import mix

POOL = mix(np.arange(1, 5001, dtype=np.uint64), 3)


def items_of(n, s=d.Settings()):
    """One item of n different words."""
    return d.Items([(1, " ".join(f"w{k}" for k in range(n)))], s, d.embedding_counts([(1, "w " * n)], s))


def words_of(n):
    memo = d.BareWordHashes()
    return memo.of([f"w{k}".encode() for k in range(n)])


@pytest.mark.parametrize("n", [8, 14, 25, 40, 59, 64, 65, 100, 128, 150, 300])
@pytest.mark.parametrize("kind", d.KINDS)
def test_passages_at_the_bound_of_edits_are_met(n, kind):
    rng = np.random.default_rng((n, d.KINDS.index(kind)))
    items, item, most = items_of(n), words_of(n), int(n * 0.2)
    missed = 0
    for _ in range(60):
        passage = d.edited(rng, item, most, kind, POOL)
        text = np.concatenate((rng.choice(POOL, 70), passage, rng.choice(POOL, 70)))
        # What lies within the bound by brute force must come out, and nothing else can.
        assert d.distances(item, text, True).min() <= most
        got = items.matches(text)
        missed += not got
        assert all(edits <= most for _, edits, _, _ in got)
    assert missed <= 3


@pytest.mark.parametrize("n", [8, 40, 64, 65, 300])
def test_exact_copies_are_always_met_and_other_text_never(n):
    rng = np.random.default_rng(n)
    items, item = items_of(n), words_of(n)
    for at in (0, 1, 50):
        text = np.concatenate((rng.choice(POOL, at), item, rng.choice(POOL, 50 - at)))
        assert items.matches(text) == [(0, 0, at, at + n)]
        assert items.matches(rng.permutation(text)) == [] and items.matches(text[: at + n // 2]) == []


def test_walks_turn_few_edits_into_few_different_places():
    rng = np.random.default_rng(1)
    near, far = [], []
    for e in range(40):
        item = rng.choice(POOL, 40, replace=False)
        texts = [item, d.edited(rng, item, 1, "delete", POOL), rng.choice(POOL, 40)]
        a, b, c = (d.walk(t, np.zeros(1, dtype=np.intp), 40, e)[0] for t in texts)
        near.append((a != b).mean())
        far.append((a != c).mean())
    assert np.mean(near) < 0.3 and np.mean(far) > 0.9


def test_where_no_number_of_embeddings_will_do_every_place_is_compared():
    s = d.Settings(most_embeddings=1, tables=1, sampled=8)
    assert d.embeddings_for(40, 8, s) is None
    rng, item = np.random.default_rng(2), words_of(40)
    items = items_of(40, s)
    for _ in range(30):
        text = np.concatenate((rng.choice(POOL, 20), d.edited(rng, item, 8, "mixed", POOL), rng.choice(POOL, 20)))
        assert items.matches(text)
