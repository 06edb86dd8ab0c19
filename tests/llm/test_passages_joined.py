import random

import numpy as np
import pytest

from llm_helpers import words
from listwright.llm import passages
from listwright.llm.links import components
from listwright.llm.words import fold

ODD = ["", " ", "a b", "w " * 40, "  x\n" * 30, "q " * 25, "q " * 24, "é ü " * 30, "one two three four five"]


def powers():
    return passages.Powers(passages.BASE), passages.Powers(passages.INVERSE)


def alone(raw, s):
    begin, close = passages.word_spans(raw)
    if len(begin) < s.words:
        return []
    shingles = passages.hashes_of(passages.word_hashes(raw, begin, close, *powers()), s)
    return passages.distinct(shingles[passages.chosen_places(shingles, s)]).tolist()


@pytest.mark.parametrize("s", [passages.Settings(), passages.Settings(words=8, percent=100), passages.Settings(words=30, shingle=2, percent=50)])
def test_texts_hashed_as_one_are_as_alone(s, monkeypatch):
    rnd = random.Random(21)
    texts = [fold(x) for x in [*ODD, *(" ".join(words(rnd, rnd.randrange(90))) for _ in range(200))]]
    rnd.shuffle(texts)
    want = [alone(x, s) for x in texts]
    calls, hashed = [], passages.word_hashes
    monkeypatch.setattr(passages, "word_hashes", lambda *x: calls.append(1) or hashed(*x))
    at, found = passages.chosen_of(texts, s, powers())
    # Two hundred texts took as many calls before.
    assert len(calls) == 1
    got = [found[at == k].tolist() for k in range(len(texts))]
    assert got == want and any(got)


def test_pieces_hold_every_text_once_and_few_bytes():
    sizes = [0, 5, 7, 30, 1, 1, 1, 0, 9]
    parts = passages.pieces(sizes, 10)
    assert [k for low, high in parts for k in range(low, high)] == list(range(len(sizes)))
    assert all(high - low == 1 or sum(sizes[low:high]) <= 10 for low, high in parts)
    assert passages.pieces([]) == [(0, 0)] and not len(passages.chosen_of([], passages.Settings(), powers())[0])


def test_new_links_join_components_as_all_links_do(spark):
    rnd = np.random.default_rng(22)
    pairs = [sorted(map(int, rnd.choice(400, 2, replace=False) - 200)) for _ in range(260)]
    old, new = (spark.createDataFrame(x, "a long, b long") for x in (pairs[:200], pairs[200:]))
    want = {(r.node, r.component) for r in components(old.unionByName(new)).collect()}
    for found, links in ((components(old), new), (None, old.unionByName(new))):
        assert {(r.node, r.component) for r in passages.joined_components(found, links).collect()} == want
