import random
from pathlib import Path

import numpy as np

from llm_helpers import docs_frame, words
from listwright.llm import passages
from listwright.session import shared_dir


def test_sets_and_places_go_when_nothing_reads_them(spark):
    rnd = random.Random(11)
    copy = " ".join(words(rnd, 40))
    rows = [(k, f"{' '.join(words(rnd, 40))}.\n{copy}.\n{' '.join(words(rnd, 40))}.") for k in range(6)]
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("passages-*"))
    assert len({r["doc_id"] for r in passages.repeated_passages(spark, docs_frame(spark, rows)).collect()}) == 6
    (made,) = set(folder.glob("passages-*")) - before
    left = {p.name.split("-")[0] for p in made.iterdir() if any(p.iterdir())}
    assert not left & {"chosen", "repeats", "texts", "nodes", "paragraphs", "shared", "labelled", "members"}


def test_marks_never_differ_in_more_bins_than_sets_in_items():
    rnd = np.random.default_rng(12)
    for size in (21, 60, 400):
        one = np.unique(rnd.integers(0, 1 << 32, size, dtype=np.uint32))
        other = np.unique(np.concatenate((one[: size - size // 8], rnd.integers(0, 1 << 32, size // 8, dtype=np.uint32))))
        (even, odd) = passages.parities(np.concatenate((one, other)), np.array([0, len(one)]))
        bins = sum(int(x[0] ^ x[1]).bit_count() if x[0] ^ x[1] >= 0 else 64 - int(~(x[0] ^ x[1])).bit_count() for x in (even, odd))
        assert 0 < bins <= len(np.setxor1d(one, other))


def test_word_hash_depends_on_the_word_alone():
    up, down = passages.Powers(passages.BASE), passages.Powers(passages.INVERSE)
    raw = b"ab ba  ab\naab b a ba\xc3\xa9 ba\xc3\xa9"
    got = passages.word_hashes(raw, *passages.word_spans(raw), up, down).tolist()
    named = dict(zip(raw.split(), got))
    assert [named[w] for w in raw.split()] == got and len(set(got)) == len(set(raw.split()))
