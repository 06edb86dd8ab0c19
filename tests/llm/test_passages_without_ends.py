import random

from llm_helpers import docs_frame, words
from listwright.llm import passages


def test_passages_inside_text_without_sentence_ends(spark):
    rnd = random.Random(10)
    rows, n = [], 100
    for k in range(n):
        copy = " ".join(words(rnd, 50))
        rows.append((2 * k, f"{' '.join(words(rnd, 150))} {copy} {' '.join(words(rnd, 150))}"))
        rows.append((2 * k + 1, f"{' '.join(words(rnd, 30))}.\n{copy}\n{' '.join(words(rnd, 30))}." if k % 2 else f"{' '.join(words(rnd, 170))} {copy} {' '.join(words(rnd, 90))}"))
    texts = dict(rows)
    got = passages.repeated_passages(spark, docs_frame(spark, rows)).collect()
    assert len({r["doc_id"] for r in got}) >= 0.99 * 2 * n
    for r in got:
        part = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part.split()) == r["n_words"] >= 25
