import random

from llm_helpers import docs_frame, words
from listwright.llm import passages


def test_no_short_copy_is_passed_over(spark):
    rnd = random.Random(8)
    rows, n = [], 150
    for k in range(n):
        copy = " ".join(words(rnd, 25))
        rows += [(2 * k + j, f"{' '.join(words(rnd, 40))}.\n{copy}.\n{' '.join(words(rnd, 40))}.") for j in range(2)]
    got = passages.repeated_passages(spark, docs_frame(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == set(range(2 * n))


def test_a_passage_twice_in_a_document_is_found_twice(spark):
    rnd = random.Random(9)
    copy = " ".join(words(rnd, 30)) + "."
    other = [" ".join(words(rnd, 60)) + "." for _ in range(3)]
    rows = [(1, f"{copy}\n{other[0]}\n{copy}\n{other[1]}"), (2, f"{other[2]}\n{copy}")]
    got = passages.repeated_passages(spark, docs_frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2]


def test_window_of_the_common_run():
    assert passages.Settings().window == 12
