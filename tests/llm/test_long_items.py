import random

import pytest
from llm_helpers import docs_frame, prose, words
from listwright.llm import decontaminate


@pytest.mark.parametrize("kind", ["insert", "delete", "mixed"])
def test_long_items_with_many_edits_and_several_places(spark, kind):
    rnd = random.Random(4)
    items = [(k, " ".join(words(rnd, 300))) for k in range(6)]
    rows = []
    for k, item in items:
        w = item.split(" ")
        for at in sorted(rnd.sample(range(300), 60), reverse=True):
            how = rnd.choice(["insert", "delete"]) if kind == "mixed" else kind
            w[at : at + (how == "delete")] = words(rnd, 1) if how == "insert" else []
        rows.append((k, f"{prose(rnd, 50)} {' '.join(w)} {prose(rnd, 50)}"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminated(spark, docs_frame(spark, rows), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in sorted(got)] == [(k, k) for k in range(6)]
    assert decontaminate.without_contaminated(spark, docs_frame(spark, rows), bench).count() == 0


def test_every_place_of_an_item_is_a_row(spark):
    rnd = random.Random(5)
    item = " ".join(words(rnd, 20))
    near = item.split(" ")
    near[7] = "other"
    text = " ".join([item, *near, item, *words(rnd, 3), item, *words(rnd, 200), item])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = decontaminate.contaminated(spark, docs_frame(spark, [(1, text)]), bench).orderBy("start").collect()
    assert [r["edits"] for r in got] == [0, 1, 0, 0, 0]
    assert [text[r["start"] : r["start"] + r["length"]] for r in got] == [item, " ".join(near), item, item, item]
