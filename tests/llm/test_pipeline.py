"""The pipeline's stages, each on the rows that its predecessor kept."""

import random

import corpus_pipeline
from llm_helpers import prose
from listwright.llm import decontaminate, lines, toxicity


def test_pipeline(spark, tmp_path):
    rnd = random.Random(11)
    item = prose(rnd, 30)
    copies = prose(rnd, 100)
    rows = [(k, prose(rnd, 80) + "\nSubscribe to our paper right now", "en", "s") for k in range(60)]
    rows += [(100 + k, copies + " " + prose(rnd, 4), "en", "s") for k in range(4)]
    rows += [(200 + k, f"{prose(rnd, 40)} {item} {prose(rnd, 40)}", "en", "s") for k in range(3)]
    rows += [(300 + k, f"{prose(rnd, 40)} zuzu {prose(rnd, 20)}", "en", "s") for k in range(60)]
    rows += [(400, None, None, None), (401, "", "en", "s")]
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    docs = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 0, int(300 <= i < 400)) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = stage["toxicity"](spark, docs, sf)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows if not 300 <= i < 400}
    shorter = stage["line_dedup"](spark, docs, sf)
    assert shorter.columns == docs.columns and shorter.count() == docs.count()
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in shorter.collect()}
    assert text[0] == (rows[0][1], len(rows[0][1])) and all("Subscribe" not in text[k][0] for k in range(1, 60))
    assert all(t is None or n == len(t) for t, n in text.values())
    one = {r["doc_id"] for r in stage["near_dedup"](spark, docs, sf).collect()}
    assert one == {i for i, *_ in rows} - {101, 102, 103}
    clean = {r["doc_id"] for r in stage["decontamination"](spark, docs, sf).collect()}
    assert clean == {i for i, *_ in rows} - {200, 201, 202}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == {i for i, *_ in rows if not 300 <= i < 400} - {101, 102, 103, 200, 201, 202}
    assert toxicity and lines and decontaminate
