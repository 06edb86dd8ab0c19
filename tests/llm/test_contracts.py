"""op5 and op6 where rows repeat across files and where vectors have several widths."""

import random

import numpy as np

from listwright.llm import hamming, warc


def test_one_response_for_equal_rows_of_different_files(spark, tmp_path):
    kind = "page_id bigint, url string, html string"
    same, other = (1, "u", "<p>same</p>"), (2, "v", "<p>same</p>")
    for k, rows in enumerate([[same, other], [same, (3, "w", "x")], [same, same, (None, None, "x")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    for threshold in ("-1", "10m"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.archive_and_read(spark, pages).collect())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert got == [(0, "revisit", 3), (1, "response", None), *[(1, "revisit", 1)] * 3, (2, "revisit", 1), (3, "response", None)]


def test_vectors_of_every_width_are_linked_within_it(spark):
    rng, rnd = np.random.default_rng(4), random.Random(4)
    rows = [(k, rng.standard_normal(64).tolist()) for k in range(60)]
    rows += [(100, rows[5][1]), (101, [1.0, 2.0]), (102, [2.0, 4.0]), (103, [-1.0, 2.0]), (104, [3.0]), (105, [9.0]), (106, [1.0, 2.0, 0.0]), (107, [])]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hamming.near_vectors(spark, table).collect()}
    linked = {5: (1, 5), 100: (1, 5), 101: (1, 101), 102: (1, 101), 104: (1, 104), 105: (1, 104)}
    assert got == {k: linked.get(k, (0, k)) for k, _ in rows}
