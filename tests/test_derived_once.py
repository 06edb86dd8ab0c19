"""Classified rows are costly: queries derive them once, and only the columns that something reads."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from listwright.operators import digest
from listwright.operators.phrases import barrier, with_hits

SF = "/root/testdata/sf0.001"


def classifies(df) -> bool:
    """Only the classification reads the labels."""
    return any(name.endswith("labels.parquet") for name in df.inputFiles())


def test_barrier_leaves_out_unread_columns_and_keeps_filters_above(spark):
    df = spark.range(5).withColumns({"plain": F.col("id") + 1, "costly": F.sha2(F.col("id").cast("string"), 256)})
    plan = barrier(df).filter("plain > 2").select("plain")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan
    assert "(plain" in plan and "((id" not in plan.split("Filter")[1].split("\n")[0]
    assert [r.plain for r in barrier(df).filter("plain > 2").orderBy("plain").collect()] == [3, 4, 5]


@pytest.mark.parametrize(
    "name", ["check_coverage", "digest_select", "sort_modes", "state_lookup", "check_boundary", "split_open_recent", "scan_metrics"]
)
def test_result_reads_derived_rows(spark, name):
    assert not classifies(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["sort_positions", "digest_id", "digest_state"])
def test_sorted_rows_are_derived_before_the_sort(spark, monkeypatch, name):
    kept, write = [], digest.cut

    def spy(df, label="cut"):
        kept.append((label, classifies(df)))
        return write(df, label)

    monkeypatch.setattr(digest, "cut", spy)
    entry.queries()[name](spark, SF)
    assert [again for label, again in kept if label == "sorted"] and not any(again for _, again in kept)


def test_hits_at_the_ends_and_next_to_blanks(spark):
    df = spark.createDataFrame([("of the end",), ("often the of",), ("",), (None,)], "t string")
    rows = with_hits(df, {"h": (F.col("t"), ["of", "of the", "the"])}).collect()
    assert [sorted(r.h) for r in rows] == [["of", "of the", "the"], ["of", "the"], [], []]


def test_pages_of_all_kinds_are_made_once(spark):
    read = entry.queries()["extract_all_kinds"](spark, SF).inputFiles()
    assert read and not any(name.startswith(f"file://{SF}") for name in read)


def test_spread_parts_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    from listwright.queries import base

    path = str(tmp_path / "one file")
    spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("h")).coalesce(1).write.parquet(path)
    monkeypatch.setattr(base, "PART_BYTES", 1 << 20, raising=False)
    parts = base.spread(spark.read.parquet(path))
    assert parts.rdd.getNumPartitions() >= 12 and parts.count() == 200_000


def test_approved_rows_are_derived_once(spark, monkeypatch):
    from listwright.queries import listings

    judged = []
    monkeypatch.setattr(listings.serving, "approve", lambda kept, rows, asked: judged.append((rows, asked)) or kept)
    entry.queries()["approve_requests"](spark, SF)
    assert not any(classifies(df) for df in judged[0])
