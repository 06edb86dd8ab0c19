"""Keys and tiers are made once in a scan and go on with their rows; classification is dealt to every core."""

import pytest
from helpers import records
from pyspark.sql import functions as F

from listwright.operators import matching
from listwright.operators.classify import with_possible
from listwright.operators.resolve import resolve
from listwright.plans import scan
from listwright.rules import default_rules

ROWS = [
    {"ord": 0, "id": "a", "source_identifier": "1", "title": "Policy intern", "application_url": "https://x.example.com/1"},
    {"ord": 1, "id": "b", "source_identifier": "2", "title": "Policy intern", "application_url": "https://x.example.com/1", "division": "Health"},
    {"ord": 2, "id": "c", "source_identifier": "3", "title": "Research intern", "application_url": "https://x.example.com/3", "canonical_url": "https://x.example.com/c"},
]


@pytest.fixture(scope="module")
def rows(spark):
    return records(spark, ROWS).cache()


def test_keys_go_on_with_their_rows_and_follow_a_merge(rows):
    plain = {r["ord"]: r for r in resolve(rows).collect()}
    kept = resolve(matching.with_keys(rows))
    assert matching.with_keys(kept) is kept
    found = kept.withColumn("again", matching.lookup_keys()).collect()
    assert sorted(plain) == [0, 2] == sorted(r["ord"] for r in found)
    assert all(r["keys"] == r["again"] for r in found)
    assert all(r[n] == plain[r["ord"]][n] for r in found for n in rows.columns)
    # The merged row's division came from the other one.
    assert plain[0]["division"] == "Health"


def test_a_tier_that_is_there_is_not_made_again(rows):
    flagged = with_possible(rows, default_rules())
    assert with_possible(flagged, default_rules()) is flagged


def test_rows_to_classify_are_dealt_to_every_core(spark):
    raw = spark.range(40_000).select(
        F.lit("one").alias("source_id"), (F.col("id") / 64).cast("int").alias("page_no"), (F.col("id") % 64).cast("int").alias("position")
    ).coalesce(1)
    few, many = scan.spread_rows(raw, 40), scan.spread_rows(raw, 40_000 * 4)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == 16
    sizes = [r["n"] for r in few.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 2 * min(sizes)
