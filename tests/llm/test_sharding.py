"""op13: the greedy placement against fractions, and the law, the slots and the groups of whole tables."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from llm_helpers import awkward, docs_frame, prose
from pyspark.sql import functions as F

from listwright.llm import sharding


def brute_place(weights, shards):
    totals = [max(1, sum(w)) for w in zip(*weights)]
    share = [[Fraction(w * shards, t) for w, t in zip(row, totals)] for row in weights]
    left = [[Fraction(1)] * len(totals) for _ in range(shards)]
    out = {}
    for k in sorted(range(len(share)), key=lambda k: (-max(share[k]), -sum(share[k]), k)):
        fits = [s for s in range(shards) if all(r >= v for r, v in zip(left[s], share[k]))]
        best = max(fits or range(shards), key=lambda s: (sum(r * v for r, v in zip(left[s], share[k])), -s))
        left[best] = [r - v for r, v in zip(left[best], share[k])]
        out[k] = best
    return [out[k] for k in range(len(share))]


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_placement(shards):
    rnd = random.Random(shards)
    # Powers of two keep floating point exact.
    weights = [[1, 2 ** rnd.randrange(8), 2 ** rnd.randrange(5)] for _ in range(63)]
    weights.append([64 - 63, 2 ** 13 - sum(w[1] for w in weights), 2 ** 10 - sum(w[2] for w in weights)])
    assert min(weights[-1]) > 0
    assert sharding.place(np.array(weights, dtype=float), shards).tolist() == brute_place(weights, shards)


def held(rows, shards):
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    return [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)], Counter(r["shard"] for r in rows)


@pytest.mark.parametrize("part_items,slice_rows", [(20_000, 100_000), (40, 16)])
def test_law_slots_and_groups(spark, tmp_path, monkeypatch, part_items, slice_rows):
    monkeypatch.setattr(sharding, "PART_ITEMS", part_items)
    monkeypatch.setattr(sharding, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(sharding, "FAN", 4)
    rnd = random.Random(8)
    hot = prose(rnd, 20)
    docs = [(k, prose(rnd, rnd.randrange(1, 60))) for k in range(700)] + [(1000 + k, hot) for k in range(350)]
    pairs = [(2000 + k, docs[k][1]) for k in range(100)]
    frame = docs_frame(spark, docs + pairs).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(None).cast("string"))
    got = sharding.write_shards(spark, frame.repartition(6), str(tmp_path / "files"), shards=4)
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(docs + pairs)
    sizes, counts = held(rows, 4)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 4
    assert max(counts.values()) - min(counts.values()) < 0.03 * len(rows) / 4
    where, words = defaultdict(set), sum(len(t.split()) for _, t in docs + pairs)
    for r in rows:
        where[r["text"]].add(r["shard"])
    copies = Counter(r["text"] for r in rows)
    small = [t for t, n in copies.items() if n * (len(t) + 1) <= sum(sizes) / 256 and n * len(t.split()) <= words / 256 and n <= len(rows) / 256]
    assert len(small) > 200 and all(len(where[t]) == 1 for t in small) and len(where[hot]) == 4
    assert {f"shard={s}" for s in range(4)} <= {p.name for p in (tmp_path / "files").iterdir()}


def test_awkward_rows(spark):
    docs = awkward(random.Random(2)) + [(None, None)] * 50
    rows = sharding.shard_documents(spark, docs_frame(spark, docs)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(docs)
    _, counts = held(rows, 16)
    assert set(counts) <= set(range(16))


def test_empty_table_and_texts(spark):
    empty = sharding.shard_documents(spark, docs_frame(spark, []))
    assert empty.collect() == [] and {"shard", "slot", "size", "law"} <= set(empty.columns)
    rows = sharding.shard_documents(spark, docs_frame(spark, [(k, "") for k in range(40)]), shards=4).collect()
    sizes, counts = held(rows, 4)
    assert len(rows) == 40 and sum(sizes) == 40


def test_results_do_not_depend_on_partitions(spark, tmp_path):
    docs = [(k, prose(random.Random(k), k % 23)) for k in range(300)]
    docs_frame(spark, docs).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    found = []
    for partitions in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append(sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(spark, stored, 5).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
