"""op12 against plain loops over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from listwright.llm.centroids import build_tree, cluster_vectors, nearest, squares

SHAPE = "vec_id bigint, embedding array<double>, label int, cluster string, distance string, id string, vector int, inertia int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "d", "i", 1, 2) for i, v in rows], SHAPE)


def brute(rows, dims, clusters, rounds, seed=2, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]

    def hashed(row):
        return hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]

    centroids = [v for _, v in sorted(kept, key=hashed)[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    total = sum(d for d, _ in found)
    return sorted(
        (-1 if i is None else i, k, d, sum(e for e, c in found if c == k), total, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())
        for (i, _), (d, k) in zip(kept, found)
    )


def result(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                  for r in df.collect())


@pytest.mark.parametrize("dims,clusters", [(64, 40), (3, 9), (1, 5)])
def test_tree_finds_the_nearest(dims, clusters):
    rng = np.random.default_rng(dims)
    centroids = rng.integers(-6, 7, (clusters, dims))
    centroids[clusters // 2] = centroids[0]
    vectors = np.vstack([rng.integers(-6, 7, (700, dims)), centroids])
    away = squares(vectors, centroids)
    number, distance = nearest(build_tree(centroids), vectors)
    assert (number == away.argmin(axis=1)).all() and (distance == away.min(axis=1)).all()


@pytest.mark.parametrize("dims,clusters,rounds", [(6, 7, 5), (2, 12, 3), (3, 4, 0)])
def test_against_plain_loops(spark, dims, clusters, rounds):
    rnd = random.Random(dims)
    rows = [(k, [rnd.choice([-1, 1]) * rnd.randrange(0, 40) / 64 for _ in range(dims)]) for k in range(300)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (400, None), (401, []), (402, [0.1] * (dims + 1)), (403, [None] + [0.0] * (dims - 1)),
             (404, [float("nan")] * dims), (405, [float("-inf")] + [0.0] * (dims - 1)), (406, [-0.001] * dims)]
    rows += [(500 + k, rows[3][1]) for k in range(200)]
    got = cluster_vectors(spark, frame(spark, rows).repartition(7), dims=dims, clusters=clusters, rounds=rounds)
    assert result(got) == brute(rows, dims, clusters, rounds)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-0.5, 0.0])]
    assert result(cluster_vectors(spark, frame(spark, rows), dims=2)) == brute(rows, 2, 40, 5)
    for none in ([], [(1, None)]):
        got = cluster_vectors(spark, frame(spark, none), dims=2)
        assert got.collect() == [] and {"vec_id", "cluster", "distance", "inertia"} <= set(got.columns)


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        cluster_vectors(spark, frame(spark, [(1, [1e9, 0.0])]), dims=2)
