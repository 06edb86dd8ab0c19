"""Centroid clustering in whole numbers: every vector finds its nearest centroid through a vantage-point tree.

Components become ``floor(scale * x)``, so distances, sums and centroids are exact integers and the result does not
depend on the order of rows, partitions or rounds of a retried task. The tree over the centroids is rebuilt each round
and sent to the tasks; it holds ``clusters`` times ``dims`` integers whatever the number of vectors. A task takes its
vectors through the tree best bound first, each with its own frontier: the node with the least bound is opened until
that bound exceeds the best distance. Bounds are distances of floating point, so a node is still opened when its bound
equals the radius or exceeds it by no more than rounding could explain; leaves are compared in integers, and of equal
distances the smaller centroid number wins. Tasks return sums per centroid, never vectors.

Edge cases: vectors that are null, of another width, or hold a null or a non-finite component are left out; repeated
rows count as often as they occur, and rows of equal hash and vector are interchangeable as first centroids; a null id
counts as an empty one in the hash. With fewer vectors than centroids each is a centroid; an empty table gives an empty
result. A component whose scaled size reaches 2**27 is an error: distances would no longer fit a long. Columns other
than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.storage import Scratch

C = F.col
#: Scaled components stay below this size, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: What rounding may add to a bound, as a share of it and in units of distance.
SLACK = 1e-9
#: Centroids of a leaf, and vectors that go through the tree together.
LEAF, TOGETHER = 4, 2048


@dataclass
class Tree:
    """Nodes of a vantage-point tree: a leaf lists centroids, another node its vantage point and two children."""

    centroids: np.ndarray
    leaves: list[np.ndarray | None] = field(default_factory=list)
    points: list[int] = field(default_factory=list)
    #: Per node: (child, least and greatest distance of the child's centroids from the vantage point).
    children: list[list[tuple[int, float, float]]] = field(default_factory=list)

    def add(self, members: np.ndarray) -> int:
        node = len(self.leaves)
        self.leaves.append(None)
        self.points.append(-1)
        self.children.append([])
        if len(members) <= LEAF:
            self.leaves[node] = members
            return node
        away = np.sqrt(squares(self.centroids[members], self.centroids[members]))
        at = int(np.argmax(away.var(axis=1)))
        rest, far = np.delete(members, at), np.delete(away[at], at)
        order = np.argsort(far, kind="stable")
        rest, far = rest[order], far[order]
        half = (len(rest) + 1) // 2
        self.points[node] = int(members[at])
        for low, high in ((0, half), (half, len(rest))):
            self.children[node].append((self.add(rest[low:high]), float(far[low]), float(far[high - 1])))
        return node


def squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``left`` to every row of ``right``."""
    out = np.empty((len(left), len(right)), dtype=np.int64)
    for k, row in enumerate(right):
        gap = left - row
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def build_tree(centroids: np.ndarray) -> Tree:
    tree = Tree(centroids)
    tree.add(np.arange(len(centroids)))
    return tree


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; the smaller number of equal ones."""
    best = np.full(len(vectors), np.iinfo(np.int64).max, dtype=np.int64)
    number = np.full(len(vectors), len(tree.centroids), dtype=np.int64)
    frontier = np.full((len(vectors), len(tree.leaves)), np.inf)
    frontier[:, 0] = 0.0
    every = np.arange(len(vectors))

    def offer(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        away = squares(vectors[rows], tree.centroids[centroids])
        for column, k in enumerate(centroids):
            d = away[:, column]
            better = (d < best[rows]) | ((d == best[rows]) & (k < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], k
        return away

    while True:
        node = frontier.argmin(axis=1)
        bound = frontier[every, node]
        open_now = np.flatnonzero(bound <= np.sqrt(best) * (1 + SLACK) + SLACK)
        if not len(open_now):
            return number, best
        node, bound = node[open_now], bound[open_now]
        frontier[open_now, node] = np.inf
        for u in np.unique(node):
            here = node == u
            rows, low = open_now[here], bound[here]
            if tree.leaves[u] is not None:
                offer(rows, tree.leaves[u])
                continue
            away = np.sqrt(offer(rows, np.array([tree.points[u]]))[:, 0])
            for child, least, most in tree.children[u]:
                frontier[rows, child] = np.maximum(low, np.maximum(away - most, least - away))


def scaled(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of every component, as rows of whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component times {scale} reaches {LARGEST}: squared distances would not fit a long")
    return x.astype(np.int64).reshape(-1, dims)


def usable(vector: Column, dims: int) -> Column:
    """True for vectors of exactly ``dims`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def first_centroids(kept: DataFrame, clusters: int, seed: int, dims: int, scale: int) -> np.ndarray:
    """The vectors of least hash of ``seed:id``, in that order: ``clusters`` rows, whatever the table's size."""
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(C("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select("vector", hashed.alias("hash")).orderBy("hash", "vector").limit(clusters).collect()
    flat = pa.array([row["vector"] for row in rows], pa.list_(pa.float64()))
    return scaled(flat, dims, scale)


def centroid_sums(kept: DataFrame, tree: Tree, dims: int, scale: int) -> list[tuple[int, int, list[int]]]:
    """``(cluster, vectors, component sums)`` of the clusters that have vectors: at most one row per centroid."""

    def run(batches):
        sums = np.zeros((len(tree.centroids), dims), dtype=np.int64)
        counts = np.zeros(len(tree.centroids), dtype=np.int64)
        for batch in batches:
            vectors = scaled(batch.column("vector"), dims, scale)
            for low in range(0, len(vectors), TOGETHER):
                part = vectors[low : low + TOGETHER]
                cluster, _ = nearest(tree, part)
                for k in np.unique(cluster):
                    sums[k] += part[cluster == k].sum(axis=0)
                counts += np.bincount(cluster, minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    parts = kept.select("vector").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(C("sums")[i]).alias(f"s{i}") for i in range(dims)])
    return [(row["cluster"], row["n"], list(row[2:])) for row in added.collect()]


def assigned(kept: DataFrame, tree: Tree, dims: int, scale: int) -> DataFrame:
    """``(id, cluster, distance)`` of every vector."""

    def run(batches):
        for batch in batches:
            vectors = scaled(batch.column("vector"), dims, scale)
            found = [nearest(tree, vectors[low : low + TOGETHER]) for low in range(0, len(vectors), TOGETHER)]
            numbers, distances = zip(*found) if found else ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.concatenate(numbers).astype(np.int32)), pa.array(np.concatenate(distances))],
                ["id", "cluster", "distance"],
            )

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def cluster_vectors(
    spark: SparkSession, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
    dims: int = 64, clusters: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256,
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid)`` of every usable vector.

    ``rounds`` times every vector goes to its nearest centroid and centroids become the floor of the mean of their
    vectors (those without vectors stay); then vectors are assigned once more.
    """
    kept = vectors.filter(usable(C(vector), dims)).select(C(vec_id).alias("id"), C(vector).alias("vector"))
    centroids = first_centroids(kept, clusters, seed, dims, scale)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for cluster, n, sums in centroid_sums(kept, build_tree(centroids), dims, scale):
            moved[cluster] = [s // n for s in sums]
        if (moved == centroids).all():
            break  # further rounds would repeat this one
        centroids = moved
    scratch = Scratch(spark, "centroids")
    if len(centroids):
        found = scratch.keep(assigned(kept, build_tree(centroids), dims, scale), "assigned")
    else:
        found = kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    # One row per centroid, so the totals and this join's small side are bounded.
    totals = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [
        (k, totals.get(k, 0), sum(totals.values()), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest(), row.tolist())
        for k, row in enumerate(centroids)
    ]
    shape = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
    return found.withColumnRenamed("id", vec_id).join(F.broadcast(spark.createDataFrame(facts, shape)), "cluster")
