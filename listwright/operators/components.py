"""Connected components of rows that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.session import cut, discard, shuffled


def shared_pairs(pairs: DataFrame) -> DataFrame:
    """``(node, key)`` pairs whose key more than one node holds, with the key's least node and count."""
    stats = pairs.groupBy("key").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n_key"))
    return pairs.join(shuffled(stats.filter("n_key > 1")), "key")


def key_components(shared: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``shared``; the component is its least node.

    Each key contributes a star around its least node, so the edges never outnumber the
    (node, key) pairs. Alternating large-star and small-star steps then shrink every component to
    one star in a logarithmic number of rounds; each step is a map-side combined ``min`` plus an
    equi-join.
    """
    edges = shared.filter("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v")).distinct()
    edges = cut(edges, "edges")
    while not _is_star_forest(edges):
        before, edges = edges, cut(_small_star(_large_star(edges)), "edges")
        discard(before)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _is_star_forest(edges: DataFrame) -> bool:
    totals = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("d")).first()
    if totals["n"] != totals["d"]:
        return False
    chained = edges.select("u").join(shuffled(edges.select(F.col("v").alias("u")).distinct()), "u", "left_semi")
    return chained.isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(shuffled(least), "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(shuffled(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
