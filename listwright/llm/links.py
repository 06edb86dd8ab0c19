"""Components of a similarity graph of sets whose candidate pairs are rows that share a bucket.

No bucket is ever expanded into its pairs. Every member meets one member of its bucket (a star), confirmed links are
closed into components, and only members of one bucket that are still in different components are compared with each
other afterwards: in blocks of bounded size, each pair of blocks in one task that returns links between components and
no pairs. So no link between components is lost, and a bucket of one large group costs as many comparisons as it has
members.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.storage import Scratch, small_batches
from listwright.llm.words import common
from listwright.operators.components import key_components

C = F.col
#: Members and bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20
#: Columns of a block's incidence matrix that are held at once.
COLUMNS = 1 << 14


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges (a, b)``; the component is the least node."""
    return key_components(edges.select(C("a").alias("node"), C("b").alias("rep")))


def with_component(pairs: DataFrame, found: DataFrame | None) -> DataFrame:
    """``pairs (a, b, ...)`` with ``ca`` and ``cb``; a node without a link is its own component."""
    if found is None:
        return pairs.withColumns({"ca": C("a"), "cb": C("b")})
    left = found.select(C("node").alias("a"), C("component").alias("ca"))
    right = found.select(C("node").alias("b"), C("component").alias("cb"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def similar(pairs: DataFrame, sets: DataFrame, dtype: type, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` with ``100 * |intersection| >= percent * |union|`` on their full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, dtype=dtype), np.frombuffer(y, dtype=dtype)
                both = common(a, b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(C("node").alias("a"), C("items").alias("xa")), "a")
    joined = joined.join(sets.select(C("node").alias("b"), C("items").alias("xb")), "b").select("a", "b", "xa", "xb")
    return joined.mapInArrow(run, "a binary, b binary")


def block_pairs(scratch: Scratch, members: DataFrame) -> DataFrame:
    """Pairs of blocks of each bucket, as ``(key, a, b)`` of lists of ``(node, component, load)``; a block also meets itself."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("load")).alias("bytes"))
    parts = F.greatest(F.ceil(C("n") / BLOCK_ROWS), F.ceil(C("bytes") / BLOCK_BYTES), F.lit(1))
    dealt = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), parts.cast("bigint")))
    blocks = dealt.groupBy("key", "part").agg(F.collect_list(F.struct("node", "component", "load")).alias("block"))
    blocks = scratch.keep(blocks, "blocks")
    left, right = blocks.select("key", C("part").alias("pa"), C("block").alias("a")), blocks.select("key", C("part").alias("pb"), C("block").alias("b"))
    return left.join(right, "key").filter("pa <= pb").select("key", "a", "b")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every one of ``right``."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    everything, count = np.unique(np.concatenate((*left, *right)), return_counts=True)
    shared = everything[count > 1]
    for low in range(0, len(shared), COLUMNS):
        some = shared[low : low + COLUMNS]
        out += (_incidence(left, some) @ _incidence(right, some).T).astype(np.int64)
    return out


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), dtype=np.float32)
    for row, items in enumerate(sets):
        at = np.minimum(np.searchsorted(columns, items), len(columns) - 1)
        out[row, at[columns[at] == items]] = 1.0
    return out


def _parts(block: list[dict]) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    return [m["node"] for m in block], np.array([m["component"] for m in block], dtype=object), [m["load"] for m in block]


def worth_comparing(scratch: Scratch, members: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """Members with a partner in another component whose marks agree in a share of ``least`` of their bytes or more."""

    def run(batches):
        for batch in batches:
            keys, nodes = [], []
            for key, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                (na, ca, xa), (nb, cb, xb) = _parts(a), _parts(b)
                ma = np.frombuffer(b"".join(xa), dtype=np.uint8).reshape(len(xa), -1)
                mb = np.frombuffer(b"".join(xb), dtype=np.uint8).reshape(len(xb), -1)
                near = np.stack([(row == mb).mean(axis=1) >= least for row in ma]) & (ca[:, None] != cb[None, :])
                for names, hit in ((na, near.any(axis=1)), (nb, near.any(axis=0))):
                    got = [names[k] for k in np.flatnonzero(hit)]
                    nodes += got
                    keys += [key] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.binary())], ["key", "node"])

    loaded = members.join(marks.select("node", C("mark").alias("load")), "node")
    found = block_pairs(scratch, loaded).mapInArrow(run, "key bigint, node binary").distinct()
    return members.join(found, ["key", "node"], "left_semi")


def links_between(scratch: Scratch, members: DataFrame, sets: DataFrame, dtype: type, percent: int) -> DataFrame:
    """Links ``(a, b)`` between members of one bucket in different components: one for each two components and blocks."""

    def run(batches):
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for _, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                (na, ca, xa), (nb, cb, xb) = _parts(a), _parts(b)
                sa, sb = [np.frombuffer(x, dtype=dtype) for x in xa], [np.frombuffer(x, dtype=dtype) for x in xb]
                both = intersections(sa, sb)
                union = np.array([len(x) for x in sa])[:, None] + np.array([len(x) for x in sb])[None, :] - both
                linked = (100 * both >= percent * union) & (ca[:, None] != cb[None, :])
                first = {}
                for i, j in np.argwhere(linked):
                    first.setdefault((ca[i], cb[j]), (na[i], nb[j]))
                out += first.values()
            columns = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    loaded = members.join(sets.select("node", C("items").alias("load")), "node")
    return block_pairs(scratch, loaded).mapInArrow(run, "a binary, b binary").distinct()


def settle(
    scratch: Scratch, bands: DataFrame, fetch: Callable[[DataFrame], DataFrame], dtype: type, percent: int,
    marks: DataFrame | None = None, screen: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.0,
) -> DataFrame | None:
    """``(node, component)`` of all linked nodes, or None when nothing is linked.

    ``bands (key, node)``: distinct rows. ``fetch`` takes ``(node)`` and returns ``(node, items)``, sorted distinct
    values of ``dtype`` as bytes. ``marks (node, mark)`` and ``screen``, which returns the pairs ``(a, b, est)`` whose
    marks agree in a share ``est`` of at least ``least``, spare exact comparisons of pairs far below the bound.
    """
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = scratch.keep(bands.join(sizes, "key"), "met")
    # The text that copies were made from meets more of them than they meet each other, so it makes the best centre.
    score = met.groupBy("node").agg(F.sum("n").alias("score"))
    scored = met.select("key", "node").join(score, "node")
    pivots = scored.groupBy("key").agg(F.max(F.struct("score", "node")).alias("m")).select("key", C("m.node").alias("pivot"))
    shared = scratch.keep(met.select("key", "node").join(pivots, "key"), "shared")
    star = shared.filter("node <> pivot").select(C("node").alias("a"), C("pivot").alias("b")).distinct()
    star = scratch.keep(screen(star) if screen else star.withColumn("est", F.lit(1.0)), "star")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = scratch.keep(pairs.select("a", "b"), "pairs")
        wanted = pairs.select(C("a").alias("node")).union(pairs.select(C("b").alias("node"))).distinct()
        return scratch.keep(similar(pairs, fetch(wanted), dtype, percent), "links")

    # One exact comparison a node first; most pairs of a group are in one component after it.
    best = star.groupBy("a").agg(F.max(F.struct("est", "b")).alias("m")).select("a", C("m.b").alias("b"))
    links = confirm(best)
    found = None if links.isEmpty() else scratch.keep(components(links), "found")
    more = confirm(with_component(star, found).filter("ca <> cb").select("a", "b").join(best, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        links = links.unionByName(more)
        found = scratch.keep(components(links), "found")

    members = shared.select("key", "node")
    if found is not None:
        members = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        members = members.withColumn("component", C("node"))
    split = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    members = scratch.keep(members.join(split.select("key"), "key", "left_semi"), "members")
    # A row holds two blocks.
    small_batches(scratch.spark, 16)
    if marks is not None:
        members = scratch.keep(worth_comparing(scratch, members, marks, least), "members")
    more = scratch.keep(links_between(scratch, members, fetch(members.select("node").distinct()), dtype, percent), "links")
    small_batches(scratch.spark)
    if not more.isEmpty():
        found = scratch.keep(components(links.unionByName(more)), "found")
    scratch.drop(met, shared, star, members)
    return found
