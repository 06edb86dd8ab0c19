"""Near-duplicate embeddings: learned binary codes, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.links import components
from listwright.llm.storage import Scratch, small_batches
from listwright.llm.words import mix

C = F.col


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    #: Vectors that the rotation is learned from: those of least hash. Every vector is indexed.
    sample_rows: int = 4096
    #: Chance that a pair at the bound of similarity shares a table's key, over all tables. Keys get shorter until
    #: ``most_tables`` tables reach it.
    recall: float = 0.97
    rounds: int = 30
    most_tables: int = 160
    #: Vectors of one block of a cell; a task compares two blocks at a time.
    block: int = 256


def unit(values) -> np.ndarray | None:
    """The vector over its length in double precision; None for one that links with nothing."""
    if values is None or any(v is None for v in values):
        return None
    v = np.asarray(values, dtype=np.float64)
    if v.size == 0 or not np.isfinite(v).all():
        return None
    scale = np.abs(v).max()
    if scale == 0:
        return None
    v = v / scale
    return v / math.sqrt(float(v @ v))


def turned(sample: np.ndarray, mean: np.ndarray, theta: float) -> np.ndarray:
    """Each unit vector turned by ``theta`` to a random side that keeps its part along the mean, as far as one does:
    what all vectors have in common does not set a pair apart, so a pair's whole difference lies beside it."""
    side = np.random.default_rng(7).standard_normal(sample.shape)
    side -= (side * sample).sum(axis=1, keepdims=True) * sample
    size = np.linalg.norm(mean)
    axis = mean / size if size > 0 else mean
    along = (sample @ axis)[:, None]
    across = axis - along * sample
    rest = np.linalg.norm(across, axis=1, keepdims=True)
    across /= np.where(rest > 1e-9, rest, 1.0)
    part = np.where(rest > 1e-9, np.clip(along * math.tan(theta / 2) / np.where(rest > 1e-9, rest, 1.0), -1, 1), 0.0)
    side -= (side * across).sum(axis=1, keepdims=True) * across
    norms = np.linalg.norm(side, axis=1, keepdims=True)
    side = part * across + np.sqrt(1 - part**2) * side / np.where(norms > 0, norms, 1.0)
    return math.cos(theta) * sample + math.sin(theta) * side


class Codes:
    """A mean and rotations after principal components, each refined until bits and rotated values agree best."""

    def __init__(self, sample: np.ndarray, key_bits: int, s: Settings):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        width = min(sample.shape[1], 64)
        _, vectors = np.linalg.eigh(centred.T @ centred)
        basis = vectors[:, ::-1][:, :width]
        projected, beside = centred @ basis, turned(sample, self.mean, math.acos(s.cosine)) - self.mean
        self.width, rotations, same = width, [], []

        def learn(m: int) -> None:
            rotation = np.linalg.qr(np.random.default_rng((7, m)).standard_normal((width, width)))[0]
            for _ in range(s.rounds):
                bits = np.where(projected @ rotation >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(bits.T @ projected)
                rotation = (left @ right).T
            rotations.append(basis @ rotation)
            same.append((centred @ rotations[m] >= 0) == (beside @ rotations[m] >= 0))

        # The share of sample vectors that keep no table's key when they are turned by the angle of the bound.
        for self.key_bits in range(min(key_bits, width), 0, -1):
            self.per_map, tables, apart = width // self.key_bits, 0, np.ones(len(sample), dtype=bool)
            while tables < s.most_tables and apart.mean() > 1 - s.recall:
                m, k = divmod(tables, self.per_map)
                if m == len(rotations):
                    learn(m)
                apart &= ~same[m][:, k * self.key_bits : (k + 1) * self.key_bits].all(axis=1)
                tables += 1
            self.tables, self.recall = tables, 1 - apart.mean()
            if self.recall >= s.recall:
                break
        else:
            # No bit is kept by enough pairs: one bucket holds all vectors, whose cells are compared block by block.
            self.key_bits, self.per_map, self.tables, self.recall = 0, 1, 1, 1.0
        self.maps = rotations[: -(-self.tables // self.per_map)]

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([(vectors - self.mean) @ m >= 0 for m in self.maps], axis=1)

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """One key a table; keys of different tables differ."""
        out = []
        powers = np.uint64(1) << np.arange(self.key_bits, dtype=np.uint64)
        for n in range(self.tables):
            m, k = divmod(n, self.per_map)
            low = m * self.width + k * self.key_bits
            value = (bits[:, low : low + self.key_bits].astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
            out.append(mix(value, 1 + n))
        return np.stack(out, axis=1).view(np.int64)


def _vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype=np.float64) for x in column.to_pylist()])


def near_vectors(spark: SparkSession, table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``table (vec_id, embedding, ...)``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of
    different widths not with each other: every width has tables of its own. Pairs are found where they share a table's key, compared in double precision
    and linked from the bound of cosine on. Repeated rows are vectors of their own; a null id has no component and is
    kept. An empty table gives an empty result; other columns are ignored.

    Vectors within half the bound's angle of one vector are all linked with each other: they form a cell, found by
    comparing every vector with the least of each of its buckets only. So a group of copies is one cell, whatever its
    size; pairs of cells that share a bucket are compared block by block, giving counts and never pairs.
    """
    small_batches(spark, 2048)
    s, scratch = settings, Scratch(spark, "vectors")

    def clean(batches):
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            units = [unit(v) for v in batch.column(1).to_pylist()]
            rows = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            raw = pa.array([None if u is None else u.tobytes() for u in units], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), raw], ["row", "vec_id", "unit"])

    source = table.select(C("vec_id").cast("bigint").alias("vec_id"), C("embedding").cast("array<double>"))
    rows = scratch.keep(source.mapInArrow(clean, "row bigint, vec_id bigint, unit binary"), "rows")
    # One row per width of the embeddings.
    widths = [r["w"] for r in rows.filter("unit is not null").select(F.octet_length("unit").alias("w")).distinct().orderBy("w").collect()]
    out = rows.select("row", "vec_id")
    if widths:
        done = reduce(DataFrame.unionByName, [_links_of_width(scratch, rows.filter(F.octet_length("unit") == w), s) for w in widths])
        out = out.join(done, "row", "left")
    else:
        out = out.withColumns({"n_links": F.lit(None).cast("bigint"), "least": F.lit(None).cast("bigint")})
    component = F.when(C("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", C("vec_id").eqNullSafe(C("component_id")))


def _links_of_width(scratch: Scratch, usable: DataFrame, s: Settings) -> DataFrame:
    """``(row, n_links, least)`` of unit vectors ``(row, vec_id, unit)`` of one width."""
    spark, n = scratch.spark, usable.count()
    sample = usable.orderBy(F.xxhash64("unit"), "row").select("unit").limit(s.sample_rows).collect()
    codes = Codes(np.stack([np.frombuffer(r["unit"]) for r in sample]), max(8, min(24, math.ceil(math.log2(n + 1)))), s)
    sent = spark.sparkContext.broadcast(codes)
    theta = math.acos(s.cosine)

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = sent.value.bits(_vectors(batch.column(1)))
            keys = pa.array(list(sent.value.keys(bits)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), keys], ["row", "keys"])

    coded = usable.select("row", "unit").mapInArrow(encode, "row bigint, keys array<bigint>")
    keyed = scratch.keep(coded.select("row", F.explode("keys").alias("key")), "keys")

    # Cells: each vector goes to the least vector that shares a bucket and lies within half the angle.
    pivots = keyed.groupBy("key").agg(F.min("row").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "b")
    pairs = keyed.join(pivots, "key").filter("row <> b").select(C("row").alias("a"), "b").distinct()

    def angles(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dot = np.einsum("ij,ij->i", _vectors(batch.column(2)), _vectors(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.arccos(np.clip(dot, -1, 1)))], ["a", "b", "angle"])

    def apart(pairs: DataFrame, units: DataFrame) -> DataFrame:
        """``(a, b, angle)`` of pairs of rows."""
        joined = pairs.join(units.select(C("row").alias("a"), C("unit").alias("xa")), "a").join(units.select(C("row").alias("b"), C("unit").alias("xb")), "b")
        return joined.select("a", "b", "xa", "xb").mapInArrow(angles, "a bigint, b bigint, angle double")

    # A little inside half the angle, so that rounding never puts two members of a cell beyond the bound.
    near = apart(pairs, usable.select("row", "unit")).filter(C("angle") <= theta / 2 - 1e-6)
    chosen = near.groupBy("a").agg(F.min(F.struct("b", "angle")).alias("m"))
    cells = usable.select("row", "vec_id", "unit").join(chosen.select(C("a").alias("row"), "m"), "row", "left").select(
        "row", "vec_id", "unit", F.coalesce("m.b", "row").alias("cell"), F.coalesce("m.angle", F.lit(0.0)).alias("angle")
    )
    cells = scratch.keep(cells, "cells")
    sizes = scratch.keep(cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("size"), F.max("angle").alias("reach"), F.min("vec_id").alias("least")), "sizes")

    # Pairs of cells that share a bucket through any members.
    met = keyed.join(cells.select("row", "cell"), "row").select("key", "cell").distinct()
    crowded = met.groupBy("key").agg(F.min("cell").alias("x"), F.max("cell").alias("y")).filter("x <> y").select("key")
    met = scratch.keep(met.join(crowded, "key"), "met")
    pairs = met.select("key", C("cell").alias("a")).join(met.select("key", C("cell").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    # Angles keep the triangle inequality: members within the bound need centres within it and both cells' reaches.
    pairs = apart(pairs, cells.filter("row = cell").select("row", "unit"))
    pairs = pairs.join(sizes.select(C("cell").alias("a"), C("reach").alias("ra")), "a").join(sizes.select(C("cell").alias("b"), C("reach").alias("rb")), "b")
    pairs = scratch.keep(pairs.filter(C("angle") <= theta + C("ra") + C("rb") + 1e-6).select("a", "b"), "pairs")

    def blocks(key, group):
        return pa.table({
            "cell": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()),
            "rows": pa.array([group.column("row").to_pylist()], pa.list_(pa.int64())),
            "units": pa.array([b"".join(group.column("unit").to_pylist())], pa.binary()),
        })

    involved = pairs.select(C("a").alias("cell")).union(pairs.select(C("b").alias("cell"))).distinct()
    members = cells.join(involved, "cell").join(sizes.select("cell", "size"), "cell")
    part = F.pmod(F.xxhash64("row"), F.ceil(C("size") / s.block).cast("bigint"))
    single = members.filter("size = 1").select("cell", F.lit(0).cast("bigint").alias("part"), F.array("row").alias("rows"), C("unit").alias("units"))
    several = members.filter("size > 1").select("cell", part.alias("part"), "row", "unit").groupBy("cell", "part")
    several = several.applyInArrow(blocks, "cell bigint, part bigint, rows array<bigint>, units binary")
    blocked = scratch.keep(single.unionByName(several), "blocks")

    def compare(batches):
        for batch in batches:
            rows_out, counts, edge_a, edge_b = [], [], [], []
            for a, b, ra, rb, xa, xb in zip(*(c.to_pylist() for c in batch.columns)):
                left = np.frombuffer(xa).reshape(len(ra), -1)
                right = np.frombuffer(xb).reshape(len(rb), -1)
                linked = left @ right.T >= s.cosine
                if linked.any():
                    for ids, n_each in ((ra, linked.sum(axis=1)), (rb, linked.sum(axis=0))):
                        hit = np.flatnonzero(n_each)
                        rows_out += [ids[k] for k in hit]
                        counts += n_each[hit].tolist()
                        edge_a += [a] * len(hit)
                        edge_b += [b] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows_out, counts, edge_a, edge_b)], ["row", "n", "a", "b"])

    met_blocks = pairs.join(blocked.select(C("cell").alias("a"), C("rows").alias("ra"), C("units").alias("xa")), "a")
    met_blocks = met_blocks.join(blocked.select(C("cell").alias("b"), C("rows").alias("rb"), C("units").alias("xb")), "b")
    links = met_blocks.select("a", "b", "ra", "rb", "xa", "xb").mapInArrow(compare, "row bigint, n bigint, a bigint, b bigint")
    links = scratch.keep(links, "links")

    outside = links.groupBy("row").agg(F.sum("n").alias("outside"))
    edges = links.select(C("b").alias("a"), C("a").alias("b")).distinct()
    heads = sizes.select("cell", "size", "least")
    if not edges.isEmpty():
        found = components(edges).select(C("node").alias("cell"), C("component").alias("group"))
        heads = heads.join(found, "cell", "left").withColumn("group", F.coalesce("group", "cell"))
        least = heads.groupBy("group").agg(F.min("least").alias("least"))
        heads = heads.select("cell", "size", "group").join(least, "group").select("cell", "size", "least")
    done = cells.select("row", "cell").join(heads, "cell").join(outside, "row", "left")
    done = done.select("row", (C("size") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), "least")
    scratch.drop(keyed, met, pairs, blocked)
    return done
