"""Shards by vector bin packing: bytes, words and rows of every shard are balanced together.

Items are groups of equal texts with three weights. Each item goes, largest first, where the dot product of its weights
with the shard's residual capacity is highest, among the shards where it still fits, if there is any. One task packs
the items of one part of the hash space into as many bins as there are shards; the bins of many parts are items again,
packed by the next level in the same way, until one set of bins is left: the shards. So no task and no driver ever holds
more than a part, and the levels are logarithmic in the number of parts. A group above a small share of a shard in any
weight is split into pieces by a hash of its rows, so that copies of one text, however many, never upset the balance.

Law: ``bytes`` (sizes are near equal); counts and words are near equal as well where the texts allow it.

Edge cases: a null text weighs one byte, has no words and belongs with the empty ones; repeated rows and null ids are
rows like any other; an empty table gives an empty result; columns named like those that are added are replaced by them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.storage import Scratch

C = F.col
WEIGHTS = ["rows", "bytes", "words"]
#: A group above this part of a shard's fair share is split.
FINE = 64
#: Items of a part, parts whose bins meet at the next level, rows numbered in one window.
PART_ITEMS, FAN, SLICE_ROWS = 20_000, 256, 100_000
ADDED = ["size", "law", "shard", "slot", "grown_shard"]


def place(weights: np.ndarray, shards: int) -> np.ndarray:
    """Bin of every row of ``weights``: largest first, to the highest dot product with the residual capacity."""
    share = weights / np.maximum(weights.sum(axis=0), 1) * shards
    order = np.lexsort((np.arange(len(share)), -share.sum(axis=1), -share.max(axis=1)))
    left = np.ones((shards, weights.shape[1]))
    out = np.empty(len(share), dtype=np.int32)
    for row in order:
        item = share[row]
        score = left @ item
        fits = (left >= item - 1e-12).all(axis=1)
        at = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        left[at] -= item
        out[row] = at
    return out


def pack_level(items: DataFrame, names: list[str], group: Column, shards: int) -> DataFrame:
    """``items`` with ``up``, the number of their group, and ``up_bin``, the bin in it that ``place`` chose."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)

    def run(table):
        table = table.sort_by([(name, "ascending") for name in names])
        weights = np.stack([table.column(w).to_numpy().astype(np.float64) for w in WEIGHTS], axis=1)
        return table.append_column("up_bin", pa.array(place(weights, shards), pa.int32()))

    dealt = items.withColumn("up", group)
    return dealt.groupBy("up").applyInArrow(run, f"{kinds}, up bigint, up_bin int")


def loads(packed: DataFrame) -> DataFrame:
    """``(part, bin)`` and weights of the bins that a level filled."""
    return packed.groupBy(C("up").alias("part"), C("up_bin").alias("bin")).agg(*[F.sum(w).alias(w) for w in WEIGHTS])


def pack_items(scratch: Scratch, items: DataFrame, count: int, shards: int) -> DataFrame:
    """``(digest, piece, shard)`` of every item."""
    parts = max(1, -(-count // PART_ITEMS))
    packed = scratch.keep(pack_level(items, ["digest", "piece"], F.pmod(F.xxhash64("digest", "piece"), F.lit(parts)), shards), "packed")
    found = packed.select("digest", "piece", C("up").alias("part"), C("up_bin").alias("bin"))
    while parts > 1:
        level = scratch.keep(pack_level(loads(packed), ["part", "bin"], F.floor(C("part") / FAN), shards), "level")
        onward = level.select("part", "bin", "up", "up_bin")
        found = found.join(onward, ["part", "bin"]).select("digest", "piece", C("up").alias("part"), C("up_bin").alias("bin"))
        packed, parts = level, -(-parts // FAN)
    return found.select("digest", "piece", C("bin").alias("shard"))


def named_rows(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``, the file and place of each row; what is not read from files is written first."""
    key = F.struct(F.unhex(F.md5(C("_metadata.file_path").cast("binary"))).alias("file"), C("_metadata.row_index").alias("at"))
    try:
        return docs.select(*docs.columns, key.alias("row_key"))
    except AnalysisException:
        kept = scratch.keep(docs, "documents")
        return kept.select(*kept.columns, key.alias("row_key"))


def numbered(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """``placed`` with ``slot``, gapless from 0 in every shard; a shard's rows are numbered in slices."""
    slices = max(1, -(-rows // (shards * SLICE_ROWS)))
    sliced = placed.withColumn("slice", F.pmod(F.xxhash64("row_key"), F.lit(slices)))
    sizes = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "slice").orderBy("row_key")
    at = sliced.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "slice"])
    return at.select("row_key", "shard", (C("start") + C("at")).alias("slot"))


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 16, text: str = "text") -> DataFrame:
    """The documents with ``size``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null under this law)."""
    scratch = Scratch(spark, "shards")
    docs = named_rows(scratch, docs.drop(*ADDED))
    body = F.coalesce(C(text), F.lit(""))
    size = (F.octet_length(body) + 1).cast("bigint")
    narrow = docs.select(
        "row_key", F.unhex(F.md5(body.cast("binary"))).alias("digest"),
        size.alias("bytes"), F.regexp_count(body, F.lit(r"\S+")).cast("bigint").alias("words"),
    )
    narrow = scratch.keep(narrow, "narrow")
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"), F.sum("words").alias("words")]
    total = narrow.agg(*sums).first()
    if not total["rows"]:
        return docs.drop("row_key").withColumns(_added(size, F.lit(0), F.lit(0).cast("bigint")))
    limits = {w: max(1, -(-total[w] // (shards * FINE))) for w in WEIGHTS}
    groups = narrow.groupBy("digest").agg(*sums)
    pieces = F.least(C("rows"), F.greatest(*[F.ceil(C(w) / limits[w]) for w in WEIGHTS]))
    # A split group is above 1 / (shards * FINE) of all rows, bytes or words: there are at most 3 * shards * FINE of them.
    split = groups.withColumn("pieces", pieces).filter("pieces > 1").select("digest", "pieces")
    dealt = narrow.join(F.broadcast(split), "digest", "left")
    dealt = dealt.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row_key"), C("pieces")), F.lit(0).cast("bigint"))).drop("pieces")
    items = scratch.keep(dealt.groupBy("digest", "piece").agg(*sums), "items")
    chosen = pack_items(scratch, items, items.count(), shards)
    placed = dealt.select("row_key", "digest", "piece").join(chosen.hint("merge"), ["digest", "piece"]).select("row_key", "shard")
    placed = scratch.keep(placed, "placed")
    slots = numbered(placed, total["rows"], shards)
    # Both sides grow with the documents: a merge join at every size, however small the slots are.
    return docs.join(slots.hint("merge"), "row_key").drop("row_key").withColumns(_added(size, C("shard"), C("slot")))


def _added(size: Column, shard: Column, slot: Column) -> dict[str, Column]:
    return {"size": size, "law": F.lit("bytes"), "shard": shard.cast("int"), "slot": slot, "grown_shard": F.lit(None).cast("int")}


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = 16, text: str = "text") -> DataFrame:
    """Writes one folder of Parquet files per shard, each file in the order of its slots, and reads them back."""
    sharded = shard_documents(spark, docs, shards, text)
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(sharded.schema).parquet(path)
