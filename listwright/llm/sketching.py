"""MinHash near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.links import settle
from listwright.llm.storage import Scratch, small_batches
from listwright.llm.words import WordHashes, fold, mix, shingle_set

C = F.col
#: Bins of a sketch; 2 ** BIN_BITS.
BIN_BITS = 7
BINS = 1 << BIN_BITS
#: 25 bands of 5 bins: a pair of similarity 0.75 shares a band with probability 0.9988, one of 0.3 with 0.06.
BANDS, ROWS = 25, 5
#: Pairs whose sketches agree in fewer bins than this share are not compared exactly. At similarity 0.75
#: the share has a standard deviation below 0.04, so a link is passed over with probability below 0.0001.
SCREEN = 0.6
SMALL = 64


def fast_sketch(items: np.ndarray) -> np.ndarray:
    """One value a bin. In round i every item goes to a hashed bin, from round ``BINS`` on all go to bin
    ``i - BINS``; a bin keeps the least value of the first round that reaches it. Rounds stop when no bin is empty.
    """
    top, out = np.uint64(64 - BIN_BITS), np.zeros(BINS, dtype=np.uint64)
    empty = np.ones(BINS, dtype=bool)
    if len(items) <= SMALL:
        rounds = mix(items[None, :] ^ mix(np.arange(BINS, dtype=np.uint64), 11)[:, None], 1)
        for values in rounds:
            _fill(values, out, empty, top)
            if not empty.any():
                return out
        for b in np.flatnonzero(empty):
            out[b] = mix(items, 2 * BINS + int(b)).min()
        return out
    for i in range(BINS):
        _fill(mix(items ^ mix(np.array([i], dtype=np.uint64), 11), 1), out, empty, top)
        if not empty.any():
            return out
    for b in np.flatnonzero(empty):
        out[b] = mix(items, 2 * BINS + int(b)).min()
    return out


def _fill(values: np.ndarray, out: np.ndarray, empty: np.ndarray, top: np.uint64) -> None:
    least = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    bins = (values >> top).astype(np.intp)
    np.minimum.at(least, bins, values)
    reached = np.zeros(BINS, dtype=bool)
    reached[bins] = True
    new = empty & reached
    out[new] = least[new]
    empty[new] = False


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = mix(np.arange(1, BANDS + 1, dtype=np.uint64), 5)
    for k in range(ROWS):
        keys = mix(keys ^ rows[:, k], 6)
    return keys


def fingerprint(items: np.ndarray) -> bytes:
    """Equal exactly for equal sets, but for a chance of 2 ** -128 a pair."""
    return xxhash.xxh3_128_digest(items.tobytes())


def sketch_rows(docs: DataFrame, size: int) -> DataFrame:
    """Per row: id, set size, fingerprint of the set, band keys and one byte of each bin."""

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            ids, counts, prints, bands, marks = batch.column(0), [], [], [], []
            for text in batch.column(1).to_pylist():
                items = shingle_set(memo.of(fold(text).split()), size)
                counts.append(len(items))
                if len(items):
                    sketch = fast_sketch(items)
                    prints.append(fingerprint(items))
                    bands.append(band_keys(sketch).view(np.int64))
                    marks.append(mix(sketch, 9).astype(np.uint8).tobytes())
                else:
                    prints.append(None), bands.append(None), marks.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "n_shingles", "node", "bands", "mark"],
            )

    schema = "doc_id bigint, n_shingles bigint, node binary, bands array<bigint>, mark binary"
    return docs.select(C("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def agreement(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """``est``: the share of bins whose bytes agree, of pairs that reach ``SCREEN``."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for k in (2, 3))
            est = (a == b).mean(axis=1)
            near = est >= SCREEN
            out = [batch.column(0), batch.column(1), pa.array(est, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "est"]).filter(pa.array(near))

    joined = pairs.join(marks.select(C("node").alias("a"), C("mark").alias("ma")), "a")
    joined = joined.join(marks.select(C("node").alias("b"), C("mark").alias("mb")), "b").select("a", "b", "ma", "mb")
    return joined.mapInArrow(run, "a binary, b binary, est double")


def set_rows(docs: DataFrame, size: int) -> DataFrame:
    """``(node, items)``: the full sorted set of every text that has one."""

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            nodes, sets = [], []
            for text in batch.column(0).to_pylist():
                items = shingle_set(memo.of(fold(text).split()), size)
                if len(items):
                    nodes.append(fingerprint(items))
                    sets.append(items.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "items"])

    return docs.select("text").mapInArrow(run, "node binary, items binary")


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs (doc_id, text, ...)``.

    Words are runs of characters other than ASCII white space, with A-Z in lower case. Texts with equal shingle
    sets are one node of the link graph, so groups of copies cost one comparison a text that differs. A text with
    fewer than ``size`` words is one shingle; null, empty or blank texts have none, link with nothing and are kept.
    Repeated rows get the same component. A row whose id is null has a null component and is kept; its text
    takes part. An empty table gives an empty result. Other columns are ignored.
    """
    small_batches(spark)
    scratch = Scratch(spark, "near")
    docs = docs.select(C("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = scratch.keep(sketch_rows(docs, size), "rows")
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("bands", "mark")).alias("s")
    )
    nodes = scratch.keep(nodes.select("node", "doc_id", "s.bands", "s.mark"), "nodes")
    bands = nodes.select(F.explode("bands").alias("key"), "node")
    sets: list[DataFrame] = []

    def fetch(wanted: DataFrame) -> DataFrame:
        for known in sets:
            wanted = wanted.join(known.select("node"), "node", "left_anti")
        wanted = scratch.keep(wanted.join(nodes.select("node", "doc_id"), "node"), "wanted")
        if not sets or not wanted.isEmpty():
            # A null id matches null ids only; a repeated id may bring other texts, which no pair asks for.
            ids = wanted.select(C("doc_id").alias("wanted_id")).distinct()
            texts = docs.join(ids, C("doc_id").eqNullSafe(C("wanted_id")), "left_semi")
            new = set_rows(texts, size).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
            sets.append(scratch.keep(new, "sets"))
        known = sets[0]
        for other in sets[1:]:
            known = known.unionByName(other)
        return known

    found = settle(scratch, bands, fetch, np.uint64, percent, nodes.select("node", "mark"), lambda p: agreement(p, nodes), SCREEN)
    labels = nodes.select("node", "doc_id")
    if found is not None:
        labels = labels.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        labels = labels.join(heads, "component").select("node", "component_id")
    else:
        labels = labels.select("node", C("doc_id").alias("component_id"))
    scratch.drop(*sets)
    component = F.when(C("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "node").join(labels, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
    ).withColumn("kept", C("doc_id").eqNullSafe(C("component_id")))


def one_of_each(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its group, with all their columns.

    A row that repeats another's id and text goes as well; rows of one id with different texts stay or go together,
    and rows with a null id stay. Columns are passed through.
    """
    kept = near_duplicates(spark, docs, size, percent).filter("kept").select(C("doc_id").alias("_kept_id")).distinct()
    left = docs.join(kept, docs["doc_id"].eqNullSafe(C("_kept_id")), "left_semi")
    return left.withColumn("_text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
