"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.storage import Scratch, small_batches
from listwright.llm.words import MEMO, PUNCTUATION, BareWordHashes, WordHashes, fold, mix

C = F.col
START = 4
#: Score from which on a text is rejected.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Settings:
    #: Labelled rows that the model learns from: the bound of the sample. They are those of least id hash.
    sample_rows: int = 12_288
    passes: int = 3
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0


class StartHashes(WordHashes):
    """Hashes of the first ``START`` letters of words: inflected and compound words share them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        start = (word.strip(PUNCTUATION) or word).decode("utf-8", "replace")[:START]
        got = self[word] = xxhash.xxh3_64_intdigest(start.encode())
        return got


class Features:
    """Indices of a text's words and word starts, of word pairs and of pairs with one or two words between; with repeats."""

    def __init__(self, bits: int):
        self.shift, self.words, self.starts = np.uint64(64 - bits), BareWordHashes(), StartHashes()

    def of(self, text: str | None) -> np.ndarray:
        words = fold(text).split()
        hashes = self.words.of(words)
        parts = [mix(hashes, 21), mix(self.starts.of(list(set(words))), 25)]
        for gap in (1, 2, 3):
            if len(hashes) > gap:
                parts.append(mix(mix(hashes[:-gap], 21 + gap) + hashes[gap:], 31))
        return (np.concatenate(parts) >> self.shift).astype(np.int32)


class Ftrl:
    """Per-coordinate rates; a weight stays 0 until its summed gradients exceed ``l1``. The bias has no ``l1``."""

    def __init__(self, s: Settings):
        self.s = s
        self.z, self.n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        l1 = np.where(at == 1 << s.bits, 0.0, s.l1)
        rate = (s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / rate, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << self.s.bits)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        old = self.n[at]
        self.z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / self.s.alpha * w
        self.n[at] = old + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(self.z))
        w = self.weights(at)
        return at[w != 0], w[w != 0]


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


def held_out() -> F.Column:
    """Rows that no model may learn from. A null id is not held out; it has no label either."""
    return F.coalesce(F.crc32(C("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not 0; the last index, ``2 ** bits``, is the bias.

    The sample is bounded by ``sample_rows``, so its ids may be broadcast and one task may learn from it. Rows reach
    that task sorted by pass and id hash, once a pass, so it keeps only the model in memory. Of several labels of one
    id the largest counts; null labels and labels of absent documents are ignored.
    """
    key = F.xxhash64("doc_id")
    sample = labels.select(C("doc_id").cast("bigint").alias("doc_id"), (C("toxic") > 0).cast("int").alias("label"))
    sample = sample.filter(C("label").isNotNull() & C("doc_id").isNotNull() & ~held_out())
    sample = sample.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(key, "doc_id").limit(s.sample_rows)
    texts = docs.select(C("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def hashed(batches):
        features = Features(s.bits)
        for batch in batches:
            sets = [np.unique(features.of(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["key", "label", "at"])

    def learn(batches):
        model, rows = Ftrl(s), 0
        for batch in batches:
            for label, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                model.learn(np.frombuffer(at, dtype=np.int32), label)
                rows += 1
        if rows:
            at, w = model.sparse()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])

    rows = texts.select(key.alias("key"), "label", "text").mapInArrow(hashed, "key bigint, label int, at binary")
    scratch = Scratch(spark, "toxic")
    rows = scratch.keep(rows, "features")
    ordered = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(s.passes)))).repartition(1)
    ordered = ordered.sortWithinPartitions("turn", "key", "at").select("label", "at")
    got = ordered.mapInArrow(learn, "at bigint, w double").toPandas()
    scratch.drop(rows)
    return got["at"].to_numpy(dtype=np.int64), got["w"].to_numpy(dtype=np.float64)


class Scorer:
    """The model inside a task."""

    def __init__(self, places: np.ndarray, values: np.ndarray, bits: int):
        self.fitted, self.dense = len(places) > 0, np.zeros((1 << bits) + 1)
        self.dense[places] = values
        self.used, self.features = self.dense != 0, Features(bits)

    def score(self, text: str | None) -> float:
        found = self.features.of(text)
        found = np.unique(found[self.used[found]])
        return sigmoid(self.dense[-1] + self.dense[found].sum()) if self.fitted else 0.0


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs (doc_id, text, ...)``.

    The score is a function of the whole text alone. A null or empty text gets the base rate that the model
    learned; without any usable label every score is 0. Repeated rows get equal scores; other columns are ignored.
    """
    small_batches(spark)
    model, bits = spark.sparkContext.broadcast(fit(spark, docs, labels, settings)), settings.bits

    def run(batches):
        scorer = Scorer(*model.value, bits)
        for batch in batches:
            scores = pa.array([scorer.score(t) for t in batch.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    scored = docs.select(C("doc_id").cast("bigint").alias("doc_id"), "text").select("doc_id", held_out().alias("held_out"), "text")
    scored = scored.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (C("score") >= THRESHOLD).cast("int"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose score is below ``THRESHOLD``, with all their columns and no shuffle."""
    small_batches(spark)
    model, bits, at = spark.sparkContext.broadcast(fit(spark, docs, labels, settings)), settings.bits, docs.columns.index("text")

    def run(batches):
        scorer = Scorer(*model.value, bits)
        for batch in batches:
            keep = [scorer.score(t) < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
