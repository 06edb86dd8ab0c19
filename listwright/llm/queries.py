"""The registered query of every operator, over whole tables, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm import centroids, decontaminate, grammar, hamming, html, lines, oracles, packing, passages, sharding, sketching, toxicity, variants, warc
from listwright.llm.storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_paragraph_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(spark, table(spark, sf_dir, "documents"))


@query("op2_ftrl_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_line_templates", oracles.LINES)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_lines(spark, table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "dropped", "text")


@query("op4_window_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(spark, table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_indexed_warc", oracles.ARCHIVES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_hamming_tables", oracles.VECTORS)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_vectors(spark, table(spark, sf_dir, "embeddings"))


@query("op7_pair_grammar")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = grammar.encode_and_read(spark, table(spark, sf_dir, "documents"))
    length = (F.octet_length("ids") / 4).cast("bigint")
    return read.select("doc_id", "start", length.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op8_walk_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_host_suffix_array")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark, table(spark, sf_dir, "pages"))


@query("op10_fast_sketch_dedup", oracles.SHINGLES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketching.near_duplicates(spark, table(spark, sf_dir, "documents"))


@query("op11_permuterm_variants", oracles.VARIANTS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(spark, table(spark, sf_dir, "documents"))


@query("op12_vantage_clusters", oracles.CLUSTERS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(spark, table(spark, sf_dir, "embeddings")).drop("centroid")


@query("op13_vector_shards")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "shards").path("files")
    sharded = sharding.write_shards(spark, table(spark, sf_dir, "documents"), path)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return sharded.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")
