"""Versioned state tables: one folder per table and scan, and one manifest that names the current ones."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def fingerprint(df: DataFrame) -> tuple:
    """Order-free content summary: row count, XOR and sum of row hashes, one pass."""
    flat = [F.to_json(F.struct(C(n))) if "map" in df.schema[n].dataType.simpleString() else C(n) for n in sorted(df.columns)]
    row_hash = F.xxhash64(*flat)
    got = df.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(row_hash).alias("x"), F.sum(F.pmod(row_hash, F.lit(1 << 31))).alias("s")
    ).first()
    return got["n"], got["x"] or 0, got["s"] or 0


MANIFEST = "seq BIGINT, commit STRING, name STRING, version STRING"


def current_versions(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number of the last commit and the version of every table in it; -1 and nothing when there is none."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{root}/_commits")
        last = rows.agg(F.max(F.struct("seq", "commit")).alias("m")).first()["m"]
    except AnalysisException as exc:  # a path that does not exist yet is an empty state
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return -1, {}
    if last is None:
        return -1, {}
    # One row per table of the state.
    named = rows.filter((C("seq") == last["seq"]) & (C("commit") == last["commit"])).collect()
    return last["seq"], {row["name"]: row["version"] for row in named}


def read_state(spark: SparkSession, root: str, name: str, ddl: str, versions: dict[str, str] | None = None) -> DataFrame:
    """Current snapshot, or that of ``versions``; an empty table when none was written."""
    if versions is None:
        _, versions = current_versions(spark, root)
    if name not in versions:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(f"{root}/{name}/{versions[name]}")


def commit_state(tables: dict[str, DataFrame], root: str, scan_id: str) -> list[str]:
    """Write snapshots of several tables and make them current together; names of those that changed.

    Tables equal to their current snapshot are left alone. The manifest of a commit is one file that names a version
    for every table and appears when it is complete, so a scan that stops before it leaves the old state whole, and
    readers never see tables of two scans.
    """
    if not tables:
        return []
    spark = next(iter(tables.values())).sparkSession
    seq, versions = current_versions(spark, root)
    changed = []
    for name, df in tables.items():
        if name in versions:
            stored = spark.read.schema(df.schema).parquet(f"{root}/{name}/{versions[name]}")
            if fingerprint(stored) == fingerprint(df):
                continue
        # A retried scan writes a folder of its own; only the manifest decides what is current.
        version = f"scan_id={scan_id}-{uuid.uuid4().hex[:8]}"
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{version}")
        versions[name] = version
        changed.append(name)
    if changed:
        commit = uuid.uuid4().hex
        rows = [(seq + 1, commit, name, version) for name, version in versions.items()]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/_commits")
    return changed


def write_state(df: DataFrame, root: str, name: str, scan_id: str) -> bool:
    """Commit one table; an identical table is left alone (returns False)."""
    return bool(commit_state({name: df}, root, scan_id))
