"""Intermediate tables and files in the folder that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from listwright.session import shared_dir


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that long texts keep a worker's memory bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Scratch:
    """Tables written to the shared folder: each ends the lineage, survives lost executors and can be dropped."""

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        """``tidy``: the shuffle files of a table's query go as soon as the table is written."""
        self.spark = spark
        self.tidy = tidy
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{name}-{self.made}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(TIDY, "false")
        self.spark.conf.set(TIDY, str(self.tidy or before == "true").lower())
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(TIDY, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables made by ``keep`` that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def open_folder(uri: str):
    """The file system of ``uri`` and the path in it; the folder exists afterwards."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    system.create_dir(path, recursive=True)
    return system, path
