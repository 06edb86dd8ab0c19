"""Query registry and the listing tables derived from the driver tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
C = F.col


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Costly rules run over a part of so many bytes of input files in about a minute.
PART_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input of few files, in parts that do not grow with it; the rows are the same either way."""
    spark = df.sparkSession
    files, want = df.inputFiles(), spark.sparkContext.defaultParallelism
    if files:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)) for name in files]
        system = paths[0].getFileSystem(conf)
        want = max(want, -(-sum(system.getFileStatus(path).getLen() for path in paths) // PART_BYTES))
    return df.repartition(want) if len(files) < want else df


# --- SQL spellings used in many oracles -----------------------------------------------------


def s_fold(x: str) -> str:
    return f"replace(lower(coalesce({x}, '')), 'ß', 'ss')"


def s_norm(x: str) -> str:
    marked = f"regexp_replace({s_fold(x)}, '\\bc\\s*\\+\\s*\\+', ' cplusplus ', 'g')"
    marked = f"regexp_replace({marked}, '\\bc\\s*#', ' csharp ', 'g')"
    return f"trim(regexp_replace({marked}, '[^a-z0-9]+', ' ', 'g'))"


def s_board(x: str) -> str:
    return f"trim(regexp_replace({s_fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def s_has(x: str, term: str) -> str:
    return f"contains(' ' || {x} || ' ', ' {term} ')"


def s_any(x: str, terms: Iterable[str]) -> str:
    return "(" + " or ".join(s_has(x, t) for t in terms) + ")"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def s_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def s_list(items: Iterable[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def s_fragments(x: str) -> str:
    """Sentences and lines: mark the cuts, split, strip, drop blanks."""
    marked = f"regexp_replace(coalesce({x}, ''), '([.!?;])\\s+|\\n+', '\\1' || chr(1), 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda p: {s_strip('p')})"
    return f"list_filter({parts}, lambda p: p <> '')"


S_TEXT = """replace(replace(replace(replace({x}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""


def s_html(x: str) -> str:
    """Tags out, the four references the pages use decoded, white space collapsed."""
    return s_squeeze(S_TEXT.format(x=f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"))
