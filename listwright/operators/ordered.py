"""Order-dependent operators that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.session import cut, discard

C = F.col
BUCKETS = 64


def quantile_bounds(df: DataFrame, order: Column, buckets: int = BUCKETS) -> list:
    """Cut points that split ``order`` (a number) into about equal row counts: one aggregate, one row."""
    if buckets < 2:
        return []
    points = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(order, points, 10_000).alias("p")).first()["p"]
    return sorted(set(found or []))


def bucket_of(order: Column, bounds: Sequence) -> Column:
    """How many cut points lie below ``order``, by halving."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    left, right = bounds[:mid], bounds[mid + 1 :]
    return F.when(order <= F.lit(bounds[mid]), bucket_of(order, left)).otherwise(
        bucket_of(order, right) + (mid + 1)
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    number: Column,
    wanted: Mapping[str, Column],
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add, as struct ``prev``, values of the previous row per key (NULL for the first).

    The window runs per (key, slice of the order), never per key alone, so a key that holds a third
    of the rows is spread over the slices. The first row of a slice takes its predecessor from the
    last row of the nearest earlier slice, which is a small per-slice table. ``number`` is a numeric
    expression that rises with ``order``; rows with the same number share a slice.
    """
    keys, order = list(keys), list(order)
    payload = F.struct(*[c.alias(name) for name, c in wanted.items()])
    df = df.withColumn("_slice", bucket_of(number, quantile_bounds(df, number, buckets)))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    sliced = df.withColumns(
        {"_inner": F.lag(payload).over(inside), "_first": F.row_number().over(inside) == 1}
    )
    tails = df.groupBy(*keys, "_slice").agg(F.max_by(payload, F.struct(*order)).alias("_tail"))
    tails = tails.select(
        *keys,
        "_slice",
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried"),
    )
    return (
        sliced.join(tails, [*keys, "_slice"], "left")
        .withColumn("prev", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_inner")))
        .drop("_slice", "_inner", "_first", "_carried")
    )


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    number: Column,
    into: str = "rank",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Exact 1-based position per key (or overall for no keys), windowed per slice of the order."""
    keys, order = list(keys), list(order)
    df = df.withColumn("_slice", bucket_of(number, quantile_bounds(df, number, buckets)))
    sizes = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # At most `buckets` rows per key reach this window.
    running = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        df.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(into, F.col("_before") + F.col("_pos"))
        .drop("_slice", "_pos", "_before")
    )


def hash_tree(
    df: DataFrame, keys: Sequence[str], position: str, value: str, into: str, separator: str = "", fan: int = 4096
) -> DataFrame:
    """One SHA-256 per key that depends on the order of ``value`` by ``position`` (0, 1, 2 ... within the key).

    Leaves hash the joined values of ``fan`` positions each; every further level hashes ``fan`` joined hashes of the
    level below, and a hash that stands alone goes up as it is. So no group holds more than ``fan`` values, and up to
    ``fan`` values the result is the plain hash of the joined list.
    """
    keys = list(keys)
    items = F.array_sort(F.collect_list(F.struct("_at", "_value")))
    joined = lambda by: F.sha2(F.array_join(F.transform(items, lambda x: x["_value"]), by), 256)
    nodes = df.select(*keys, C(position).cast("bigint").alias("_at"), C(value).alias("_value"))
    slices = lambda nodes, hashed: nodes.groupBy(*keys, F.floor(C("_at") / fan).alias("_slice")).agg(hashed.alias("_value"))
    nodes = cut(slices(nodes, joined(separator)).withColumnRenamed("_slice", "_at"), "hashes")
    while not nodes.filter("_at > 0").isEmpty():
        up = F.when(F.count(F.lit(1)) == 1, F.first("_value")).otherwise(joined(""))
        before, nodes = nodes, cut(slices(nodes, up).withColumnRenamed("_slice", "_at"), "hashes")
        discard(before)
    return nodes.select(*keys, C("_value").alias(into))


def pick_first(df: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """First row per key in stored order: an aggregate with map-side combine, not a window."""
    names = df.columns
    packed = F.struct(*[F.col(n) for n in names])
    return df.groupBy(*by).agg(F.min_by(packed, order).alias("_row")).select(*[F.col(f"_row.{n}") for n in names])


def pick_last(df: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    names = df.columns
    packed = F.struct(*[F.col(n) for n in names])
    return df.groupBy(*by).agg(F.max_by(packed, order).alias("_row")).select(*[F.col(f"_row.{n}") for n in names])


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """First appearance wins; every appearance is counted in ``appearances``."""
    names = df.columns
    packed = F.struct(*[F.col(n) for n in names])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(packed, order).alias("_row"), F.count(F.lit(1)).alias("appearances"), F.min(order).alias("first_ord"))
        .select(*[F.col(f"_row.{n}") for n in names], "appearances", "first_ord")
    )


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Last value wins but keeps the position of the first."""
    names = df.columns
    packed = F.struct(*[F.col(n) for n in names])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(packed, order).alias("_row"), F.min(order).alias("first_ord"))
        .select(*[F.col(f"_row.{n}") for n in names], "first_ord")
    )


def apply_cap(df: DataFrame, by: Sequence[str], order: Sequence[str], cap: Column, number: Column) -> DataFrame:
    """Keep the first ``cap`` rows per key, all rows where the cap is NULL; ``capped`` tells whether any were cut.

    Rows without a cap are never ranked; those of capped keys are ranked per slice of the order, which ``number``
    rises with, so a key that holds most of the rows is spread out.
    """
    free = df.filter(cap.isNull()).withColumn("capped", F.lit(False))
    bound = df.filter(cap.isNotNull())
    counted = bound.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    ranked = rank_within(bound, by, order, number, "_rn").filter(F.col("_rn") <= cap)
    cut_off = ranked.join(counted, list(by)).withColumn("capped", F.col("_total") > cap).drop("_total", "_rn")
    return free.unionByName(cut_off.select(*free.columns))


def page(df: DataFrame, n: int) -> DataFrame:
    return df.limit(max(0, n))


def tail(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Last ``n`` rows: ``order`` is given newest first."""
    return df.orderBy(*order).limit(n)


def with_totals(df: DataFrame, n: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.least(F.col("total"), F.lit(n)).alias("shown"),
        (F.col("total") > n).alias("has_more"),
    )
