"""Stateful streams.

Each job keeps its state in the state store and appends versioned rows to a table in the shared
folder; ``latest`` reads the newest version per key. Sinks are idempotent per micro-batch, so a
batch that is retried after a lost executor writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.operators.ordered import pick_last, rank_within
from listwright.session import cut, discard, new_path

C = F.col


def versioned_sink(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def drain(stream: DataFrame, mode: str, path: str | None = None, checkpoint: str | None = None) -> str:
    """Run the stream over all available input; returns the output table's path."""
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or new_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(versioned_sink(path))
        .start()
    )
    query.awaitTermination()
    return path


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return pick_last(spark.read.parquet(path), list(keys), C("version")).drop("version", "batch_id")


def rate_limit_stream(events: DataFrame, key: str, at: str, minutes: int, limit: int, late: str | None = None) -> DataFrame:
    """Requests per key and tumbling window.

    Every event counts, whenever it arrives, and windows stay in the state. With ``late`` a window leaves the state
    once it is older than that, and events that arrive even later are not counted: only for sources that keep to it.
    Old windows leave the result by ``digest.prune_windows`` whatever the state holds.
    """
    counted = (
        (events.withWatermark(at, late) if late else events)
        .groupBy(C(key), F.window(C(at), f"{minutes} minutes"))
        .agg(F.count(F.lit(1)).alias("request_count"))
    )
    return counted.select(
        key, C("window.start").alias("window_started_at"), "request_count", (C("request_count") <= limit).alias("allowed")
    )


def deduplicated_observations(observations: DataFrame, late: str | None = None) -> DataFrame:
    """Each observation once, whenever it arrives. With ``late`` keys older than that are forgotten and rows that
    arrive even later are dropped: only for sources that keep to it."""
    keys = ["source_id", "source_identifier", "observed_at"]
    if late is None:
        return observations.dropDuplicates(keys)
    return observations.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(keys)


# --- absence closure ------------------------------------------------------------------------


def sightings_stream(sightings: DataFrame) -> DataFrame:
    """Last safe scan in which each entity was seen, from ``(entity, n)``: a map-side combined max."""
    return sightings.groupBy("entity").agg(F.max("n").alias("last_n"))


def absence_status(last_seen: DataFrame, safe_scans: DataFrame, limit: int = 3) -> DataFrame:
    """Status per entity against the safe scans so far.

    Absence changes with every scan but needs no update of the absent entities: it is the number of
    safe scans after the last sighting, and unsafe scans are not in the table at all.
    """
    total = safe_scans.agg(F.max("n").alias("_total"))
    missing = C("_total") - C("last_n")
    return last_seen.crossJoin(F.broadcast(total)).select(
        "entity",
        "last_n",
        missing.alias("missing"),
        F.when(missing >= limit, "closed").when(missing > 0, "missing").otherwise("open").alias("status"),
    )


# --- subscriptions --------------------------------------------------------------------------



def subscription_events(events: DataFrame) -> DataFrame:
    """Requests as they arrive, each once; the sink appends them, so their order of arrival does not matter."""
    wanted = events.select("email", "event_id", "action", "at", "expires")
    return wanted.dropDuplicates(["email", "event_id"])


def _folded(slices: DataFrame) -> DataFrame:
    """``slices (email, slice, e, s0, x0)`` with the state ``(s1, x1)`` after their events, begun at ``(s0, x0)``."""
    start = F.struct(C("s0").alias("status"), C("x0").alias("expires"), F.lit(0).cast("bigint").alias("changes"))

    def step(state: Column, event: Column) -> Column:
        status, lapsed = state["status"], state["expires"].isNull() | (state["expires"] < event["at"])
        over = status.isNull() | status.isin("unsubscribed", "bounced")
        opened = (event["action"] == "subscribe") & (over | ((status == "pending") & lapsed))
        confirmed = (event["action"] == "confirm") & (status == "pending") & ~lapsed
        ended = (event["action"] == "unsubscribe") & (status != "unsubscribed")
        opened, confirmed, ended = (F.coalesce(x, F.lit(False)) for x in (opened, confirmed, ended))
        return F.struct(
            F.when(opened, "pending").when(confirmed, "confirmed").when(ended, "unsubscribed").otherwise(status).alias("status"),
            F.when(opened, event["expires"].cast("bigint")).otherwise(state["expires"]).alias("expires"),
            (state["changes"] + (opened | confirmed | ended).cast("bigint")).alias("changes"),
        )

    done = slices.withColumn("s", F.aggregate("e", start, step))
    return done.select("email", "slice", "s0", "x0", C("s.status").alias("s1"), C("s.expires").alias("x1"), "s.changes")


def subscription_status(events: DataFrame, slice_rows: int = 10_000) -> DataFrame:
    """``(email, at, status, changes)`` after all requests of each address ``(email, event_id, action, at, expires)``.

    Requests are folded in time order, whatever order they came in; times are epoch seconds. An address is folded in
    slices of ``slice_rows`` requests side by side: every slice begins at the state that the one before it ended with
    in the last round, until no slice's beginning changes. Most requests settle a state whatever it was before, so an
    address of any length takes few rounds, and no group holds more than a slice.
    """
    ranked = rank_within(events, ["email"], ["at", "event_id", "action", "expires"], C("at"), "place")
    number = F.floor((C("place") - 1) / slice_rows)
    slices = ranked.groupBy("email", number.alias("slice")).agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "action", "expires"))).alias("e"))
    slices = cut(slices, "slices")
    unknown = slices.withColumns({"s0": F.lit(None).cast("string"), "x0": F.lit(None).cast("bigint")})
    now = cut(_folded(unknown), "folded")
    while True:
        ended = now.select("email", (C("slice") + 1).alias("slice"), C("s1").alias("s2"), C("x1").alias("x2"))
        moved = now.join(ended, ["email", "slice"]).filter(~(C("s0").eqNullSafe(C("s2")) & C("x0").eqNullSafe(C("x2"))))
        moved = cut(moved.select("email", "slice", C("s2").alias("s0"), C("x2").alias("x0")), "moved")
        if moved.isEmpty():
            break
        again = _folded(slices.join(moved, ["email", "slice"]))
        before, now = now, cut(now.join(moved, ["email", "slice"], "left_anti").unionByName(again), "folded")
        discard(before)
    last = now.groupBy("email").agg(F.max_by("s1", "slice").alias("status"), F.sum("changes").alias("changes"))
    times = slices.groupBy("email").agg(F.max(F.array_max("e")["at"]).alias("at"))
    return times.join(last, "email").select("email", "at", "status", "changes").filter("status is not null")


# --- snapshot merge per micro-batch ---------------------------------------------------------


def first_last_stream(events: DataFrame, key: str, at: str) -> DataFrame:
    """Running first and last sighting per key."""
    return events.groupBy(key).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))


def file_stream(spark: SparkSession, folder: str, name: str, columns: str, files: int = 64) -> DataFrame:
    """Stream over one table, which may be one file or a folder of files; ``files`` bounds a micro-batch."""
    # A pattern that matches the table's own name: a stream takes a plain path for a folder only.
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parque[t]")
