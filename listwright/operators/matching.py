"""Match keys and joins on any shared key.

An OR of key equalities would become a nested-loop join. Every operator here explodes the keys and
joins on equality, and reduces one side to a single row per key first, so no key ever produces all
pairs of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import text, urls
from listwright.operators.components import key_components, shared_pairs
from listwright.operators.ordered import rank_within
from listwright.session import cut, new_path, shuffled

C = F.col


def match_keys() -> Column:
    """Typed match keys of a record, at most nine plus requisition keys."""
    employer, title = text.normalise_text(C("canonical_employer")), text.normalise_text(C("title"))
    location = text.normalise_text(C("location"))
    day = lambda c, blank: F.coalesce(c.cast("string"), F.lit(blank))
    made = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *parts)
    fixed = F.array(
        made("source", employer, C("source_registry_id"), C("source_identifier")),
        made("ats", employer, C("source_identifier")),
        made("application", urls.canonical_url(C("application_url"))),
        made("official", urls.canonical_url(C("canonical_url"))),
        made("natural", employer, title, location, text.normalise_text(C("division"))),
    )
    office = F.when(
        F.coalesce(C("named_office_or_mp"), F.lit("")) != "",
        made("office", text.normalise_text(C("named_office_or_mp")), title, day(C("deadline"), "none")),
    )
    start = F.when(
        C("programme_start").isNotNull(),
        made("programme", employer, title, C("programme_start").cast("string"), day(C("programme_end"), "None")),
    )
    return F.array_distinct(
        F.concat(fixed, urls.requisition_keys(C("application_url")), F.array_compact(F.array(office, start)))
    )


def identity_key() -> Column:
    return F.concat_ws(":", F.lit("identity"), C("source_registry_id"), C("source_identifier"))


def lookup_keys() -> Column:
    """Match keys plus the (source, identifier) pair, hashed to a fixed width."""
    return F.transform(F.array_append(match_keys(), identity_key()), F.md5)


def with_keys(records: DataFrame, keys: Column | None = None) -> DataFrame:
    """Keys are costly to make: records that have them already stay as they are."""
    if keys is None and "keys" in records.columns:
        return records
    return records.withColumn("keys", lookup_keys() if keys is None else keys)


def exploded(df: DataFrame, node: str, scope: Sequence[str] = ()) -> DataFrame:
    return df.select(*scope, C(node).alias("node"), F.explode(F.array_distinct("keys")).alias("key"))


def source_keys(records: DataFrame) -> DataFrame:
    """Distinct ``(source, key)`` rows."""
    return (
        with_keys(records)
        .select("source_registry_id", F.explode("keys").alias("key"))
        .distinct()
    )


def first_match(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, right_ord: str, scope: Sequence[str] = ()
) -> DataFrame:
    """``(left_id, match_id, match_ord)``: the first right row, in stored order, sharing any key.

    Both sides carry ``keys``. The right side shrinks to its first row per key before the join, so
    the join output is one row per left key however many right rows share that key.
    """
    scope = list(scope)
    ranked = right.select(*scope, F.explode(F.array_distinct("keys")).alias("key"), C(right_ord).alias("_o"), C(right_id).alias("_id"))
    best = ranked.groupBy(*scope, "key").agg(F.min(F.struct("_o", "_id")).alias("best"))
    probes = left.select(*scope, C(left_id), F.explode(F.array_distinct("keys")).alias("key"))
    return (
        probes.join(shuffled(best), [*scope, "key"])
        .groupBy(left_id)
        .agg(F.min("best").alias("best"))
        .select(left_id, C("best._id").alias("match_id"), C("best._o").alias("match_ord"))
    )


def policy_matches(fresh: DataFrame, public: DataFrame, left_id: str, right_id: str, right_ord: str) -> DataFrame:
    """First public row of the same source sharing a key; a discovery copy matches nothing."""
    official = fresh.filter(C("source_authority") != "discovery_only_source")
    return first_match(official, public, left_id, right_id, right_ord, scope=["source_registry_id"])


def minus_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.join(shuffled(b.select(key).distinct()), key, "left_anti")


def minus_keys(a: DataFrame, b: DataFrame, node: str, scope: Sequence[str] = ()) -> DataFrame:
    """Rows of ``a`` that share no key with any row of ``b`` (within ``scope``)."""
    scope = list(scope)
    known = b.select(*scope, F.explode("keys").alias("key")).distinct()
    hit = exploded(a, node, scope).join(shuffled(known), [*scope, "key"], "left_semi").select(C("node").alias(node)).distinct()
    return a.join(shuffled(hit), node, "left_anti")


def not_fetched_now(old: DataFrame, fresh: DataFrame, node: str) -> DataFrame:
    """Old rows whose source did not return them in this scan, by identifier or by key."""
    return minus_keys(old, fresh, node, scope=["source_registry_id"])


# --- one-to-one greedy match ----------------------------------------------------------------


def _greedy(fresh: pd.DataFrame, old: pd.DataFrame) -> list[tuple[int, int]]:
    """Serial choice: fresh rows in order take the first free old row that shares a key."""
    by_key: dict[str, list[int]] = {}
    for node, key in old.sort_values("node")[["node", "key"]].itertuples(index=False):
        by_key.setdefault(key, []).append(node)
    heads = dict.fromkeys(by_key, 0)
    taken: set[int] = set()
    out = []
    for node, rows in groupby(fresh.sort_values("node")[["node", "key"]].itertuples(index=False, name=None), key=lambda row: row[0]):
        best = None
        for _, key in rows:
            queue = by_key.get(key)
            if queue is None:
                continue
            at = heads[key]
            while at < len(queue) and queue[at] in taken:
                at += 1
            heads[key] = at
            if at < len(queue) and (best is None or queue[at] < best):
                best = queue[at]
        if best is not None:
            taken.add(best)
            out.append((int(node), int(best)))
    return out


def _greedy_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    pairs = _greedy(pdf[pdf["side"] == "f"], pdf[pdf["side"] == "o"])
    return pd.DataFrame(pairs, columns=["fresh_ord", "old_ord"], dtype="int64")


MATCHED = "fresh_ord long, old_ord long"


def greedy_match(
    fresh: DataFrame,
    existing: DataFrame,
    fresh_ord: str,
    old_ord: str,
    max_component: int = 10_000,
    chunk: int = 100_000,
) -> DataFrame:
    """``(fresh_ord, old_ord)``: each fresh row, in order, takes the first free old row sharing a key.

    Rows in different key components cannot compete, so components are settled independently:
    small ones many in one call, one where every row shares a key by pairing equal ranks, others of up
    to ten chunks whole in one task, and any larger one in bounded chunks of fresh rows with the
    consumed old rows carried along.
    """
    left, right = exploded(fresh, fresh_ord), exploded(existing, old_ord)
    # Keys are costly to make: once for both uses.
    keyed = cut(left.withColumn("side", F.lit("f")).unionByName(right.withColumn("side", F.lit("o"))), "keyed")
    common = keyed.groupBy("key").agg(F.min("side").alias("least"), F.max("side").alias("most")).filter("least <> most")
    sided = (
        keyed.join(shuffled(common.select("key")), "key", "left_semi").filter("node is not null").distinct()
        # Even numbers are fresh rows, odd numbers old ones: distinct vertices.
        .withColumn("vertex", C("node") * 2 + F.when(C("side") == "o", 1).otherwise(0))
        # Two keys of one number would only make one component of theirs.
        .withColumn("number", F.xxhash64("key"))
    )
    sided = cut(sided, "sided")
    # Keys are the nodes and rows what they share: rows of one key, most of all, make no edge.
    shared = shared_pairs(sided.select(C("number").alias("node"), C("vertex").alias("key")))
    parts = key_components(cut(shared, "shared")).withColumnRenamed("node", "number")
    sided = sided.join(shuffled(parts), "number", "left").withColumn("component", F.coalesce("component", "number")).drop("number")
    sided = cut(sided, "sided")
    sizes = cut(sided.groupBy("component").agg(F.count(F.lit(1)).alias("pairs")), "sizes")
    # Components share no key, so many small ones can be settled in one call.
    batches = max(1, (sizes.agg(F.sum("pairs")).first()[0] or 0) // max_component)
    batch = lambda df: df.groupBy(F.pmod(F.xxhash64("component"), F.lit(batches)).alias("b")).applyInPandas(
        _greedy_batch, MATCHED
    )
    if sizes.filter(C("pairs") > max_component).isEmpty():
        return batch(sided)
    of_size = lambda rows, low, high: rows.join(
        shuffled(sizes.filter((C("pairs") > low) & (C("pairs") <= high)).select("component")), "component", "left_semi"
    )
    done = batch(of_size(sided, 0, max_component))
    large = cut(of_size(sided, max_component, 1 << 62), "large")
    hubs = cut(_hub_components(large), "hubs")
    done = done.unionByName(_match_by_rank(large.join(hubs, "component", "left_semi")))
    rest = large.join(hubs, "component", "left_anti")
    whole = max(max_component, 10 * chunk)
    one = of_size(rest, max_component, whole).select("component", "side", "node", "key")
    done = done.unionByName(one.groupBy("component").applyInPandas(_greedy_batch, MATCHED))
    return done.unionByName(_match_in_chunks(of_size(rest, whole, 1 << 62), chunk))


def _hub_components(large: DataFrame) -> DataFrame:
    """Components in which one key is held by every row."""
    rows = large.select("component", "vertex").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    per_key = large.groupBy("component", "key").agg(F.count(F.lit(1)).alias("n"))
    widest = per_key.groupBy("component").agg(F.max("n").alias("n"))
    return widest.join(rows, "component").filter("n = rows").select("component")


def _match_by_rank(rows: DataFrame) -> DataFrame:
    nodes = cut(rows.select("component", "side", "node").distinct(), "hub")
    ranked = rank_within(nodes, ["component", "side"], ["node"], C("node"))
    fresh = ranked.filter("side = 'f'").select("component", "rank", C("node").alias("fresh_ord"))
    old = ranked.filter("side = 'o'").select("component", "rank", C("node").alias("old_ord"))
    return fresh.join(old, ["component", "rank"]).select("fresh_ord", "old_ord")


STEP = "component long, fresh_ord long, old_ord long, key string, head long"


def _greedy_step(pdf: pd.DataFrame) -> pd.DataFrame:
    """Serial choice of fresh rows among the next old rows of each key, as far as these decide it.

    Old rows carry their ``rank`` on the key, whether they are ``taken`` and whether the key has a ``rest`` behind them.
    Returned are pairs, keys with the number of rows at their head that are taken, and the fresh row at which the choice
    had to stop, because a row behind those given might be the first free one.
    """
    component = int(pdf["component"].iat[0])
    fresh, old = pdf[pdf["side"] == "f"].sort_values("node"), pdf[pdf["side"] == "o"].sort_values("node")
    queues: dict[str, list[int]] = {}
    start: dict[str, int] = {}
    rest: dict[str, bool] = {}
    for node, key, rank, more in old[["node", "key", "rank", "rest"]].itertuples(index=False, name=None):
        queues.setdefault(key, []).append(node)
        start.setdefault(key, int(rank) - 1)
        rest[key] = bool(more)
    taken = set(old.loc[old["taken"] == True, "node"].tolist())  # noqa: E712
    heads = dict.fromkeys(queues, 0)
    out = []
    for node, rows in groupby(fresh[["node", "key"]].itertuples(index=False, name=None), key=lambda row: row[0]):
        best = unseen = None
        for _, key in rows:
            queue = queues.get(key)
            if queue is None:
                continue
            at = heads[key]
            while at < len(queue) and queue[at] in taken:
                at += 1
            heads[key] = at
            if at < len(queue):
                best = queue[at] if best is None else min(best, queue[at])
            elif rest[key]:
                unseen = queue[-1] if unseen is None else min(unseen, queue[-1])
        if unseen is not None and (best is None or best > unseen):
            out.append((component, int(node), None, None, None))
            break
        if best is not None:
            taken.add(best)
            out.append((component, int(node), int(best), None, None))
    out += [(component, None, None, key, start[key] + at) for key, at in heads.items() if at]
    made = pd.DataFrame(out, columns=["component", "fresh_ord", "old_ord", "key", "head"])
    return made.astype({n: "Int64" for n in ("component", "fresh_ord", "old_ord", "head")})


def _match_in_chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Rounds in which every component takes the next ``chunk`` of its fresh rows, each against the next old rows of its
    keys only. Components share no key, so a round settles all of them side by side.

    Old rows are numbered per key once. How many at a key's head are taken is kept, so that a step is given about twice
    the rows that its chunk may ask of each key, and goes on behind them where they do not decide; what a task is given
    grows with the chunk, not with the old rows.
    """
    spark = rows.sparkSession
    rows = cut(rows, "chunked")
    fresh, old = rows.filter("side = 'f'"), rows.filter("side = 'o'")
    nodes = cut(fresh.groupBy("component", "node").agg(F.count(F.lit(1)).alias("held")), "nodes")
    most = nodes.agg(F.max("held")).first()[0]
    if not most:
        return spark.createDataFrame([], MATCHED)
    parts_path, matched_path, heads_path = (new_path(spark, label) for label in ("parts", "matched", "heads"))
    part = F.floor((C("rank") - 1) / max(1, chunk // most)).cast("int")
    placed = rank_within(nodes.drop("held"), ["component"], ["node"], C("node")).select("component", "node", part.alias("part"))
    numbered = fresh.join(shuffled(placed), ["component", "node"]).select("component", "node", "key", "side", "part")
    numbered.repartition("part", "component").write.partitionBy("part").parquet(parts_path)
    stored = spark.read.schema(numbered.schema).parquet(parts_path)
    held = old.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    ranked = rank_within(old.select("component", "node", "key"), ["key"], ["node"], C("node")).join(shuffled(held), "key")
    ranked = cut(ranked, "ranked")
    tables = {matched_path: MATCHED, heads_path: "key string, head long"}
    for path, columns in tables.items():
        spark.createDataFrame([], columns).write.parquet(path)
    so_far = lambda path: spark.read.schema(tables[path]).parquet(path)
    for number in range(stored.agg(F.max("part")).first()[0] + 1):
        left = stored.filter(C("part") == number).drop("part")
        while not left.isEmpty():
            asked = left.groupBy("key").agg((F.count(F.lit(1)) * 2 + 16).alias("look"))
            known = so_far(heads_path).groupBy("key").agg(F.max("head").alias("head"))
            asked = asked.join(shuffled(known), "key", "left").select("key", "look", F.coalesce("head", F.lit(0)).alias("head"))
            near = ranked.join(shuffled(cut(asked, "asked")), "key").filter("rank > head and rank <= head + look")
            near = cut(near.select("component", "node", "key", "rank", (C("held") > C("head") + C("look")).alias("rest")), "near")
            gone = so_far(matched_path).select(C("old_ord").alias("node"), F.lit(True).alias("taken"))
            near = near.join(shuffled(gone), "node", "left").withColumn("side", F.lit("o"))
            step = left.unionByName(near, allowMissingColumns=True).groupBy("component").applyInPandas(_greedy_step, STEP)
            step = cut(step, "step")
            step.filter("old_ord is not null").select("fresh_ord", "old_ord").write.mode("append").parquet(matched_path)
            step.filter("key is not null").select("key", "head").write.mode("append").parquet(heads_path)
            stops = step.filter("fresh_ord is not null and old_ord is null").select("component", C("fresh_ord").alias("stop"))
            left = cut(left.join(shuffled(stops), "component").filter("node >= stop").drop("stop"), "left")
    return so_far(matched_path)
