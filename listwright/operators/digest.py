"""Incremental digests and subscriber state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions import dates, text, values
from listwright.operators.classify import digest_eligible
from listwright.operators.ordered import hash_tree
from listwright.session import cut

C = F.col



def digest_order(now: Column) -> list[Column]:
    soon = C("deadline") <= F.date_add(F.to_date(now), 7)
    group = (
        F.when(C("eligibility_status") == "verified_eligible", 0)
        .when(C("eligibility_status") == "manual_approved", 1)
        .when(soon, 2)
        .when(F.contains("programme_type", F.lit("vacation_scheme")), 3)
        .when(C("programme_type") == "summer_internship_2027", 4)
        .when(C("programme_type").isin("policy_research_internship", "parliamentary_office_internship"), 5)
        .otherwise(6)
    )
    return [group, text.casefold(C("canonical_employer")), text.casefold(C("title"))]


def unsent(records: DataFrame, sent: DataFrame, last_success: Column | None) -> DataFrame:
    """Rows seen since the last success whose id was never sent."""
    fresh = records if last_success is None else records.filter(C("last_seen_at") > last_success)
    return fresh.join(sent.select("id").distinct(), "id", "left_anti")


def global_rank(df: DataFrame, order: list[Column], into: str = "position") -> DataFrame:
    """0-based position in a total order: a range-partitioned sort plus per-partition offsets."""
    sorted_rows = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_m", 33)
    sizes = sorted_rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per sort partition: a running sum over few rows.
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - C("_n")).alias("_before"))
    return (
        sorted_rows.withColumn("_p", part)
        .join(before, "_p")
        .withColumn(into, C("_before") + F.expr("_m & ((1L << 33) - 1)"))
        .drop("_m", "_p", "_before")
    )


def digest_id(ranked: DataFrame, id_column: str = "id", position: str = "position", fan: int = 4096) -> DataFrame:
    """First 20 hex digits of the hash tree over the ordered ids, one row; of the empty text for no ids."""
    whole = hash_tree(ranked, [], position, id_column, "whole", "|", fan)
    return whole.agg(F.substring(F.coalesce(F.max("whole"), F.sha2(F.lit("").cast("binary"), 256)), 1, 20).alias("digest_id"))


def select_digest(
    records: DataFrame, sent: DataFrame, last_success: Column | None, now: Column
) -> tuple[DataFrame, DataFrame]:
    """``(selected rows with position, digest id)``."""
    chosen = unsent(records, sent, last_success).filter(digest_eligible())
    group, employer, title = digest_order(now)
    keyed = chosen.withColumns({"_g": group, "_e": employer, "_t": title})
    # Only the order's columns are written and sorted; whole rows join their position. A sort reads its rows twice,
    # once for the bounds of its ranges, so they are derived before it.
    narrow = cut(keyed.select("id", "ord", "_g", "_e", "_t"), "chosen")
    ranked = global_rank(narrow, [C("_g"), C("_e"), C("_t"), C("ord"), C("id")]).withColumnRenamed("_g", "digest_group")
    ranked = ranked.drop("_e", "_t")
    return chosen.join(ranked, ["id", "ord"]), digest_id(ranked)


def advance_state(
    sent: DataFrame, selected: DataFrame, runs: DataFrame, outcome: str, digest: str | None, now: Column, *, keep_runs: int
):
    """``(sent ids, run log of the last ``keep_runs`` runs)`` after an outcome; a failure leaves the state alone."""
    if outcome not in ("sent", "no_confirmed_recipients", "no_new_roles"):
        return sent, runs
    if outcome != "no_new_roles":
        sent = sent.select("id").unionByName(selected.select("id")).distinct()
    entry = sent.sparkSession.range(1).select(
        now.alias("at"), F.lit(outcome).alias("outcome"), F.lit(digest).cast("string").alias("digest_id")
    )
    return sent, runs.unionByName(entry).orderBy(F.desc("at")).limit(keep_runs)


def pending_recipients(subscribers: DataFrame, digest: Column) -> DataFrame:
    """Confirmed subscribers who have not had this digest."""
    return subscribers.filter((C("status") == "confirmed") & ~C("last_digest_sent").eqNullSafe(digest))


def deliveries(subscribers: DataFrame, digest: Column) -> DataFrame:
    return pending_recipients(subscribers, digest).select(
        "email", text.idempotency_key(digest, C("email")).alias("delivery_key")
    )


# --- subscriptions --------------------------------------------------------------------------


def may_reopen(now: Column) -> Column:
    """An existing row takes a new request only when it is over or its confirmation lapsed."""
    lapsed = C("confirmation_expires_at").isNull() | (C("confirmation_expires_at") < now)
    return C("status").isin("unsubscribed", "bounced") | ((C("status") == "pending") & lapsed)


def upsert_subscriptions(state: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """State after requests ``(email, token_hash, expires_at)``, one per address, with ``changed``."""
    wanted = requests.select(
        text.normalise_email(C("email")).alias("email"), C("token_hash").alias("_token"), C("expires_at").alias("_until")
    ).filter(C("email").isNotNull())
    known = state.withColumn("_known", F.lit(True))
    df = known.join(wanted, "email", "full_outer")
    asked = C("_token").isNotNull()
    take = asked & (C("_known").isNull() | may_reopen(now))
    new = {
        "id": F.coalesce("id", F.sha2("email", 256)),
        "status": F.lit("pending"),
        "created_at": now,
        "confirmed_at": F.lit(None).cast("timestamp"),
        "unsubscribed_at": F.lit(None).cast("timestamp"),
        "confirmation_token_hash": C("_token"),
        "confirmation_expires_at": C("_until"),
        "unsubscribe_token_hashes": F.coalesce("unsubscribe_token_hashes", F.array().cast("array<string>")),
        "delivery_failure_status": F.lit(None).cast("string"),
    }
    out = [F.when(take, new[n]).otherwise(C(n)).alias(n) if n in new else C(n) for n in state.columns]
    return df.select(*out, F.coalesce(take, F.lit(False)).alias("changed"))


def subscription_transitions(state: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Decision and next status for ``(email, action)`` events, action ``confirm`` or ``unsubscribe``."""
    df = events.join(state, "email", "left")
    decision = F.when(
        C("action") == "confirm", dates.confirm_decision(C("status"), C("confirmation_expires_at"), now)
    ).otherwise(dates.unsubscribe_decision(C("id"), C("status")))
    return df.select(
        "email",
        "action",
        decision.alias("decision"),
        F.when(decision == "confirm", "confirmed")
        .when(decision == "unsubscribe", "unsubscribed")
        .otherwise(C("status"))
        .alias("next_status"),
    )


def add_unsubscribe_token(state: DataFrame, tokens: DataFrame, keep: int = 20) -> DataFrame:
    """Append one token per confirmed address, keeping the newest ``keep``."""
    df = state.join(tokens.select("email", C("token_hash").alias("_token")), "email", "left")
    grown = values.array_tail(F.array_append("unsubscribe_token_hashes", C("_token")), keep)
    take = C("_token").isNotNull() & (C("status") == "confirmed")
    return df.withColumn(
        "unsubscribe_token_hashes", F.when(take, grown).otherwise(C("unsubscribe_token_hashes"))
    ).select(*state.columns)


def prune(state: DataFrame, now: Column, days: int = 30) -> DataFrame:
    old = (C("status") == "pending") & (C("created_at") < now - F.expr(f"INTERVAL {days} DAYS"))
    return state.filter(~F.coalesce(old, F.lit(False)))


def prune_windows(counts: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    return counts.filter(C("window_started_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))


def window_counts(events: DataFrame, key: str, at: str, minutes: int, limit: int) -> DataFrame:
    """Requests per key and tumbling window, and whether the window stayed within the limit."""
    return (
        events.groupBy(key, dates.window_floor(C(at), minutes).alias("window_started_at"))
        .agg(F.count(F.lit(1)).alias("request_count"))
        .withColumn("allowed", C("request_count") <= limit)
    )
