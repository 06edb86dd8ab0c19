"""Two whole scans, one after the other, over stored dimensions and stored state."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright import schema
from listwright.plans import scan
from listwright.queries.base import query, table
from listwright.queries.sources import _payloads, _registry
from listwright.rules import default_rules
from listwright.session import new_path

C = F.col
DAYS = ("2026-08-22 12:00:00", "2026-08-23 12:00:00")


def _listings(spark, d, later: bool):
    """The pages of one scan. Between the scans listings move, change, disappear or stay, by their number."""
    key = C("c_custkey")
    cust = table(spark, d, "customer").select(key.alias("at"), F.lower("c_mktsegment").alias("id"))
    n, case = C("at").cast("string"), C("at") % 10
    nothing = F.lit(None).cast("string")
    eligible = F.when(case == 3, "").otherwise("Penultimate year students of any degree.")
    rec = F.struct(
        F.concat(F.lit("j"), n).alias("id"), F.concat(F.lit("Policy research internship "), n).alias("title"), F.concat(F.lit("/jobs/"), n).alias("url"),
        F.lit("London").alias("location"), F.when(case == 3, "Research analysis.").otherwise("Legal and compliance research.").alias("description"),
        (F.when(case == 1, "Final year only").otherwise(eligible) if later else eligible).alias("eligibility"),
        (F.when(case == 0, "2026-12-01") if later else nothing).alias("deadline"), F.lit(True).alias("paid"), F.lit("2026/27").alias("cycle"),
    )
    rows = cust.filter(case != 2) if later else cust
    pages = _payloads(rows.select("id", "at", F.to_json(rec).alias("rec")), lambda r: F.concat(F.lit('{"jobs":['), F.array_join(r, ","), F.lit("]}")))
    pages = pages.withColumn("fetched_at", F.lit(DAYS[later]).cast("timestamp"))
    if later:
        pages = pages.withColumn("payload", F.when(C("source_id") == "machinery", F.encode(F.lit("not json"), "UTF-8")).otherwise(C("payload")))
    return pages, cust.select("id").distinct()


@query(
    "two_scans",
    """with c as (select c_custkey as k, lower(c_mktsegment) as s, c_custkey % 10 as r, lower(c_mktsegment) = 'machinery' as broken from customer),
    t as (select *, case when r = 1 and not broken then 'closed' when r = 3 then 'possible' else 'open' end as kept_in from c)
    select 'j' || k as source_identifier, s as source_id, kept_in, date '2026-08-22' as first_seen,
      case when broken or (r = 2) then date '2026-08-22' else date '2026-08-23' end as last_seen,
      case when kept_in = 'open' and r = 2 and not broken then 1 else 0 end as missing,
      case when r = 0 and not broken then date '2026-12-01' end as deadline, r = 4 and not broken as email_approved,
      case when broken then 'failed' else 'healthy' end as health from t""",
)
def two_scans(spark, d):
    """Where every listing is after the second scan: moved, closed by policy, missing, possible, or in a source that broke."""
    dims, root = new_path(spark, "dims"), new_path(spark, "scan-state")
    pages, sources = _listings(spark, d, False)
    registry = _registry(spark, d, "generic_json", sources, priority_tier=F.lit("priority"), uk_priority_exception=F.lit(False),
                         poll_interval_minutes=F.lit(0), expected_min_items=F.lit(0))
    registry.write.json(f"{dims}/registry")
    spark.createDataFrame([], schema.EXPECTED).write.json(f"{dims}/expected")
    spark.createDataFrame([], schema.OVERRIDES).write.json(f"{dims}/overrides")
    loaded = scan.load_dimensions(spark, dims, default_rules())
    scan.save_state(scan.run_scan(pages, scan.load_state(spark, root), loaded, F.lit(DAYS[0]).cast("timestamp")), root, "1")

    stored = scan.load_state(spark, root)
    chosen = stored.open.filter(F.regexp_extract("source_identifier", r"(\d)$", 1) == "4")
    chosen.select(C("id").alias("role_id"), F.lit(True).alias("email_approved"), F.lit("read").alias("reason")).write.mode("append").json(f"{dims}/overrides")
    loaded = scan.load_dimensions(spark, dims, default_rules())
    pages, _ = _listings(spark, d, True)
    scan.save_state(scan.run_scan(pages, stored, loaded, F.lit(DAYS[1]).cast("timestamp")), root, "2")

    after = scan.load_state(spark, root)
    health = after.health.select(C("source_id").alias("source_registry_id"), C("status").alias("health"))
    kept = None
    for name in ("open", "recent", "possible", "closed"):
        part = getattr(after, name).withColumn("kept_in", F.lit(name))
        kept = part if kept is None else kept.unionByName(part)
    return kept.join(health, "source_registry_id", "left").select(
        "source_identifier", C("source_registry_id").alias("source_id"), "kept_in", F.to_date("first_seen_at").alias("first_seen"),
        F.to_date("last_seen_at").alias("last_seen"), C("consecutive_missing_count").alias("missing"), "deadline", "email_approved", "health",
    )
