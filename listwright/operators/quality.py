"""Data-quality operators: each returns violation rows, none means clean."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listwright.functions import text, urls
from listwright.operators.classify import is_public, with_possible
from listwright.rules.ruleset import COMPONENTS, RuleSet
from listwright.schema import DOMAINS

C = F.col


def violations(df: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """``(key, rule)`` for every rule a row breaks: one pass, however many rules."""
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()])
    )
    return df.select(key.cast("string").alias("key"), F.explode(broken).alias("rule"))


def check_schema(df: DataFrame, ddl: str, key: str) -> DataFrame:
    """Missing or extra columns as table-level rows; NULL keys and bad enum values as row-level ones."""
    want = {f.name: f.dataType for f in StructType.fromDDL(ddl)}
    have = {f.name: f.dataType for f in df.schema}
    shape = [("table", f"missing column {n}") for n in want if n not in have]
    shape += [("table", f"unknown column {n}") for n in have if n not in want]
    shape += [("table", f"type of {n}") for n in want if n in have and have[n].simpleString() != want[n].simpleString()]
    rows = df.sparkSession.createDataFrame(shape, "key string, rule string")
    tests = {f"value of {n}": ~C(n).isin(*values) for n, values in DOMAINS.items() if n in have and n in want}
    tests[f"empty {key}"] = C(key).isNull() | (C(key).cast("string") == "")
    return rows.unionByName(violations(df, C(key), tests))


def check_boundary(verified: DataFrame, possible: DataFrame, rules: RuleSet) -> DataFrame:
    """Rows published in a tier they do not belong to."""
    leaked = lambda df: F.lit("manual_override" in df.columns)
    guard = lambda df: df if "manual_override" in df.columns else df.withColumn("manual_override", F.lit(None).cast("string"))
    first = violations(
        guard(verified),
        C("id"),
        {
            "unverified row in verified tier": C("eligibility_status").isin("uncertain", "ineligible"),
            "outside verified boundary": ~is_public(),
            "override column published": leaked(verified),
        },
    )
    flagged = with_possible(guard(possible), rules)
    second = violations(
        flagged,
        C("id"),
        {
            "ineligible row in possible tier": C("eligibility_status") == "ineligible",
            "outside possible boundary": ~C("is_possible"),
            "override column published": leaked(possible),
        },
    )
    return first.withColumn("tier", F.lit("verified")).unionByName(second.withColumn("tier", F.lit("possible")))


def coverage_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, or has more often."""
    left, right = a.select(key), b.select(key)
    return (
        left.exceptAll(right).withColumn("side", F.lit("left only"))
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("right only")))
    )


def check_coverage(verified: DataFrame, possible: DataFrame, index: DataFrame, key: str = "id") -> DataFrame:
    """Ids in both tiers, and ids the index lacks, invents or repeats."""
    both = verified.select(key).intersect(possible.select(key)).withColumn("side", F.lit("both tiers"))
    return both.unionByName(coverage_diff(verified.select(key).unionByName(possible.select(key)), index, key))


def check_leaks(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Secrets and contact addresses in text columns: ``(key, rule)``."""
    parts = []
    for name in columns:
        parts.append(text.secret_labels(C(name)))
        parts.append(F.array_compact(F.array(F.when(text.has_email(C(name)), F.lit("email address")))))
    found = F.array_distinct(F.concat(*parts))
    return df.select(C(key).cast("string").alias("key"), F.explode(found).alias("rule"))


def repeated(df: DataFrame, key: str, rule: str) -> DataFrame:
    return (
        df.groupBy(C(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("key", F.lit(rule).alias("rule"))
    )


def check_registry(registry: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    web = lambda n: C(n).isNotNull() & (C(n) != "") & ~urls.scheme(C(n)).isin("http", "https")
    blank = lambda n: F.coalesce(C(n), F.lit("")) == ""
    tests = {
        "enabled without endpoint": C("enabled") & blank("endpoint"),
        "exception without reason": C("uk_priority_exception") & blank("exception_reason"),
        "discovery source without review": C("enabled")
        & (C("source_authority") == "discovery_only_source")
        & ~C("manual_review_required"),
        "POST without body": (C("request_method") == "POST") & C("request_body").isNull(),
        "careers_url not http": web("careers_url"),
        "endpoint not http": web("endpoint"),
        "curated file of another kind": C("curated_file").isNotNull() & (C("ats_type") != "curated_yaml"),
        "setting name shape": F.exists(
            F.coalesce("required_settings", F.array().cast("array<string>")), lambda s: ~F.rlike(s, F.lit("^[A-Z][A-Z0-9_]*$"))
        ),
    }
    if kinds:
        tests["unknown kind"] = ~C("ats_type").isin(*kinds)
    return repeated(registry, "id", "repeated id").unionByName(violations(registry, C("id"), tests))


def check_rules(rules: DataFrame) -> DataFrame:
    """Blank phrases and repeats (ignoring case) within a list of the phrase table."""
    blank = violations(rules, F.concat_ws("/", "kind", "rule"), {"blank phrase": F.trim("term") == ""})
    twice = (
        rules.filter(C("kind").isin("hard_exclusions", "title_inclusions", "title_exclusions", "context_exclusions"))
        .groupBy(F.concat_ws("/", "kind", "rule").alias("key"), text.casefold(F.trim("term")).alias("_t"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("key", F.concat(F.lit("repeated phrase: "), "_t").alias("rule"))
    )
    return blank.unionByName(twice)


def check_weights(weights: DataFrame) -> DataFrame:
    """Weights must be the eight known components and total 100."""
    known = violations(weights, C("component"), {"unknown component": ~C("component").isin(*COMPONENTS), "negative": C("w") < 0})
    total = weights.agg(F.sum("w").alias("s"), F.count_distinct("component").alias("n"))
    bad = violations(total, F.lit("weights"), {"total is not 100": C("s") != 100, "component count": C("n") != len(COMPONENTS)})
    return known.unionByName(bad)


def taxonomy_diff(terms: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Categories with phrases but no taxonomy entry, and the reverse."""
    a, b = terms.select("category").distinct(), taxonomy.select("category").distinct()
    return (
        a.exceptAll(b).withColumn("side", F.lit("not in taxonomy")).unionByName(b.exceptAll(a).withColumn("side", F.lit("without phrases")))
    )


def check_domains(df: DataFrame, key: str, domains: Mapping[str, Sequence[str]], https: Sequence[str] = ()) -> DataFrame:
    """Values outside their closed vocabulary and links that are not https."""
    tests = {f"{n} out of domain": ~C(n).isin(*values) for n, values in domains.items()}
    tests.update({f"{n} not https": urls.scheme(C(n)) != "https" for n in https})
    return violations(df, C(key), tests)
