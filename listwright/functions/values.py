"""Numbers, arrays, maps and JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from listwright.functions.constants import constant_map
from listwright.functions.text import board_text, strip
from listwright.functions.urls import host


def salary_range(low: Column, high: Column, currency: Column | None = None) -> Column:
    """``£25,000-£30,000``; one figure when the ends agree or one is missing."""
    code = F.upper(F.coalesce(currency, F.lit("GBP")) if currency is not None else F.lit("GBP"))
    prefix = F.when(code == "GBP", F.lit("£")).otherwise(F.concat(code, F.lit(" ")))
    number = lambda c: F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")
    lo, hi = F.coalesce(number(low), number(high)), F.coalesce(number(high), number(low))
    shown = lambda c: F.concat(prefix, F.format_number(c, 0))
    return F.when(lo.isNull(), F.lit(None)).when(lo == hi, shown(lo)).otherwise(
        F.concat_ws("-", shown(lo), shown(hi))
    )


def salary_text(salary: Column) -> Column:
    """Text of a ``struct<currency,lower,upper>``."""
    blank = lambda name: F.nullif(strip(salary[name]), F.lit(""))
    lower, upper = blank("lower"), blank("upper")
    amount = F.when(lower == upper, lower).otherwise(F.nullif(F.concat_ws("-", lower, upper), F.lit("")))
    return F.nullif(F.concat_ws(" ", blank("currency"), amount), F.lit(""))


# Tenant hosts and brand spellings that were checked by hand.
TENANT_NAMES = {
    "jd.wd103.myworkdayjobs.com": "Jingdong Retail (UK) Limited",
    "cc.wd3.myworkdayjobs.com": "CHANEL",
}
BRAND_NAMES = {
    "blackrock": "BlackRock",
    "gp bullhound": "GP Bullhound",
    "house of cb": "House of CB",
    "me em": "ME+EM",
    "onetrust": "OneTrust",
}


def _map(table: Mapping[str, str]) -> Column:
    return constant_map(table)


def employer_of(
    candidates: Sequence[Column],
    url: Column,
    tenants: Mapping[str, str] = TENANT_NAMES,
    brands: Mapping[str, str] = BRAND_NAMES,
) -> Column:
    """Checked tenant name, else the first filled candidate in its checked spelling."""
    named = F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates], F.lit("Employer not stated"))
    return F.coalesce(
        F.try_element_at(_map(tenants), host(url)),
        F.try_element_at(_map(brands), board_text(named)),
        named,
    )


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def clamp(hits: Column, n: int) -> Column:
    return F.least(F.lit(1.0), hits / F.lit(float(n)))


def components(ratios: Mapping[str, Column], weights: Mapping[str, int]) -> Column:
    pairs: list[Column] = []
    for name, ratio in ratios.items():
        pairs += [F.lit(name), half_even(F.lit(float(weights[name])) * ratio)]
    return F.create_map(*pairs)


def total(parts: Column) -> Column:
    return F.aggregate(F.map_values(parts), F.lit(0), lambda a, b: a + b)


def split_list(c: Column, sep: str = "|") -> Column:
    return F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), f"[{sep}]"), strip), lambda item: item != ""
    )


def distinct_ordered(c: Column) -> Column:
    return F.array_distinct(c)


def array_union_ordered(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def evidence_union(a: Column, b: Column) -> Column:
    """``a`` plus the items of ``b`` that ``a`` lacks; repeats inside ``b`` stay."""
    return F.concat(a, F.filter(b, lambda item: ~F.array_contains(a, item)))


def keys_overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def first_of(*arrays: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.try_element_at(F.concat(*[F.coalesce(a, empty) for a in arrays]), F.lit(1))


def array_tail(c: Column, n: int) -> Column:
    """Last ``n`` items in insertion order."""
    return F.slice(c, F.greatest(F.lit(1), F.size(c) - (n - 1)), n)


def decode_json(c: Column, schema: str | DataType) -> Column:
    """Typed value of a JSON text; NULL when it does not parse."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def embedded_json(c: Column, pattern: str, schema: str) -> Column:
    """JSON object inside a page, found by pattern (group 1)."""
    return decode_json(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), schema)


def stable_json(df: DataFrame) -> Column:
    """One JSON text per row with the columns in name order."""
    return F.to_json(F.struct(*[F.col(name) for name in sorted(df.columns)]))
