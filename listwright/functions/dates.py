"""Date functions. The clock is always a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.functions.text import board_text, html_to_text, squeeze

# Date shapes tried in order, then an ISO date inside the text.
DATE_FORMATS = ("yyyy-M-d", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy")


def parse_date(c: Column) -> Column:
    """Date of a text in one of the known shapes; RFC 822 dates stay NULL."""
    text = squeeze(F.regexp_replace(c, r"(?iU)(?<=\d)(?:st|nd|rd|th)\b", ""))
    head = F.substring(text, 1, 30)
    tries = [F.try_to_date(head, fmt) for fmt in DATE_FORMATS]
    inside = F.try_to_date(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")
    return F.coalesce(*tries, inside)


def epoch_date(c: Column) -> Column:
    """Date of epoch seconds, or milliseconds above 1e10."""
    n = c.cast("double")
    seconds = F.when(n > F.lit(1e10), n / 1000).otherwise(n)
    return F.to_date(F.timestamp_seconds(F.floor(seconds)))


def relative_date(c: Column, as_of: Column) -> Column:
    """``today``, ``3 days ago``, ``2 weeks ago``, else a written date."""
    text = board_text(c)
    days = F.nullif(F.regexp_extract(text, r"(\d+) days? ago", 1), F.lit("")).try_cast("int")
    weeks = F.nullif(F.regexp_extract(text, r"(\d+) weeks? ago", 1), F.lit("")).try_cast("int")
    return (
        F.when(text.isin("today", "posted today"), as_of)
        .when(days.isNotNull(), F.date_sub(as_of, days))
        .when(weeks.isNotNull(), F.date_sub(as_of, weeks * 7))
        .otherwise(parse_date(c))
    )


def _day_of(c: Column, year: Column) -> Column:
    dated = F.concat_ws(" ", c, year.cast("string"))
    return F.coalesce(F.try_to_date(dated, "d MMM yyyy"), F.try_to_date(dated, "d MMMM yyyy"))


def yearless_date(c: Column, future: bool, as_of: Column) -> Column:
    """Day and month placed in the nearest sensible year; 29 February may have none."""
    text = html_to_text(c)
    this_year = _day_of(text, F.year(as_of))
    if future:
        moved = F.when(this_year < F.date_sub(as_of, 2), _day_of(text, F.year(as_of) + 1))
        keep = this_year >= F.date_sub(as_of, 2)
    else:
        moved = F.when(this_year > F.date_add(as_of, 2), _day_of(text, F.year(as_of) - 1))
        keep = this_year <= F.date_add(as_of, 2)
    return F.when(this_year.isNull(), parse_date(text)).when(keep, this_year).otherwise(moved)


def recency_ratio(published: Column, as_of: Column) -> Column:
    age = F.greatest(F.datediff(as_of, F.coalesce(published, as_of)), F.lit(0))
    return F.when(age <= 7, 1.0).when(age <= 30, 0.5).otherwise(0.0)


def urgency_ratio(deadline: Column, as_of: Column) -> Column:
    left = F.datediff(deadline, as_of)
    return F.when(left.between(0, 14), 1.0).when(left.between(15, 30), 0.5).otherwise(0.0)


def is_new(first_seen: Column, now: Column, hours: int = 24) -> Column:
    return first_seen >= now - F.expr(f"INTERVAL {hours} HOURS")


def is_closing(deadline: Column, now: Column, days: int = 7) -> Column:
    """Due within ``days``; past deadlines count too."""
    return F.coalesce(deadline <= F.date_add(F.to_date(now), days), F.lit(False))


def date_label(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd MMM yyyy"), F.lit("Not stated"))


def programme_window(start: Column, months: Sequence[int] = (6, 7, 8), year: int = 2027) -> Column:
    return F.coalesce((F.year(start) == year) & F.month(start).isin(*months), F.lit(False))


def window_floor(ts: Column, minutes: int) -> Column:
    if minutes < 1:
        raise ValueError("minutes must be positive")
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / step) * step)


def confirm_decision(status: Column, expiry: Column, now: Column) -> Column:
    return (
        F.when(status == "confirmed", "already_confirmed")
        .when(~status.eqNullSafe(F.lit("pending")), "invalid")
        .when(expiry.isNull() | (expiry < now), "expired")
        .otherwise("confirm")
    )


def unsubscribe_decision(record_id: Column, status: Column) -> Column:
    return F.when(record_id.isNull() | (status == "unsubscribed"), "already_or_unknown").otherwise(
        "unsubscribe"
    )
