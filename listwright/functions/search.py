"""Ranked text search over facet columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Latin letters whose compatibility form is one ASCII letter plus marks."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = [ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch)]
        if len(base) == 1 and base[0].isascii() and base[0].isalpha():
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


_FROM, _TO = _accent_table()


def search_text(c: Column) -> Column:
    """Accent-free words; ``&`` reads ``and``."""
    plain = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _FROM, _TO), "[̀-ͯ]", "")
    plain = F.regexp_replace(plain, r"[cC](?<![A-Za-z0-9_][cC])\s*\+\s*\+", " cplusplus ")
    plain = F.lower(F.replace(plain, F.lit("&"), F.lit(" and ")))
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def search_term(value: str | None) -> str:
    """``search_text`` for a query known when the plan is built."""
    import re

    plain = "".join(
        ch for ch in unicodedata.normalize("NFKD", value or "") if not "̀" <= ch <= "ͯ"
    )
    plain = re.sub(r"\bc\s*\+\s*\+", " cplusplus ", plain, flags=re.I | re.A)
    return " ".join(re.findall(r"[a-z0-9]+", plain.replace("&", " and ").lower()))


def all_words(text: Column, query: str | None) -> Column:
    """Every query word is a substring of the (already normalised) text."""
    out = F.lit(True)
    for word in search_term(query).split():
        out = out & F.contains(text, F.lit(word))
    return out


def field_score(text: Column, query: str | None) -> Column:
    """100 equal, 75 prefix, 50 substring, 20 all words, else 0."""
    phrase = search_term(query)
    if not phrase:
        return F.lit(0)
    return (
        F.when(text == phrase, 100)
        .when(F.startswith(text, F.lit(phrase)), 75)
        .when(F.contains(text, F.lit(phrase)), 50)
        .when(all_words(text, phrase), 20)
        .otherwise(0)
    )


def search_score(title: Column, broad: Column, company: Column, query: str | None, company_query: str | None) -> Column:
    return field_score(title, query) * 2 + field_score(broad, query) + field_score(company, company_query) * 3


def any_substring(c: Column, terms: Sequence[str]) -> Column:
    """Quick category filter: any term occurs; no terms means no filter."""
    if not terms:
        return F.lit(True)
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(F.lower(c), F.lit(term))
    return out
