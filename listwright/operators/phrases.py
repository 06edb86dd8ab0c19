"""Phrase matching against rule tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.constants import constant
from listwright.functions.text import normalise_term, padded

# Up to this many phrases a chain of compiled substring tests beats the token lookup: one test
# costs a few microseconds on a long text, hashing its tokens costs about as much as 200 tests.
CHAIN_LIMIT = 200


def strings(items: Iterable[str]) -> Column:
    return constant(list(items))


def barrier(df: DataFrame) -> DataFrame:
    """Keep later filters above this point, while columns that nothing reads are still left out below it.

    A filter on a derived column is otherwise pushed below every projection by substituting the
    column's whole definition, which multiplies deep rule expressions. Filters do not pass a row number; every row
    passes its test.
    """
    marked = df.withColumn("_barrier", F.monotonically_increasing_id())
    return marked.filter(F.col("_barrier") >= 0).drop("_barrier")


def words(terms: Iterable[str]) -> list[str]:
    """Distinct normalised phrases in list order, blanks dropped."""
    return list(dict.fromkeys(w for w in map(normalise_term, terms) if w))


def with_hits(df: DataFrame, wanted: Mapping[str, tuple[Column, Iterable[str]]]) -> DataFrame:
    """Add, per entry, the array of phrases that occur in a normalised text column.

    Single words come from one set intersection with the text's distinct tokens. Longer phrases
    are tested only when their first word is among the tokens, so a vocabulary of hundreds of
    phrases costs about one pass over the text.
    """
    tokens: dict[str, Column] = {}
    hits: dict[str, Column] = {}
    for name, (text, terms) in wanted.items():
        vocabulary = words(terms)
        if len(vocabulary) <= CHAIN_LIMIT:
            hits[name] = strings([])
            if vocabulary:
                tokens[f"_padded_{name}"] = padded(text)
                seen = F.col(f"_padded_{name}")
                # Normalised phrases hold letters, digits and blanks only, so as patterns they are themselves. The search
                # of a pattern skips ahead; ``contains`` stops at every blank, with which each phrase begins.
                tests = [F.when(F.rlike(seen, F.lit(f" {t} ")), F.lit(t)) for t in vocabulary]
                hits[name] = F.array_compact(F.array(*tests))
            continue
        token_column = f"_tokens_{name}"
        tokens[token_column] = F.array_distinct(F.split(text, " "))
        seen = F.col(token_column)
        single = F.array_intersect(strings(t for t in vocabulary if " " not in t), seen)
        longer = [t for t in vocabulary if " " in t]
        if not longer:
            hits[name] = single
            continue
        firsts = F.array_intersect(strings(dict.fromkeys(t.split()[0] for t in longer)), seen)
        table = constant([{"f": t.split()[0], "t": t} for t in longer])
        found = F.filter(table, _occurs_in(padded(text), firsts))
        hits[name] = F.concat(single, F.transform(found, lambda row: row["t"]))
    if tokens:
        df = df.withColumns(tokens)
    return df.withColumns(hits).drop(*tokens)


def _occurs_in(text: Column, firsts: Column):
    return lambda row: F.array_contains(firsts, row["f"]) & F.contains(text, padded(row["t"]))


def any_hit(hits: Column, terms: Iterable[str]) -> Column:
    vocabulary = words(terms)
    return F.arrays_overlap(hits, strings(vocabulary)) if vocabulary else F.lit(False)


def first_hit(hits: Column, terms: Iterable[str]) -> Column:
    """First phrase in list order that was hit, normalised; NULL without a hit."""
    return F.try_element_at(F.array_intersect(strings(words(terms)), hits), F.lit(1))


def phrase_hits(df: DataFrame, key: str, text: Column, rules: DataFrame) -> DataFrame:
    """Join form for vocabularies too large for a literal: ``(key, kind, rule, term, ord)`` per hit.

    Each row gives its distinct windows of as many tokens as the longest phrase has. A window meets
    the phrases that start with its first token on equality and keeps those it begins with, so the
    work grows with the text and not with text times vocabulary, and no row carries a whole text.
    ``text`` is normalised and the phrase table holds its normalised form in ``phrase``.
    """
    longest = rules.agg(F.max(F.size(F.split("phrase", " "))).alias("n")).first()["n"] or 1
    tokens = df.select(key, F.split(text, " ").alias("_t"))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("_t")), lambda i: F.array_join(F.slice(F.col("_t"), i, longest), " ")
    )
    spans = tokens.select(key, F.explode(F.array_distinct(windows)).alias("_w"))
    spans = spans.withColumn("_first", F.substring_index("_w", " ", 1))
    table = rules.withColumn("_first", F.substring_index("phrase", " ", 1))
    after = lambda c: F.concat(c, F.lit(" "))
    found = spans.join(table, "_first").filter(F.startswith(after(F.col("_w")), after(F.col("phrase"))))
    return found.select(key, "kind", "rule", "term", "ord").distinct()


def first_phrase(hits: DataFrame, key: str) -> DataFrame:
    """First phrase in list order per row and kind."""
    return hits.groupBy(key, "kind").agg(F.min_by("term", "ord").alias("term"), F.min("ord").alias("ord"))
