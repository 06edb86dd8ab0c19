"""Line dedup by a fixed-depth tree of line templates, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.storage import Scratch

C = F.col


@dataclass(frozen=True)
class Settings:
    #: Distinct texts that must hold a template's lines before it counts as recurring.
    texts: int = 5
    #: Leading tokens that lead from a token count to a leaf of the tree.
    depth: int = 3
    #: Share of a line's tokens that must be constant in its template.
    constant: float = 0.7


BLANK = " \t\r\f"


def masked(line: F.Column) -> F.Column:
    """The trimmed line with every token that holds a digit replaced by ``<*>``."""
    # Anchored at a token's start and without backtracking, so a very long token costs no more than its length.
    return F.regexp_replace(F.btrim(line, F.lit(BLANK)), r"(?<![^ \t\r\f])[^ \t\r\f0-9]*+[0-9][^ \t\r\f]*", "<*>")


def tokens(text: F.Column) -> F.Column:
    return F.split(text, r"[ \t\r\f]+")


def recurring_lines(scratch: Scratch, docs: DataFrame, s: Settings) -> DataFrame:
    """``(doc_id, text_key, drop)``: positions of the lines to drop, per document that has any.

    The tree has a level for the token count and one for each of the first ``depth`` tokens, tokens with digits being
    variable. In a leaf, a token is constant at its place if lines of ``texts`` texts have it there; other places are
    variable. Lines with equal constants are one template. It recurs if at least ``texts`` distinct texts hold it and
    ``constant`` of its tokens are constant. The first line of a template, by document id and place, stays.
    """
    form = masked(C("line"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.filter(F.btrim("line", F.lit(BLANK)) != "").select("doc_id", "text_key", "pos", form.alias("form"))
    parts = tokens(C("form"))
    leaf = F.xxhash64(F.size(parts), F.slice(parts, 1, s.depth))
    rows = scratch.keep(rows.select("doc_id", "text_key", "pos", leaf.alias("leaf"), F.xxhash64("form").alias("form")), "rows")

    leaves = rows.select("leaf", "text_key").distinct().groupBy("leaf").count().filter(C("count") >= s.texts).select("leaf")
    known = rows.join(leaves, "leaf")
    # One row a text and form, then one a form: a form that a third of all texts hold is a single row from here on.
    held = known.groupBy("leaf", "form", "text_key").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    forms = held.groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("at", "text_key")).alias("w"))
    forms = scratch.keep(forms.select("leaf", "form", "texts", C("w.at.doc_id").alias("doc_id"), "w.text_key", C("w.at.pos").alias("pos")), "forms")

    # The line behind each form, read from one document that has it.
    wanted = forms.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("pos", "leaf", "form", "texts")).alias("wanted"))
    texts = with_rows(docs, wanted, "inner").select("text", F.explode("wanted").alias("w"))
    line = F.get(F.split("text", "\n"), C("w.pos"))
    words = texts.select("w.leaf", "w.form", "w.texts", F.posexplode(tokens(masked(line))).alias("place", "token"))
    words = scratch.keep(words.select("leaf", "form", "texts", "place", F.xxhash64("token").alias("token")).distinct(), "words")
    constants = words.groupBy("leaf", "place", "token").agg(F.sum("texts").alias("n")).filter(C("n") >= s.texts)
    fixed = words.join(constants.select("leaf", "place", "token"), ["leaf", "place", "token"])
    fixed = fixed.groupBy("leaf", "form").agg(
        F.bit_xor(F.xxhash64("place", "token")).alias("template"), F.count(F.lit(1)).alias("fixed")
    )
    sizes = words.groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("size"))
    fixed = fixed.join(sizes, ["leaf", "form"]).filter(C("fixed") >= s.constant * C("size")).select("leaf", "form", "template")

    templates = held.join(fixed, ["leaf", "form"]).groupBy("leaf", "template", "text_key").agg(F.min("at").alias("at"))
    templates = templates.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    templates = templates.filter(C("n") >= s.texts).select("leaf", "template", "first")
    bad = scratch.keep(fixed.join(templates, ["leaf", "template"]).select("leaf", "form", "first"), "bad")
    drops = rows.join(bad, ["leaf", "form"]).filter(~F.struct("doc_id", "pos").eqNullSafe(C("first")))
    return drops.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def with_rows(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """``docs`` with the columns of ``other`` for its id, which may be null, and its text."""
    extra = [c for c in other.columns if c not in ("doc_id", "text_key")]
    other = other.select(C("doc_id").alias("_id"), C("text_key").alias("_key"), *extra)
    same = docs["doc_id"].eqNullSafe(other["_id"]) & (F.xxhash64(docs["text"]) == other["_key"])
    # A merge at every size: the other side grows with the documents, so its being small once proves nothing.
    return docs.join(other.hint("merge"), same, how).drop("_id", "_key")


def drop_lines(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``text`` without recurring lines, and ``n_lines`` and ``dropped`` (0-based places) after its columns.

    Copies of a whole text count as one text, so a template must recur in texts that differ; near-duplicate
    detection deals with the copies. Blank lines stay and belong to no template. A null text stays null, with 0 lines
    and nothing dropped; an empty text is one blank line. Repeated rows lose the same lines. Columns named
    ``n_lines`` or ``dropped`` are replaced; all others are passed through. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "lines")
    narrow = docs.select("doc_id", "text")
    drops = scratch.keep(recurring_lines(scratch, narrow, settings), "drops").withColumnRenamed("drop", "_drop")
    base = docs.drop("n_lines", "dropped")
    joined = with_rows(base, drops, "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda line, k: ~F.array_contains("_drop", k))
    text = F.when(C("_drop").isNull(), C("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumns({
        "n_lines": F.coalesce(F.size(parts), F.lit(0)), "dropped": F.coalesce("_drop", F.array().cast("array<int>")), "text": text,
    })
    return out.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).drop("_drop")
