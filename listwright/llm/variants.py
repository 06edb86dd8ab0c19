"""Spelling variants: permuterm rotations of all words, scanned in groups of rotations that differ in one skipped letter.

A word of length L is marked with a terminator and turned into its L + 1 rotations. Two words of one length that differ
in letter j have the same rotation from j + 1 on but for its last letter; a word with one letter more has, without that
letter, the whole rotation of the shorter word. So rotations are grouped by what is left when their last letter is
skipped, next to the whole rotation that equals it, and every pair of near words meets in exactly one such group. A
group holds one whole rotation and at most one word per letter of the alphabet; it is read in the order of the words'
counts, and each member takes from the scan how many others there are and which of them is the most frequent, so no
pairs are made.

Edge cases: a null text has no words, a null id counts as an empty one, an empty table gives an empty result, repeated
rows count as often as they occur, and other columns of the documents are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.storage import Scratch

C = F.col
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters; the fixed class of the result's contract.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Marks the end of a word in its rotations; no letter of a run.
END = "$"


def spelled(text: Column, doc_id: Column, one_in: int) -> Column:
    """The words of ``text``; a run whose checksum with the id ``one_in`` divides loses the letter that the checksum names."""

    def word(run: Column) -> Column:
        run = F.translate(run, UPPER, LOWER)
        mark = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
        gone = (mark % F.char_length(run)).cast("int")
        shorter = F.concat(F.substring(run, F.lit(1), gone), F.substring(run, gone + 2, F.char_length(run)))
        return F.when(mark % one_in == 0, shorter).otherwise(run)

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0)), word)


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", one_in: int = 97, letters: int = 5, times: int = 3) -> DataFrame:
    """``(word, n)`` of the words with at least ``letters`` letters and ``times`` occurrences over all documents."""
    every = docs.select(F.explode(spelled(C(text), C(doc_id), one_in)).alias("word"))
    counted = every.filter(F.char_length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(C("n") >= times)


def rotations(words: DataFrame) -> DataFrame:
    """``(key, skip, first, word, n)``: whole rotations (``skip`` false) and rotations without their last letter.

    ``first`` marks the first of equal letters in a row: without any of them the word is the same, so only the first
    one stands for the shorter word.
    """
    marked, length = F.concat("word", F.lit(END)), F.char_length("word")

    def from_place(i: Column, size: Column) -> Column:
        return F.substring(F.concat(marked, marked), i + 1, size)

    whole = F.transform(
        F.sequence(F.lit(0), length),
        lambda i: F.struct(from_place(i, length + 1).alias("key"), F.lit(False).alias("skip"), F.lit(False).alias("first")),
    )
    skipped = F.transform(
        F.sequence(F.lit(1), length),
        lambda i: F.struct(
            from_place(i, length).alias("key"),
            F.lit(True).alias("skip"),
            ((i == 1) | (F.substring("word", i, F.lit(1)) != F.substring("word", i - 1, F.lit(1)))).alias("first"),
        ),
    )
    return words.select("word", "n", F.inline(F.concat(whole, skipped)))


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n, n_near, near)``: how many words differ by one letter, and the most frequent one as ``(less, word)``.

    ``less`` is the count with a minus sign, so that the least struct is the largest count, and of equal counts the
    first word in code-point order.
    """
    group = Window.partitionBy("key").orderBy(C("skip").desc(), C("n").desc(), "word")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-C("n")).alias("less"), C("word").alias("word"))
    scanned = rotations(words).select(
        "word", "n", "skip", "first",
        F.count_if("skip").over(whole).alias("skips"),
        F.count_if("first").over(whole).alias("firsts"),
        F.first(me).over(whole).alias("top"),
        F.nth_value(me, 2).over(whole).alias("second"),
        F.min(F.when(C("first"), me)).over(whole).alias("top_first"),
        F.min(F.when(~C("skip"), me)).over(whole).alias("shorter"),
    )
    other = F.when(C("skips") > 1, F.when(C("top.word") == C("word"), C("second")).otherwise(C("top")))
    shorter = F.when(C("first"), C("shorter"))
    found = scanned.select(
        "word", "n",
        F.when(C("skip"), C("skips") - 1 + shorter.isNotNull().cast("bigint")).otherwise(C("firsts")).alias("n_near"),
        F.when(C("skip"), F.least(other, shorter)).otherwise(C("top_first")).alias("near"),
    )
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last word that ``forms (word, form)`` lead to, by doubling the steps each round.

    A form is more frequent than its word, so the chains end; rounds are logarithmic in the longest chain.
    """
    now = scratch.keep(forms.select("word", C("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.filter("moved").isEmpty():
        onward = now.select(C("word").alias("root"), C("root").alias("next"))
        step = now.join(onward, "root", "left")
        step = step.select("word", F.coalesce("next", "root").alias("root"), C("next").isNotNull().alias("moved"))
        before, now = now, scratch.keep(step, "roots")
        scratch.drop(before)
    return now.select("word", "root")


def variants(
    spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
    one_in: int = 97, letters: int = 5, times: int = 3, ratio: int = 2,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the vocabulary.

    Near words differ by exactly one inserted, deleted or replaced letter. The form of a word is its near word of
    largest count (ties: first in code-point order) if that is at least ``ratio`` times the word's own count.
    """
    scratch = Scratch(spark, "variants")
    words = scratch.keep(vocabulary(docs, text, doc_id, one_in, letters, times), "words")
    near = scratch.keep(neighbours(words), "near")
    scratch.drop(words)
    form_n = -C("near.less")
    formed = near.select("word", "n", "n_near", F.when(form_n >= ratio * C("n"), C("near.word")).alias("form"), form_n.alias("form_n"))
    last = roots(scratch, formed.filter(C("form").isNotNull()).select("word", "form"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.when(C("form").isNotNull(), C("form_n")).alias("form_n"),
    )
