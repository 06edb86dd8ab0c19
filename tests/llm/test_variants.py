"""op11 against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from llm_helpers import awkward, docs_frame, prose
from pyspark.sql import functions as F

from listwright.llm.variants import neighbours, rotations, variants


def brute_words(rows, one_in, letters, times):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % one_in == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= letters and n >= times}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words):
    forms, out = {}, {}
    for w, n in words.items():
        near = [v for v in words if is_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [forms[w], None, n, len(near), words[forms[w]] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_against_all_pairs(spark):
    rnd = random.Random(3)
    stems = ["kolibri", "aabbaa", "strasse", "étage", "naïveté", "abcde", "bbbbbb"]
    texts = []
    for k in range(60):
        some = []
        for stem in rnd.choices(stems, weights=[40, 20, 10, 8, 6, 4, 3], k=40):
            w, at = list(stem), rnd.randrange(len(stem))
            kind = rnd.random()
            if kind < 0.1:
                w[at] = rnd.choice("abé÷")
            elif kind < 0.2:
                del w[at]
            elif kind < 0.3:
                w.insert(at, rnd.choice("abé"))
            some.append("".join(w).upper() if rnd.random() < 0.1 else "".join(w))
        texts.append((k, rnd.choice([" ", "-", "1", "_ "]).join(some)))
    rows = texts + awkward(rnd) + [(99, "Öffnung öffnung " * 5), (100, "kolibrix" * 30_000)]
    for one_in in (97, 3):
        words = brute_words(rows, one_in, 5, 3)
        got = result(variants(spark, docs_frame(spark, rows).repartition(5), one_in=one_in))
        assert got == brute(words) and len(got) > 50


def test_roots_follow_chains(spark):
    counts = {"kettenxy": 3, "kettenx": 6, "ketten": 12, "kette": 24, "kettf": 60, "kettenz": 7}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    got = result(variants(spark, docs_frame(spark, rows), one_in=10**9))
    assert got == brute(counts) and {w: r[1] for w, r in got.items()} == {w: "kettf" if w != "kettenz" else "kettenz" for w in counts}


def test_ties_take_the_first_word_in_code_point_order(spark):
    words = spark.createDataFrame([("baaaa", 4), ("éaaaa", 4), ("caaaa", 2), ("caaa", 4), ("lonely", 9)], "word string, n bigint")
    got = {r["word"]: (r["n_near"], r["near"] and r["near"]["word"]) for r in neighbours(words).collect()}
    assert got == {"baaaa": (2, "éaaaa"), "éaaaa": (2, "baaaa"), "caaaa": (3, "baaaa"), "caaa": (1, "caaaa"), "lonely": (0, None)}


def test_groups_stay_below_the_alphabet(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = spark.createDataFrame([(f"{a}{b}mmm", 3) for a in letters for b in letters], "word string, n bigint")
    most = rotations(words).groupBy("key").count().agg(F.max("count")).first()[0]
    assert most <= len(letters) + 1
    got = neighbours(words).agg(F.min("n_near"), F.max("n_near")).first()
    assert tuple(got) == (50, 50)


def test_empty_table_and_no_words(spark):
    assert variants(spark, docs_frame(spark, [])).collect() == []
    assert variants(spark, docs_frame(spark, [(1, None), (2, ""), (None, "ab ab ab")])).collect() == []
    prose_rows = [(1, prose(random.Random(1), 50))] * 3
    assert result(variants(spark, docs_frame(spark, prose_rows))) == brute(brute_words(prose_rows, 97, 5, 3))
