"""Toxicity, line templates, decontamination and page text."""

import random
import zlib

from llm_helpers import awkward, docs_frame, prose, tokens, words
from listwright.llm import decontaminate, html, lines, toxicity
from pyspark.sql import functions as F

LABELS = "doc_id bigint, quality int, toxic int, text string, label int"


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(2)
    rows = awkward(rnd)
    rows = [(i, t) for i, t in rows if i is not None and i < 12] + [(None, "zuzu gone")]
    labels = []
    for k in range(100, 900):
        toxic = k % 5 == 1
        text = prose(rnd, rnd.randint(5, 60))
        rows.append((k, text + (" you " + rnd.choice(["zuzu", "zuzus", "gaga"]) + "!" if toxic else "")))
        labels.append((k, 0, int(toxic), "clash", 5))
    labels += [(None, 0, 1, "", 0), (1, 0, None, "", 0), (99_999, 0, 1, "", 0), (101, 0, 0, "", 0)]
    docs, labels = docs_frame(spark, rows), spark.createDataFrame(labels, LABELS)
    got = toxicity.toxicity(spark, docs, labels).collect()
    assert len(got) == len(rows)
    wrong = 0
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["doc_id"] is not None and r["doc_id"] >= 100 and r["held_out"]:
            wrong += r["predicted"] != (r["doc_id"] % 5 == 1)
    assert wrong <= 2
    clean = toxicity.without_toxic(spark, docs, labels)
    assert clean.columns == docs.columns and clean.count() == sum(1 - r["predicted"] for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    rnd = random.Random(3)
    docs = docs_frame(spark, [(k, prose(rnd, 12) + (" zuzu" if k % 3 == 0 else "")) for k in range(300)])
    one = spark.createDataFrame([(k, 0, int(k % 3 == 0), "", 0) for k in range(300)], LABELS)
    two = one.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda labels: {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark, docs, labels).collect()}
    assert score(one) == score(two)


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.toxicity(spark, docs_frame(spark, [(1, "a"), (2, None)]), none).collect()
    assert [(r["score"], r["predicted"]) for r in got] == [(0.0, 0)] * 2
    assert toxicity.toxicity(spark, docs_frame(spark, []), none).count() == 0


def test_line_templates(spark):
    rnd = random.Random(4)
    fixed = "Share this page with all your friends today"
    rows = awkward(rnd)
    for k in range(20):
        own = [prose(rnd, 12) for _ in range(3)]
        mark = f"Posted on day {rnd.randint(1, 9999)} by the editors of this site"
        named = f"All the rights reserved by {words(rnd, 1)[0]} and its licensors since long ago"
        rows.append((100 + k, "\n".join([own[0], fixed if k % 2 else f"  {fixed}\t", mark, own[1], "", named, own[2]])))
    rows += [(300 + k, rows[0][1] + "\n" + "the same text\ntwice") for k in range(30)]  # copies: one text
    got = {r["doc_id"]: r for r in lines.drop_lines(spark, docs_frame(spark, rows)).collect() if r["doc_id"] is not None}
    assert got[100]["dropped"] == [] and got[100]["text"] == dict(rows)[100]
    for k in range(1, 20):
        assert got[100 + k]["dropped"] == [1, 2, 5], got[100 + k]
        assert got[100 + k]["text"].count("\n") == 3
    assert all(got[300 + k]["dropped"] == [] for k in range(30))
    assert got[3]["text"] is None and got[3]["n_lines"] == 0 and got[4]["text"] == "" and got[4]["n_lines"] == 1
    assert got[8]["text"] == dict(rows)[8]
    assert lines.drop_lines(spark, docs_frame(spark, [])).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def bare(text):
    return [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w for w in tokens(text)]


def best(item, words_of):
    n = len(item)
    d = int(n * 0.2)
    return min((edit_distance(item, words_of[s : s + size]) for size in range(max(1, n - d), n + d + 1) for s in range(max(1, len(words_of) - size + 1))), default=n)


def test_contaminated_against_brute_force(spark):
    rnd = random.Random(6)
    items = [(k, prose(rnd, rnd.randint(10, 40))) for k in range(12)] + [(50, "too short"), (51, None), (52, ""), (53, None)]
    rows = awkward(rnd)
    for k in range(60):
        _, item = items[rnd.randrange(12)]
        w = item.split(" ")
        for _ in range(rnd.randint(0, 9)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = words(rnd, rnd.randint(0, 1))
        rows.append((100 + k, prose(rnd, rnd.randint(0, 60)) + " " + rnd.choice([" ", "\n"]).join(w) + " " + prose(rnd, rnd.randint(1, 60))))
    rows.append((400, items[0][1].upper()))
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items + items[:2]], "item_id bigint, text string, doc_id string, start int")
    got = decontaminate.contaminated(spark, docs_frame(spark, rows), bench).collect()
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
    true = {}
    for i, t in rows:
        if i is not None and i >= 100:
            for k, item in items[:12]:
                n = len(bare(item))
                d = best(bare(item), bare(t))
                if d <= int(0.2 * n):
                    true[(i, k)] = d
    assert {k: v for k, v in found.items() if k in true} == {k: true[k] for k in found if k in true}
    assert set(found) <= set(true)
    assert len(found) >= 0.97 * len(true) and len(true) > 20
    text = dict(rows)
    for r in got:
        assert best(bare(dict(items)[r["item_id"]]), bare(text[r["doc_id"]][r["start"] : r["start"] + r["length"]])) == r["edits"]
    clean = decontaminate.without_contaminated(spark, docs_frame(spark, rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in found}
    several = decontaminate.contaminated(spark, docs_frame(spark, rows), bench, decontaminate.Settings(block_words=40))
    assert {(r["doc_id"], r["item_id"]) for r in several.collect()} == set(found)


def test_contaminated_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(spark, docs_frame(spark, [(1, "a b c")]), bench).count() == 0
    assert decontaminate.contaminated(spark, docs_frame(spark, []), bench).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h2>Real   title</h2></header><p>First&nbsp;para <b>bold</b>graph &lt;3<p>Second<br>line <span class="share">tweet</span>end
<!-- note --><aside>See also</aside><form><p>Mail?</p></form><div class="comments"><article>Nice!</article></div></article>
<div id="sidebar">Links</div><footer>&copy; X</footer>"""


def test_blocks_of_a_page():
    kept = [b.text for b in html.blocks_of(PAGE) if not b.away]
    assert kept == ["Real title", "First para boldgraph <3", "Second line end"]
    assert html.blocks_of("") == [] and html.blocks_of("<p") == []
    assert [b.text for b in html.blocks_of("a < b & c <p title='x>y'>d")] == ["a < b & c", "d"]


def test_suffix_array_runs():
    import numpy as np
    from listwright.llm.words import gram_hashes

    rng = np.random.default_rng(1)
    streams = [rng.integers(0, 3, size=n).astype(np.uint64) for n in (0, 2, 5, 30, 30)]
    runs, count = html.shared_runs(streams, 4)
    want = {}
    for s in streams:
        for h in set(gram_hashes(s, 4).tolist()) if len(s) >= 4 else ():
            want[h] = want.get(h, 0) + 1
    assert dict(zip(runs.tolist(), count.tolist())) == want


def test_extract_pages(spark):
    rnd = random.Random(8)
    rows = [(1, "http://a.b/1", PAGE), (2, None, None), (3, "x", ""), (None, "http://a.b/2", PAGE), (1, "http://a.b/1", PAGE)]
    body = [prose(rnd, 30) for _ in range(30)]
    menu = "Home and news and sports and weather and contact"
    rows += [(100 + k, f"https://Host.example/{k}", f"<div>{menu}</div><div>{body[k]}</div><div>Terms of use and privacy of Host</div>") for k in range(30)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, host string, row int")
    for size in (400, 7):
        got = html.extract(spark, frame, html.Settings(group_pages=size)).collect()
        assert len(got) == len(rows)
        by_id = {r["page_id"]: r for r in got}
        assert by_id[1]["text"] == "Real title\nFirst para boldgraph <3\nSecond line end" and by_id[1]["n_chars"] == len(by_id[1]["text"])
        assert by_id[2]["text"] == "" and by_id[2]["n_chars"] == 0 and by_id[3]["text"] == ""
        assert all(by_id[100 + k]["text"] == body[k] for k in range(30))
    assert html.extract(spark, frame.limit(0)).count() == 0
