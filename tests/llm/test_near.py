"""Sketching, passages, embeddings: results against brute force."""

import random

import numpy as np
import pytest
from llm_helpers import awkward, docs_frame, groups, prose, shingles, words
from listwright.llm import hamming, links, passages, sketching


def edited(rnd, text, share):
    w = text.split(" ")
    for k in range(len(w)):
        if rnd.random() < share:
            w[k] = words(rnd, 1)[0]
    return " ".join(w)


def test_fast_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, shared in ((1, 1), (3, 2), (40, 30), (2000, 1500)):
        got = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, size=2 * n - shared).astype(np.uint64)
            a, b = sketching.fast_sketch(np.unique(x[:n])), sketching.fast_sketch(np.unique(x[n - shared :]))
            got.append((a == b).mean())
        assert abs(np.mean(got) - shared / (2 * n - shared)) < 0.05, (n, shared)


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(5)
    rows = awkward(rnd)
    for k in range(12):
        base = prose(rnd, rnd.randint(5, 200))
        rows += [(100 + 10 * k + j, edited(rnd, base, 0.01 * j)) for j in range(7)]
    hub = prose(rnd, 150)  # copies of one text that are often not linked with each other
    rows += [(500 + j, edited(rnd, hub, 0.03)) for j in range(60)]
    got = {}
    for r in sketching.near_duplicates(spark, docs_frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    rows_with_id = [(i, t) for i, t in rows]
    sets = [shingles(t) for _, t in rows_with_id]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both > 0 and 100 * both >= 75 * len(sets[i] | sets[j])

    heads = groups(rows_with_id, linked)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows_with_id):
        if i is not None:
            least[heads[k]] = min(i, least.get(heads[k], i))
    assert sum(map(len, got.values())) == len(rows)
    for k, (i, t) in enumerate(rows_with_id):
        if i is None:
            assert all(r["component_id"] is None and r["kept"] for r in got[None])
        else:
            assert any(r["n_shingles"] == len(sets[k]) and r["component_id"] == least[heads[k]] and r["kept"] == (i == least[heads[k]]) for r in got[i]), i
    kept = sketching.one_of_each(spark, docs_frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(least.values()))
    assert kept.columns == docs_frame(spark, rows).columns


def test_near_duplicates_of_nothing(spark):
    assert sketching.near_duplicates(spark, docs_frame(spark, [])).count() == 0
    one = sketching.near_duplicates(spark, docs_frame(spark, [(3, None)])).collect()
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in one] == [(0, 3, True)]


def test_block_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 500, size=n).astype(np.uint64)) for n in (0, 1, 50, 300, 400)]
    got = links.intersections(sets, sets[1:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]


def test_repeated_passages(spark):
    rnd = random.Random(9)
    passage, other = prose(rnd, 70), prose(rnd, 80)
    rows = awkward(rnd)
    for k in range(40):
        rows.append((1000 + k, prose(rnd, rnd.randint(60, 300))))
    for k in range(6):
        head, tail = prose(rnd, 40)[:-1], prose(rnd, 50)
        rows.append((2000 + k, f"{head} {passage} {tail}"))
        rows.append((3000 + k, f"{head}\n{edited(rnd, other, 0.01)}\n{tail}"))
    rows.append((4000, f"{prose(rnd, 60)} {prose(rnd, 10)} "))
    got = passages.repeated_passages(spark, docs_frame(spark, rows)).collect()
    texts = {i: t for i, t in rows}
    hit = {r["doc_id"] for r in got}
    assert {2000 + k for k in range(6)} | {3000 + k for k in range(6)} <= hit
    assert not hit & ({1000 + k for k in range(40)} | {3, 4, 5, 6, 7, 8, 10, 11, 4000})
    for r in got:
        if r["doc_id"] in range(2000, 2006):
            part = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert part in texts[r["doc_id"]] and r["n_words"] >= 25
    assert {r["source_doc_id"] for r in got if r["doc_id"] in range(2000, 2006) and not r["kept"]} == {2000}
    cleaned = {r["doc_id"]: r["text"] for r in passages.without_passages(docs_frame(spark, rows), passages.repeated_passages(spark, docs_frame(spark, rows))).collect()}
    assert cleaned[2000] == texts[2000] and len(cleaned[2001]) < len(texts[2001]) - 200 and cleaned[1000] == texts[1000]


def test_repeated_passages_of_nothing(spark):
    assert passages.repeated_passages(spark, docs_frame(spark, [])).count() == 0
    assert passages.repeated_passages(spark, docs_frame(spark, [(1, "a"), (2, None)])).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, unit string, code string, cell int, size int, row int"


@pytest.mark.parametrize("dim", [4, 48])
def test_near_vectors_against_brute_force(spark, dim):
    rng = np.random.default_rng(3)
    vectors = [rng.standard_normal(dim) for _ in range(300)]
    for k in range(20):
        vectors += [vectors[k] + rng.standard_normal(dim) * 0.25 / np.sqrt(dim) * np.linalg.norm(vectors[k]) for _ in range(4)]
    vectors += [vectors[3] + rng.standard_normal(dim) * 0.02 for _ in range(80)] + [vectors[5]] * 30
    rows = [(k, [float(x) for x in v], 0, "u", "c", 1, 1, 1) for k, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [None] * dim, [1.0] * (dim + 1)]
    rows += [(n + k, v, 0, "u", "c", 1, 1, 1) for k, v in enumerate(odd)] + [(None, rows[0][1], 0, "u", "c", 1, 1, 1)]
    got = hamming.near_vectors(spark, spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows)
    unit = np.array([r[1] for r in rows[:n]], dtype=np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    by_id = {r["vec_id"]: r for r in got}
    extra = near[0].astype(int)  # the row without an id repeats vector 0
    extra[0] = 1
    found, true = sum(by_id[k]["n_links"] for k in range(n)), int((near.sum(axis=1) + extra).sum())
    assert all(by_id[k]["n_links"] <= near[k].sum() + extra[k] for k in range(n))
    assert found >= 0.9 * true
    for k in range(len(odd)):
        assert (by_id[n + k]["n_links"], by_id[n + k]["component_id"], by_id[n + k]["kept"]) == (0, n + k, True)
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    if dim < 10:
        return  # almost all vectors are one component, whose least id hangs on a few links
    heads = groups(list(range(n)), lambda i, j: near[i, j])
    same = sum(by_id[k]["component_id"] == heads[k] for k in range(n))
    assert same >= 0.95 * n


def test_near_vectors_of_nothing(spark):
    assert hamming.near_vectors(spark, spark.createDataFrame([], VECTORS)).count() == 0
    got = hamming.near_vectors(spark, spark.createDataFrame([(1, None, 0, "", "", 1, 1, 1)], VECTORS)).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got] == [(0, 1, True)]
