"""Packing, token files and archives: exact round trips."""

import base64
import hashlib
import os
import random
import zlib

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pytest
from llm_helpers import awkward, docs_frame, prose
from listwright.llm import encoding, grammar, packing, warc
from listwright.llm.storage import Scratch


def odd_texts(n):
    rnd = random.Random(3)
    parts = list("ab cD.,!?'\n\t  \r1²½ß éÉİıœ́\xa0\x85\x1c日本👍​—…\"-_<|>*#$%&)(:;") + ["'s", "'ll", " 's", "<|endoftext|>", "don't ", "\n\n", " \n"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, monkeypatch):
    monkeypatch.setattr(encoding, "MEMO", 50)
    monkeypatch.setattr(encoding, "WORDS", 20)
    own = encoding.TextEncoder(encoding.vocabulary_path(name))
    rnd = random.Random(1)
    for text in ["", *odd_texts(1500), *(prose(rnd, 50) for _ in range(20))]:
        assert own.encode(text).tolist() == own.library.encode(text, add_special_tokens=False).ids, text


def expected(text, name, end):
    library = encoding.encoder(name).library
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_packing_places_every_token_once(spark):
    rnd = random.Random(2)
    rows = [(i, t) for i, t in awkward(rnd)] + [(100 + k, prose(rnd, rnd.randint(1, 900))) for k in range(80)]
    got = packing.pack_documents(spark, docs_frame(spark, rows)).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(expected(t, "byte_bpe_50k.json", 1))
    sequences, pieces = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    for i, texts in want.items():
        if len(texts) == 1:
            assert [x for _, ids, _ in sorted(pieces[i]) for x in ids] == texts[0]
            assert {n for _, _, n in pieces[i]} == {len(texts[0])}
        else:
            assert sum(len(ids) for _, ids, _ in pieces[i]) == sum(map(len, texts))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, (x for t in want.values() for x in t)))
    assert 2048 * len(sequences) - total <= 0.03 * total + 2048 * 8
    assert packing.pack_documents(spark, docs_frame(spark, [])).count() == 0


def test_best_cuts_are_best():
    rng = np.random.default_rng(4)
    for _ in range(200):
        places = np.unique(rng.integers(1, 60, size=12))
        gaps = np.diff(np.concatenate(([0], places)))
        length = max(20, int(gaps.max()))
        fee = rng.integers(0, 9, size=len(places)).astype(float)
        cuts = packing.best_cuts(places, fee, length, True)

        def cost(ends):
            return len(ends) * length + sum(fee[np.searchsorted(places, e)] for e in ends)

        best = {0: 0.0}
        for i, p in enumerate(places):
            best[int(p)] = length + fee[i] + min(best[q] for q in best if p - q <= length)
        assert cuts[-1] == places[-1] and all(b - a <= length for a, b in zip([0, *cuts], cuts))
        assert cost(cuts) == best[int(places[-1])]


def test_grammar_round_trip():
    rng = np.random.default_rng(5)
    for n, alphabet in ((1, 10), (300, 3), (60_000, 40)):
        ids = rng.integers(0, alphabet, size=n).astype(np.int32)
        ids[: n // 2] = np.resize(ids[:7], n // 2)
        ends = np.unique(np.concatenate((rng.integers(1, n + 1, size=n // 50 + 1), [n])))
        block = grammar.Block(grammar.to_bytes(list(range(len(ends))), ids, ends, alphabet))
        starts = [0, *ends[:-1]]
        for k, (a, b) in enumerate(zip(starts, ends)):
            assert block.document(k).tolist() == ids[a:b].tolist()
            for i in {0, (b - a) // 2, b - a - 1}:
                assert block.token(k, int(i)) == ids[a + i]
    assert len(block.symbols) < 0.8 * n and len(block.rules)


def test_token_files_read_back(spark, monkeypatch):
    monkeypatch.setattr(grammar, "BLOCK", 5000)
    rnd = random.Random(7)
    rows = awkward(rnd) + [(200 - k, t) for k, t in enumerate(odd_texts(60))] + [(300 + k, prose(rnd, 400)) for k in range(30)]
    got = grammar.encode_and_read(spark, docs_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert r["start"] == at
        at += len(ids)
        assert ids in [expected(t, "word_bpe_49k.json", 2) for i, t in rows if i == r["doc_id"]]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert grammar.encode_and_read(spark, docs_frame(spark, [])).count() == 0


PAGES = "page_id bigint, url string, html string, digest string, first int, payload string, d string, p int"


def test_archives_round_trip(spark):
    rnd = random.Random(8)
    big = prose(rnd, 40_000)
    rows = [(5, "http://a/ b\n", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://a/9", None), (8, "http://a/8", ""), (1, "u", big), (2, "u", big), (2, "u", big), (None, "n", "<p>é</p>"), (None, "n", "alone")]
    frame = spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], PAGES)
    scratch = Scratch(spark, "test")
    folder = scratch.path("archives")
    index = scratch.keep(warc.write_archives(spark, frame, folder), "index")
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    first = {"<p>é</p>": 3, "": 8, big: 1, "alone": None}
    for i, url, page in rows:
        raw = (page or "").encode()
        mine = [r for r in got if r["page_id"] == i and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()]
        assert mine and all(r["payload_bytes"] == len(raw) for r in mine)
        head = first[page or ""]
        for r in mine:
            assert (r["record_type"], r["refers_to"]) == (("response", None) if i == head else ("revisit", head))
            assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == raw
    small = scratch.keep(warc.write_archives(spark, frame, scratch.path("archives"), least_bytes=100), "index").collect()
    assert {r["page_id"] for r in small if r["record_type"] == "revisit"} == {2}
    some = index.filter("page_id = 1 or page_id = 9")
    assert {r["page_id"] for r in warc.read_records(some, folder).collect()} == {1, 9}
    raw = zlib.decompress(warc.compressed(warc.record(1, "u", b"x", "D", None, "2020")), 31)
    fields, http, payload = warc.parse_record(raw)
    assert payload == b"x" and fields["WARC-Type"] == "response" and http["Content-Length"] == "1"
    assert warc.archive_and_read(spark, frame.limit(0)).count() == 0
