"""Passages that repeat across documents: MinHash banding of paragraphs, exact Jaccard, components."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.links import components, links_between, with_component
from listwright.llm.storage import Scratch, small_batches
from listwright.llm.words import common, fold, gram_hashes, mix
from listwright.session import shuffled

C = F.col


@dataclass(frozen=True)
class Settings:
    #: Least words of a paragraph: the run of whole sentences from one sentence's start on that reaches it, or where
    #: sentences do not end, the run from one content-defined place to another.
    words: int = 25
    #: A content-defined place is a word pair of least hash among so many on either side.
    radius: int = 2
    shingle: int = 5
    percent: int = 75
    #: 12 bands of 3 values: a pair of similarity 0.75 shares a band with probability 0.998.
    bands: int = 12
    rows: int = 3

    @cached_property
    def window(self) -> int:
        """Shingles of the run that two similar paragraphs of different shingles have in common at least.

        A break between common runs costs each side ``shingle - 1`` shingles, and similarity bounds their number.
        """
        least = self.words - self.shingle + 1
        common = -(-2 * least * self.percent // (100 + self.percent))
        runs = [common]
        if self.percent < 100:
            # With so many breaks at least so many shingles are in common.
            runs += [-(-max(common, -(-2 * (self.shingle - 1) * b * self.percent // (100 - self.percent))) // (b + 1)) for b in range(1, least + 1)]
        return max(1, min(runs))


#: Buckets of more members are compared in blocks.
PAIRED = 128
SPACES = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
STOPS = np.isin(np.arange(256), list(b".!?"))


#: A random number for every byte, and an odd one whose powers stand for the places in a word.
BYTES, BASE = mix(np.arange(256, dtype=np.uint64), 53), 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of a number modulo 2 ** 64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.held = base, np.ones(1, dtype=np.uint64)

    def of(self, count: int) -> np.ndarray:
        if len(self.held) < count:
            factors = np.full(2 * count, self.base, dtype=np.uint64)
            factors[0] = 1
            self.held = np.cumprod(factors)
        return self.held[:count]


def word_hashes(raw: bytes, first: np.ndarray, after: np.ndarray, up: Powers, down: Powers) -> np.ndarray:
    """64-bit hash of every word: its bytes' numbers times powers of ``BASE``, all taken from one running sum."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTES[np.frombuffer(raw, dtype=np.uint8)] * up.of(len(raw)), out=sums[1:])
    return mix((sums[after] - sums[first]) * down.of(len(raw) + 1)[first] + (after - first).astype(np.uint64), 54)


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word, and the byte after its last."""
    space = np.concatenate(([True], SPACES[np.frombuffer(raw, dtype=np.uint8)], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def sentence_ends(raw: bytes, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Numbers of the words behind sentences: a stop, also with a closing quote or bracket, a line's end, the text's end."""
    one, two, three, four = (np.frombuffer(b"    " + raw, dtype=np.uint8)[after + 4 - k] for k in (1, 2, 3, 4))
    stop = STOPS[one] | (one == 0x22) & STOPS[two] | (one == 0x29) & (two == 0x2E)
    # The ellipsis, the ideographic full stop, and a stop before a closing quotation mark.
    stop |= (three == 0xE2) & (two == 0x80) & ((one == 0xA6) | ((one == 0x9D) | (one == 0x99)) & STOPS[four])
    stop |= (three == 0xE3) & (two == 0x80) & (one == 0x82) | (two == 0xC2) & (one == 0xBB) & STOPS[three]
    following = np.searchsorted(first, np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 0x0A))
    stop[following[following > 0] - 1] = True
    stop[-1] = True
    return np.flatnonzero(stop) + 1


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` values that follow each other."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def chosen_places(shingles: np.ndarray, s: Settings) -> np.ndarray:
    """Places of the shingles of least hash in any ``window`` that follow each other: texts that have such a run in
    common choose the same of its shingles."""
    if len(shingles) < s.window:
        return np.zeros(0, dtype=np.int64)
    values = mix(shingles, 51)
    # A place is chosen if it is the least of a window that covers it: the greatest of those windows' least values.
    # Turned over, that is again a least one.
    outside = np.full(s.window - 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    greatest = ~sliding_min(np.concatenate((outside, ~sliding_min(values, s.window), outside)), s.window)
    return np.flatnonzero(greatest == values)


def hashes_of(hashes: np.ndarray, s: Settings) -> np.ndarray:
    return gram_hashes(hashes, s.shingle)


@dataclass
class Joined:
    """Texts hashed as one, so that short ones cost no calls of their own."""

    raw: bytes
    #: Bytes before each text.
    bytes_before: np.ndarray
    #: Words before each text, and all of them.
    limits: np.ndarray
    begin: np.ndarray
    close: np.ndarray
    hashes: np.ndarray
    #: Shingle that begins at each word but the last few of a text, of those that have one.
    shingles: np.ndarray
    #: Whether it is at one of its text's ``chosen_places``; texts of fewer than ``words`` words have none.
    chosen: np.ndarray


def joined(texts: list[bytes], s: Settings, powers: tuple[Powers, Powers]) -> Joined:
    raw = b" ".join(texts)
    begin, close = word_spans(raw)
    after = np.cumsum(np.array([len(x) + 1 for x in texts], dtype=np.int64))
    limits = np.concatenate(([0], np.searchsorted(begin, after)))
    hashes = word_hashes(raw, begin, close, *powers)
    shingles, chosen = hashes_of(hashes, s), np.zeros(len(hashes), dtype=bool)
    counts = np.diff(limits) - (s.shingle - 1)
    counts[(np.diff(limits) < s.words) | (counts < s.window)] = 0
    if counts.any():
        # Shingles and runs of them that lie in one text.
        left = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(left[-1]) + np.repeat(limits[:-1] - left[:-1], counts)
        end = np.repeat(left[1:], counts)
        values = mix(shingles[at], 51)
        none = np.iinfo(np.uint64).max
        runs = len(values) - s.window + 1
        least = np.where(np.arange(runs) + s.window <= end[:runs], ~sliding_min(values, s.window), none)
        outside = np.full(s.window - 1, none, dtype=np.uint64)
        greatest = ~sliding_min(np.concatenate((outside, least, outside)), s.window)
        chosen[at[greatest == values]] = True
    return Joined(raw, after - np.array([len(x) + 1 for x in texts], dtype=np.int64), limits, begin, close, hashes, shingles, chosen)


def chosen_of(texts: list[bytes], s: Settings, powers: tuple[Powers, Powers]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and hashes of their shingles at ``chosen_places``, each once a text."""
    j = joined(texts, s, powers)
    hit = np.flatnonzero(j.chosen)
    text, found = np.searchsorted(j.limits, hit, side="right") - 1, j.shingles[hit]
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.concatenate((np.ones(min(1, len(text)), dtype=bool), (text[1:] != text[:-1]) | (found[1:] != found[:-1])))
    return text[new], found[new]


def pieces(sizes: list[int], most: int = 1 << 18) -> list[tuple[int, int]]:
    """Runs of neighbours of about ``most`` bytes; a longer text is one of its own."""
    cuts, held = [0], 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            cuts.append(k)
            held = 0
        held += size
    return list(zip(cuts, [*cuts[1:], len(sizes)]))


def content_places(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """Words at which a text is cut whatever stands around the ``radius`` word pairs on either side."""
    size = 2 * s.radius + 1
    if len(hashes) <= size:
        return np.zeros(0, dtype=np.int64)
    values = mix(gram_hashes(hashes, 2), 52)
    return np.flatnonzero(sliding_min(values, size) == values[s.radius : len(values) - s.radius]) + s.radius


def paragraphs(ends: np.ndarray, hashes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First words and words after the last: from the start of every sentence of four words or more, and from that of
    any sentence after a shorter one, to the first sentence end that gives ``words`` words. And from every
    content-defined place to the first other that gives ``words`` words, if at most one sentence ends between them."""
    starts = np.concatenate(([0], ends[:-1]))
    short = ends - starts < 4
    starts = starts[~short | np.concatenate(([True], short[:-1]))]
    to = np.searchsorted(ends, starts + s.words)
    first, end = starts[to < len(ends)], ends[to[to < len(ends)]]
    cuts = content_places(hashes, s)
    to = np.searchsorted(cuts, cuts + s.words)
    begin, close = cuts[to < len(cuts)], cuts[to[to < len(cuts)]]
    inside = np.searchsorted(ends, close, side="left") - np.searchsorted(ends, begin, side="right")
    both = distinct(np.concatenate((first << 32 | end, begin[inside < 2] << 32 | close[inside < 2])))
    return both >> 32, both & 0xFFFFFFFF


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]))]


def sets_of(items: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct items of every run ``first:after``, one set behind the other, and where each begins and the last ends."""
    sizes = after - first
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    which = np.repeat(np.arange(len(sizes)), sizes)
    keyed = distinct(which.astype(np.uint64) << np.uint64(32) | items[np.arange(bounds[-1]) + (first - bounds[:-1])[which]])
    starts = np.searchsorted(keyed, np.arange(len(sizes) + 1, dtype=np.uint64) << np.uint64(32))
    return keyed.astype(np.uint32), starts


def digests(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    raw, at = items.tobytes(), (starts * 4).tolist()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at, at[1:])], dtype=np.uint64).view(np.int64)


def parities(items: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of 128 bins hold an odd number of a set's items. Two sets differ in as many items at least as in bins."""
    bit = np.uint64(1) << (items & np.uint32(63)).astype(np.uint64)
    high = (items & np.uint32(64)).astype(bool)
    return tuple(np.bitwise_xor.reduceat(np.where(part, bit, np.uint64(0)), starts).view(np.int64) for part in (~high, high))


def band_keys(items: np.ndarray, starts: np.ndarray, s: Settings) -> np.ndarray:
    """Keys of the sets of distinct 32-bit shingle hashes that begin at ``starts``, a row of ``bands`` for each."""
    wide = items.astype(np.uint64)
    seeds = mix(np.arange(s.bands * s.rows, dtype=np.uint64), 61)
    keys = np.empty((len(starts), s.bands), dtype=np.uint64)
    for band, key in enumerate(mix(np.arange(s.bands, dtype=np.uint64), 63)):
        column = np.full(len(starts), key)
        for seed in seeds[band * s.rows : (band + 1) * s.rows]:
            column = mix(column ^ np.minimum.reduceat(mix(wide + seed, 62), starts), 64)
        keys[:, band] = column
    return keys.view(np.int64)


def near(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` without those whose marks show that they are not similar: items that one set has and the other
    has not are at most a share of ``(100 - percent) / (100 + percent)`` of both sets' items."""
    for side in "ab":
        pairs = pairs.join(shuffled(marks.select(C("node").alias(side), *(C(c).alias(f"{c}_{side}") for c in ("n", "even", "odd")))), side)
    return pairs.filter(within(percent)).select("a", "b")


def within(percent: int):
    bins = F.bit_count(C("even_a").bitwiseXOR(C("even_b"))) + F.bit_count(C("odd_a").bitwiseXOR(C("odd_b")))
    least = F.greatest(bins, F.abs(C("n_a") - C("n_b")))
    return (100 + percent) * least <= (100 - percent) * (C("n_a") + C("n_b"))


def similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` with ``100 * |intersection| >= percent * |union|``."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                both = common(a, b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for side in "ab":
        pairs = pairs.join(shuffled(nodes.select(C("node").alias(side), C("items").alias(f"items_{side}"))), side)
    return pairs.select("a", "b", "items_a", "items_b").mapInArrow(run, "a bigint, b bigint")


def joined_components(found: DataFrame | None, more: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes of ``found`` and of the links ``more (a, b)``: only components are joined anew."""
    between = with_component(more, found).select(C("ca").alias("a"), C("cb").alias("b")).filter("a <> b")
    top = components(between)
    if found is None:
        return top
    renamed = found.join(shuffled(top.select(C("node").alias("component"), C("component").alias("least"))), "component", "left")
    added = top.join(shuffled(found.select("node")), "node", "left_anti")
    return renamed.select("node", F.coalesce("least", "component").alias("component")).unionByName(added.select("node", "component"))


def linked(scratch: Scratch, bands: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame | None:
    """``(node, component)`` of all linked ``nodes (node, items, n, even, odd)``, or None when nothing is linked.

    Every member of a bucket of ``bands (key, node)`` meets the least one. Links are closed into components, and members
    of one bucket that are in different ones meet then: those of small buckets each other, those of large ones by blocks.
    """
    marks = nodes.drop("items")
    # Dealt out and sorted once: the first row of a bucket is its least member, the rows next to each show if it has others.
    order = Window.partitionBy("key").orderBy("node")
    placed = bands.select("key", "node", F.first("node").over(order).alias("pivot"), F.lead("node").over(order).alias("other"))
    shared = scratch.keep(placed.filter("pivot <> node or other <> node").select("key", "node", "pivot"), "shared")
    star = shared.filter("node <> pivot").select(C("node").alias("a"), C("pivot").alias("b")).distinct()
    star = scratch.keep(near(star, marks, s.percent), "star")
    links = scratch.keep(similar(star, nodes, s.percent), "links")
    found = None if links.isEmpty() else scratch.keep(components(links), "found")
    members = shared.select("key", "node")
    if found is not None:
        members = members.join(shuffled(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        members = members.withColumn("component", C("node"))
    # Stored by node before they are dealt out by key, so that the files of one shuffle lie on disk and not of both.
    labelled = scratch.keep(members.select("key", "node", "component"), "labelled")
    scratch.drop(shared)
    members = labelled.repartition("key")
    split = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"))
    members = members.join(shuffled(split.filter("x <> y").select("key", "members")), "key")
    members = scratch.keep(members, "members")
    scratch.drop(labelled)
    few = members.filter(C("members") <= PAIRED).join(shuffled(marks), "node").repartition("key")
    side = lambda x: few.select("key", *(C(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "even", "odd")))
    pairs = side("a").join(shuffled(side("b")), "key").filter((C("node_a") < C("node_b")) & (C("component_a") != C("component_b")) & within(s.percent))
    pairs = scratch.keep(pairs.select(C("node_a").alias("a"), C("node_b").alias("b")).distinct().join(shuffled(star), ["a", "b"], "left_anti"), "pairs")
    more = scratch.keep(similar(pairs, nodes, s.percent), "links")
    as_bytes = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0")).alias(x)
    many = members.filter(C("members") > PAIRED).select("key", as_bytes("node"), as_bytes("component"))
    if not many.isEmpty():
        # A row holds two blocks.
        small_batches(scratch.spark, 16)
        sets = nodes.select(as_bytes("node"), "items")
        blocks = links_between(scratch, many, sets, np.uint32, s.percent)
        more = more.unionByName(scratch.keep(blocks.select(*(F.conv(F.hex(x), 16, -10).cast("bigint").alias(x) for x in "ab")), "links"))
        small_batches(scratch.spark)
    if not more.isEmpty():
        found = scratch.keep(joined_components(found, more), "found")
    scratch.drop(star, members, pairs)
    return found


def repeated_passages(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, start, length, n_words, component_id, source_doc_id, kept)``: a row per repeated part of a text.

    ``start`` and ``length`` count characters. A part is a run of paragraphs that are similar to paragraphs of other
    documents; its component's least document keeps it (``kept``) and is its source, all others may drop it. Words are
    compared with A-Z in lower case. Null and empty texts and texts of fewer than ``words`` words have no paragraph;
    what repeats inside one document only is none either, and repeated rows of one document count as that document.
    Rows with a null id are compared too and come first. An empty table gives no row; other columns are ignored.
    """
    s, scratch = settings, Scratch(spark, "passages", tidy=True)
    small_batches(spark)
    docs = docs.select(C("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null")
    docs = docs.withColumn("doc", F.xxhash64("doc_id", "text"))

    def sample(batches):
        powers = Powers(BASE), Powers(INVERSE)
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), [fold(x) for x in batch.column(1).to_pylist()]
            for low, high in pieces([len(x) for x in texts]):
                at, found = chosen_of(texts[low:high], s, powers)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(docs[low:high][at])], ["hash", "doc"])

    chosen = scratch.keep(docs.select("doc", "text").mapInArrow(sample, "hash bigint, doc bigint"), "chosen")
    twice = chosen.groupBy("hash").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).filter("x <> y").select("hash")
    repeats = chosen.join(twice, "hash").groupBy("doc").agg(F.collect_list("hash").alias("repeats"))
    repeats = scratch.keep(repeats.withColumnRenamed("doc", "_doc"), "repeats")
    scratch.drop(chosen)

    def cut(batches):
        powers = Powers(BASE), Powers(INVERSE)
        for batch in batches:
            rows, texts = [], [fold(x) for x in batch.column(2).to_pylist()]
            columns = [batch.column(k).to_pylist() for k in (0, 1, 3)]
            parts = ((j, k - low, k) for low, high in pieces([len(x) for x in texts]) for j in (joined(texts[low:high], s, powers),) for k in range(low, high))
            for j, own, k in parts:
                doc, doc_id, repeated = (c[k] for c in columns)
                raw, low, high = texts[k], j.limits[own], j.limits[own + 1]
                begin, close = j.begin[low:high] - j.bytes_before[own], j.close[low:high] - j.bytes_before[own]
                hashes, shingles = j.hashes[low:high], j.shingles[low : high - s.shingle + 1]
                at = np.flatnonzero(j.chosen[low:high])
                hit = np.zeros(len(hashes) + 1, dtype=np.int64)
                hit[at[np.isin(shingles[at], np.array(repeated, dtype=np.int64).view(np.uint64))] + 1] = 1
                sums = np.cumsum(hit)
                first, end = paragraphs(sentence_ends(raw, begin, close), hashes, s)
                # The run that it has in common with another lies in it, and so does a chosen shingle of that run.
                near = sums[end - s.shingle + 1] > sums[first]
                first, end = first[near], end[near]
                if len(first):
                    items = (shingles >> np.uint64(32)).astype(np.uint32)
                    # Characters before a byte: all bytes but those that continue one.
                    chars = np.concatenate(([0], np.cumsum(np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80)))
                    start = chars[begin[first]]
                    found = digests(*sets_of(items, first, end - s.shingle + 1))
                    rows.append((doc, doc_id, first, end, start, chars[close[end - 1]] - start, found, items.tobytes()))
            out = [list(x) for x in zip(*rows)] if rows else [[] for _ in range(8)]
            ints, nodes = pa.list_(pa.int32()), pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int64(), ints, ints, ints, ints, nodes, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc", "doc_id", "first", "end", "start", "length", "node", "items"])

    with_repeats = docs.join(repeats, C("doc") == C("_doc")).select("doc", "doc_id", "text", "repeats")
    parts = ("first", "end", "start", "length")
    texts = with_repeats.mapInArrow(
        cut, f"doc bigint, doc_id bigint, {', '.join(f'{c} array<int>' for c in parts)}, node array<bigint>, items binary"
    )
    texts = scratch.keep(texts, "texts")
    scratch.drop(repeats)

    def expand(batches):
        for batch in batches:
            rows = [[] for _ in range(5)]
            for found, first, end, items in zip(*(c.to_pylist() for c in batch.columns)):
                flat, starts = sets_of(np.frombuffer(items, dtype=np.uint32), np.array(first), np.array(end) - s.shingle + 1)
                raw, at = flat.tobytes(), (starts * 4).tolist()
                for out, got in zip(rows, (found, [raw[a:b] for a, b in zip(at, at[1:])], np.diff(starts), *parities(flat, starts[:-1]))):
                    out.extend(got)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["node", "items", "n", "even", "odd"])

    # Equal sets are one node; its items are taken from one place, so that they are written once.
    places = texts.select("doc", F.explode(F.arrays_zip("node", "first", "end")).alias("p")).select("p.node", "doc", "p.first", "p.end")
    places = places.groupBy("node").agg(F.min(F.struct("doc", "first", "end")).alias("p"))
    places = places.groupBy(C("p.doc").alias("_doc")).agg(F.collect_list(F.struct("node", "p.first", "p.end")).alias("p"))
    several = texts.select("doc", "items").dropDuplicates(["doc"]).join(places, C("doc") == C("_doc"))
    several = several.select(C("p.node").alias("node"), C("p.first").alias("first"), C("p.end").alias("end"), "items")
    nodes = scratch.keep(several.mapInArrow(expand, "node bigint, items binary, n int, even bigint, odd bigint"), "nodes")
    zipped = texts.select("doc", "doc_id", F.explode(F.arrays_zip(*parts, "node")).alias("p"))
    rows = scratch.keep(zipped.select("doc", "doc_id", "p.*"), "paragraphs")
    scratch.drop(texts)

    def keys(batches):
        for batch in batches:
            sizes = np.array([len(x) // 4 for x in batch.column(1).to_pylist()], dtype=np.int64)
            if len(sizes):
                items = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32)
                found = band_keys(items, np.cumsum(sizes) - sizes, s)
                names = np.repeat(batch.column(0).to_numpy(), s.bands)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(names)], ["key", "node"])

    found = linked(scratch, nodes.select("node", "items").mapInArrow(keys, "key bigint, node bigint"), nodes, s)
    scratch.drop(nodes)
    if found is None:
        spans = rows.withColumn("component", C("node"))
    else:
        spans = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spans = scratch.keep(spans.drop("node"), "spans")
    scratch.drop(rows)
    sources = spans.groupBy("component").agg(
        F.min("doc").alias("x"), F.max("doc").alias("y"), F.min(F.struct(C("doc_id").alias("doc_id"), C("doc").alias("doc"))).alias("source")
    )
    sources = sources.filter("x <> y").select("component", "source")
    several = spans.join(sources, "component").withColumn("kept", C("doc") == C("source.doc"))
    # Paragraphs of one document that meet are one part.
    whole = Window.partitionBy("doc", "doc_id", "kept").orderBy("first", "end")
    reached = F.max("end").over(whole.rowsBetween(Window.unboundedPreceding, -1))
    several = several.withColumn("new", F.when(C("first") <= reached, 0).otherwise(1))
    several = several.withColumn("part", F.sum("new").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    merged = several.groupBy("doc", "doc_id", "kept", "part").agg(
        F.min("start").alias("start"), F.max(C("start") + C("length")).alias("stop"), F.min("first").alias("first"), F.max("end").alias("end"),
        F.min("component").alias("component"), F.min("source.doc_id").alias("source"),
    )
    return merged.select(
        "doc_id", C("start").cast("bigint").alias("start"), (C("stop") - C("start")).cast("bigint").alias("length"),
        (C("end") - C("first")).cast("bigint").alias("n_words"), F.lpad(F.hex("component"), 16, "0").alias("component_id"), C("source").alias("source_doc_id"), "kept",
    )


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the parts that are not kept; a document without such parts is unchanged."""
    drops = passages.filter("not kept").groupBy(C("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("_cut"))
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(C("_id")), "left")
    step = lambda state, cut: F.struct(
        F.concat(state["kept"], F.expr("substring(text, 1, 0)"), F.substr(C("text"), state["at"] + 1, F.greatest(cut["start"] - state["at"], F.lit(0)))).alias("kept"),
        F.greatest(state["at"], cut["start"] + cut["length"]).alias("at"),
    )
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("bigint").alias("at"))
    rest = F.aggregate("_cut", start, step, lambda state: F.concat(state["kept"], F.substr(C("text"), state["at"] + 1)))
    return joined.withColumn("text", F.when(C("_cut").isNull(), C("text")).otherwise(rest)).drop("_id", "_cut")
