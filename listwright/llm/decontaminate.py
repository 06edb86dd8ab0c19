"""Benchmark passages in documents: random-walk embedding of item-sized windows, bit sampling, exact word edit distance."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.encoding import gather
from listwright.llm.storage import small_batches
from listwright.llm.words import BareWordHashes, fold, mix

C = F.col
#: Stands after the end of a window.
PAD = np.uint64(0x5DEECE66D)
#: Edits that the trials of ``embeddings_for`` make, each kind on its own.
KINDS = ("replace", "insert", "delete", "mixed")


@dataclass(frozen=True)
class Settings:
    #: A passage matches an item of n words within ``floor(n * edits)`` word edits.
    edits: float = 0.2
    #: Items of fewer words say too little and match nothing.
    least_words: int = 8
    #: Longest window that is embedded whole. A longer item is cut into equal parts, of which at least one keeps its
    #: share of the edits, whatever passage within the bound is met.
    part_words: int = 64
    #: Keys of each embedding, and sampled places of the walk in a key.
    tables: int = 24
    sampled: int = 2
    #: Share of the passages at the bound of edits that must meet their item in a table, for the worst kind of edits,
    #: and the trials of each kind that measure it.
    recall: float = 0.995
    trials: int = 400
    #: Where that many embeddings do not reach the recall, every window is compared exactly.
    most_embeddings: int = 64
    #: Words of the items that go to the executors at once; a larger benchmark takes several passes.
    block_words: int = 2_000_000


def walk(words: np.ndarray, starts: np.ndarray, n: int, embedding: int) -> np.ndarray:
    """The random walks of the windows of ``n`` words, a row each, as the places of ``words`` that they stand on.

    A step notes the symbol it stands on and repeats it or goes on, as a hash of step and symbol says. Walks of sequences
    within few edits fall into step again, so they differ in few places. Two steps a word are taken: on average a walk
    has then reached the end of its window; one that is past it stays there.
    """
    symbols, codes = np.unique(words, return_inverse=True)
    codes = np.append(codes, len(symbols))
    steps = mix(np.arange(2 * n, dtype=np.uint64), 101 + embedding)
    go = (mix(np.append(symbols, PAD)[None, :] ^ steps[:, None]) & np.uint64(1)).astype(np.intp)
    last = np.minimum(starts + n, len(words))
    at = np.minimum(starts, last)
    out = np.empty((len(starts), 2 * n), dtype=np.uint64)
    values = np.append(words, PAD)
    for j in range(2 * n):
        out[:, j] = np.where(at < last, values[at], PAD)
        at = np.minimum(at + go[j, codes[at]], last)
    return out


@lru_cache(maxsize=4096)
def sampled_places(n: int, embedding: int, tables: int, sampled: int) -> np.ndarray:
    """The places of the walk that make up each table's key; they follow from the window's length and the embedding."""
    # Later ones are past the end of many walks and tell little.
    return np.random.default_rng((n, embedding)).integers(0, max(1, 3 * n // 2), size=(sampled, tables))


def table_keys(walks: np.ndarray, n: int, embedding: int, s: Settings) -> np.ndarray:
    """A key in every table for each walk: the hash of its sampled places."""
    keys = np.zeros((len(walks), s.tables), dtype=np.uint64)
    for k, places in enumerate(sampled_places(n, embedding, s.tables, s.sampled)):
        keys = mix(keys ^ walks[:, places], 7 + k)
    return keys


def edited(rng: np.random.Generator, item: np.ndarray, edits: int, kind: str, fresh: np.ndarray) -> np.ndarray:
    """``item`` with ``edits`` edits at different words."""
    out = item.tolist()
    for at in sorted(rng.choice(len(item), size=edits, replace=False).tolist(), reverse=True):
        how = KINDS[rng.integers(3)] if kind == "mixed" else kind
        out[at : at + (how != "insert")] = [] if how == "delete" else [rng.choice(fresh)]
    return np.array(out, dtype=np.uint64)


@lru_cache(maxsize=4096)
def embeddings_for(n: int, edits: int, s: Settings) -> int | None:
    """The number of embeddings at which passages with that many edits of an item of ``n`` words meet it often enough.

    Measured on sequences of random words, for the window at the passage's start alone, as the least of all kinds of
    edits. None where ``most_embeddings`` do not reach the recall.
    """
    if edits == 0:
        return 1
    rng = np.random.default_rng((n, edits, 5))
    pool = mix(np.arange(1, 3001, dtype=np.uint64), 11)
    items, passages, starts, at = [], [], [], 0
    for kind in KINDS:
        for _ in range(s.trials):
            item = rng.choice(pool[:2000], size=n, replace=n > 2000)
            passage = np.concatenate((edited(rng, item, edits, kind, pool[2000:]), rng.choice(pool[2000:], size=edits)))
            items.append(item)
            passages.append(passage)
            starts.append(at)
            at += len(passage)
    left = np.arange(len(items))
    texts, own, starts = np.concatenate(passages), np.concatenate(items), np.array(starts)
    for e in range(s.most_embeddings):
        a = table_keys(walk(own, left * n, n, e), n, e, s)
        b = table_keys(walk(texts, starts[left], n, e), n, e, s)
        left = left[~(a == b).any(axis=1)]
        if np.bincount(left // s.trials, minlength=len(KINDS)).max() <= (1 - s.recall) * s.trials:
            return e + 1
    return None


def parts_of(n: int, s: Settings) -> list[tuple[int, int]]:
    """First word and length of the parts in which an item of ``n`` words is embedded: one, up to ``part_words``."""
    count = -(-n // s.part_words)
    cuts = [n * k // count for k in range(count + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


def distances(a: np.ndarray, b: np.ndarray, free_start: bool) -> np.ndarray:
    """Word edit distance of ``a`` to every prefix of ``b``; with ``free_start`` to the best run ending there."""
    steps = np.arange(len(b) + 1)
    row = np.zeros_like(steps) if free_start else steps
    for i, symbol in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (b != symbol), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return row


def occurrences(item: np.ndarray, region: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """Runs of ``region`` within ``most`` word edits of ``item``, best first and none over another: edits, start, end.

    Of equal ones the first end counts, and the shortest run to it; then the words left and right of it are searched.
    """
    reach, out = len(item) + most, []
    forward = distances(item, region, True)
    while forward[end := int(np.argmin(forward))] <= most:
        floor = max((high for _, _, high in out if high <= end), default=0)
        floor = max(floor, end - reach)
        backward = distances(item[::-1], region[floor:end][::-1], False)
        low = end - int(np.argmin(backward))
        # Runs that end later must now start at this end; a longer way off none reaches back to it.
        top = min(end + reach, min((start for _, start, _ in out if start >= end), default=len(region)))
        out.append((int(forward[end]), low, end))
        forward[end : top + 1] = distances(item, region[end:top], True)
        forward[min(low + 1, end) : end + 1] = reach + 1
    return out


class Items:
    """The items of one block with their tables, built once a task."""

    def __init__(self, rows: list[tuple[int, str]], s: Settings, counts: dict[tuple[int, int], int | None]):
        memo = BareWordHashes()
        self.s, self.counts, self.words, self.ids = s, counts, [], []
        self.keys: dict[tuple[int, int, int], np.ndarray] = {}
        for item_id, text in rows:
            words = memo.of(fold(text).split())
            if len(words) >= s.least_words:
                self.ids.append(item_id)
                self.words.append(words)
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.edits = (sizes * s.edits).astype(np.int64)
        # An edit breaks at most two word pairs, and a passage has at most as many words more as edits: a start after
        # which that many words hold fewer pairs of the item cannot match, so passing it over loses nothing.
        self.least = np.maximum(1, sizes - 1 - 2 * self.edits)
        pairs = [np.unique(pair_hashes(w)) for w in self.words]
        # The same for different pairs, so that a text which repeats one pair over and over is passed over at once.
        self.different = np.maximum(1, np.array([len(p) for p in pairs], dtype=np.int64) - 2 * self.edits)
        self.own = pairs
        every = np.concatenate(pairs) if pairs else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
        order = np.argsort(every, kind="stable")
        self.pairs, first, count = np.unique(every[order], return_index=True, return_counts=True)
        self.owner, self.first, self.count = owner[order], first, count
        self.low = np.zeros(1 << 20, dtype=bool)
        self.low[self.pairs & np.uint64((1 << 20) - 1)] = True

    def key_of(self, k: int, low: int, n: int, embedding: int) -> np.ndarray:
        """The keys of a part of item k in the tables of an embedding."""
        at = (k, low, embedding)
        if at not in self.keys:
            own = walk(self.words[k][low : low + n], np.zeros(1, dtype=np.intp), n, embedding)
            self.keys[at] = table_keys(own, n, embedding, self.s)[0]
        return self.keys[at]

    def shared_pairs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text's word pairs that items have, and the number of each pair."""
        pairs = pair_hashes(words)
        some = np.flatnonzero(self.low[pairs & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.pairs, pairs[some]), len(self.pairs) - 1)
        same = self.pairs[at] == pairs[some]
        return some[same], at[same]

    def items_of(self, pairs: np.ndarray) -> np.ndarray:
        return gather(self.owner, self.first[pairs], self.count[pairs])

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(item index, edits, first word, word after the last)`` of every item that the text holds."""
        if len(words) < 2 or not self.words:
            return []
        places, pairs = self.shared_pairs(words)
        out = []
        present = np.bincount(self.items_of(np.unique(pairs)), minlength=len(self.words))
        for k in np.flatnonzero(present >= self.different).tolist():
            starts = self._windows(places[np.isin(self.pairs[pairs], self.own[k])], len(words), k)
            # Windows close to each other are one place; a walk that meets the item's has it compared exactly, once. No
            # two places share a word.
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > len(self.words[k]) + 2 * self.edits[k]) + 1):
                if len(run) and self._meets(words, k, run):
                    out += self._verified(words, k, int(run[0]), int(run[-1]))
        return out

    def _windows(self, places: np.ndarray, size: int, k: int) -> np.ndarray:
        """Starts of the item-sized windows at which a passage with enough word pairs of item k can start."""
        n, d = len(self.words[k]), int(self.edits[k])
        if size < n - d:
            return places[:0]
        marks = np.zeros(size + n + d, dtype=np.int64)
        marks[places + 1] = 1
        sums = np.cumsum(marks)
        # The pairs of n + d words are one fewer than the words.
        reach = sums[n + d - 1 : size + n + d - 1] - sums[:size]
        return np.flatnonzero(reach >= self.least[k])

    def _meets(self, words: np.ndarray, k: int, run: np.ndarray) -> bool:
        """Does the walk of a window that starts in ``run`` share a key with the item's, in any table?"""
        size = len(self.words[k])
        parts = parts_of(size, self.s)
        # Edits before a part move it by as many words at most.
        shift = int(self.edits[k]) if len(parts) > 1 else 0
        for low, n in parts:
            first, last = max(0, int(run[0]) + low - shift), min(len(words) - 1, int(run[-1]) + low + shift)
            count = self.counts[n, int(self.edits[k]) // len(parts)]
            if count is None:
                return True
            for at in range(first, last + 1, 1024):
                starts = np.arange(min(1024, last + 1 - at))
                region = words[at : at + len(starts) + n]
                for e in range(count):
                    keys = table_keys(walk(region, starts, n, e), n, e, self.s)
                    if (keys == self.key_of(k, low, n, e)).any():
                        return True
        return False

    def _verified(self, words: np.ndarray, k: int, first: int, last: int) -> list[tuple[int, int, int, int]]:
        item, d = self.words[k], int(self.edits[k])
        start = max(0, first - d)
        found = occurrences(item, words[start : last + len(item) + d], d)
        return [(k, edits, start + low, start + high) for edits, low, high in found]


def embedding_counts(rows: list[tuple[int, str]], s: Settings) -> dict[tuple[int, int], int | None]:
    """``embeddings_for`` of every length and bound that parts of the items have."""
    sizes = {len(fold(text).split()) for _, text in rows}
    kinds = {(part, int(n * s.edits) // len(parts)) for n in sizes if n >= s.least_words for parts in [parts_of(n, s)] for _, part in parts}
    return {kind: embeddings_for(*kind, s) for kind in sorted(kinds)}


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix(mix(words[:-1], 41) + words[1:], 42)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, item_id, start, length, edits, item_words)``: the places where a document holds an item.

    Windows of the item's size that keep enough of its word pairs for the bound of edits (an exact bound) are embedded by
    random walks; a window that shares a sampled key with the item has its place compared exactly. So no row is wrong,
    and of the passages at the bound of edits ``settings.recall`` are met; copies always are.

    ``docs (doc_id, text, ...)``, ``benchmark (item_id, text, ...)``. Words are compared with A-Z in lower case and
    without punctuation at their ends; ``start`` and ``length`` count characters of the text. Null and empty texts
    and items of fewer than ``least_words`` words match nothing; repeated items count once, repeated documents give
    repeated rows, several places of one item give a row each; an empty table on either side gives no row.
    """
    small_batches(spark)
    found = None
    for rows in _blocks(benchmark, settings):
        part = _search(spark, docs.select("doc_id", "text"), rows, settings)
        found = part if found is None else found.unionByName(part)
    return found


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns and no shuffle."""
    small_batches(spark)
    at = docs.columns.index("text")

    def filtered(frame: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast((rows, embedding_counts(rows, settings)))

        def run(batches):
            items, memo = Items(sent.value[0], settings, sent.value[1]), BareWordHashes()
            for batch in batches:
                keep = [not items.matches(memo.of(fold(t).split())) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return frame.mapInArrow(run, frame.schema)

    for rows in _blocks(benchmark, settings):
        docs = filtered(docs, rows)
    return docs


def _blocks(benchmark: DataFrame, s: Settings):
    """The distinct items in blocks of about ``block_words`` words: one, unless the benchmark is larger than that."""
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-words // s.block_words))
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        yield [(r["item_id"], r["text"]) for r in block]


def _search(spark: SparkSession, docs: DataFrame, rows: list[tuple[int, str]], s: Settings) -> DataFrame:
    sent = spark.sparkContext.broadcast((rows, embedding_counts(rows, s)))
    word = re.compile(rb"[^\x20\x09-\x0d]+")

    def run(batches):
        items, memo = Items(sent.value[0], s, sent.value[1]), BareWordHashes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = fold(text)
                got = items.matches(memo.of(raw.split()))
                if got:
                    places = [m.span() for m in word.finditer(raw)]
                    for k, edits, first, end in sorted(got):
                        a, b = places[first][0], places[end - 1][1]
                        start = len(raw[:a].decode("utf-8", "replace"))
                        out.append((doc_id, items.ids[k], start, len(raw[a:b].decode("utf-8", "replace")), edits, len(items.words[k])))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "length", "edits", "item_words"])

    typed = docs.select(C("doc_id").cast("bigint"), "text")
    return typed.mapInArrow(run, "doc_id bigint, item_id bigint, start bigint, length bigint, edits bigint, item_words bigint")
