"""Packing of documents into fixed windows by dynamic programming over document and sentence ends."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.encoding import encoder
from listwright.llm.storage import small_batches

C = F.col
#: What a cut costs, in tokens of padding: at a document's end nothing, at a sentence's end or inside a sentence.
SENTENCE, INSIDE = 4.0, 24.0
#: A sentence of more than GAP tokens may also be cut after every GRID tokens.
GAP, GRID = 64, 32
#: Tokens that a task gathers before it settles windows; the unfinished last window goes on with the next.
BLOCK = 1 << 18


def sentence_ends(encode) -> np.ndarray:
    """By id: does the token end a sentence or a line?"""
    vocabulary = encode.library.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 2, dtype=bool)
    for token, at in vocabulary.items():
        token = token.removesuffix("</w>")
        out[at] = "Ċ" in token or token.endswith((".", "!", "?"))
    return out


def cut_places(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending, and the penalty of each. ``ends``: places after each document."""
    inner = np.flatnonzero(stops[np.minimum(ids, len(stops) - 1)]) + 1
    places = np.union1d(inner, ends)
    before = np.concatenate(([0], places[:-1]))
    wide = places - before > GAP
    extra = [np.arange(a + GRID, b, GRID) for a, b in zip(before[wide], places[wide])]
    grid = np.concatenate(extra) if extra else np.zeros(0, dtype=places.dtype)
    merged = np.concatenate((places, grid))
    penalty = np.concatenate((np.full(len(places), SENTENCE), np.full(len(grid), INSIDE)))
    order = np.argsort(merged, kind="stable")
    merged, penalty = merged[order], penalty[order]
    penalty[np.searchsorted(merged, ends)] = 0.0
    return merged, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, length: int, last: bool) -> list[int]:
    """Window ends of least padding plus penalties, in order.

    ``cost[i] = length + penalty[i] + min(cost[j])`` over the ends j at most ``length`` before i: a sliding
    minimum, kept in a queue of ascending costs. If more tokens follow, the ends stop where the padding and
    penalties so far are least within the last window's reach, and the rest is left for later.
    """
    at, fee = places.tolist(), penalty.tolist()
    cost, back = [0.0] * len(at), [-1] * len(at)
    queue: deque = deque([(0.0, 0, -1)])
    for i, here in enumerate(at):
        low = here - length
        while queue[0][1] < low:
            queue.popleft()
        least, _, j = queue[0]
        cost[i] = value = least + length + fee[i]
        back[i] = j
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, i))
    i = len(at) - 1
    if not last:
        while i > 0 and at[i - 1] >= at[-1] - length:
            i -= 1
        i = min(range(i, len(at)), key=lambda k: cost[k] - at[k])
    out = []
    while i >= 0:
        out.append(at[i])
        i = back[i]
    return out[::-1]


class _Buffer:
    """Tokens of consecutive documents that are not yet in a window."""

    def __init__(self, length: int, stops: np.ndarray):
        self.length, self.stops, self.sequence = length, stops, 0
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens already placed, tokens in all
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)

    def settle(self, last: bool):
        """Rows of the windows that are settled: id, start, length, ids, tokens, sequence, offset."""
        ids = np.concatenate(self.ids)
        ends = np.cumsum([total - done for _, done, total in self.docs])
        places, penalty = cut_places(ids, ends, self.stops)
        cuts = np.array(best_cuts(places, penalty, self.length, last))
        bounds = np.union1d(cuts, ends[ends <= cuts[-1]])
        doc_at, starts = 0, [0, *ends[:-1].tolist()]
        window_start, window, rows, begin = 0, 0, [], 0
        for end in bounds.tolist():
            doc_id, done, total = self.docs[doc_at]
            rows.append((doc_id, done + begin - starts[doc_at], end - begin, ids[begin:end], total, self.sequence + window, begin - window_start))
            if end == ends[doc_at]:
                doc_at += 1
            if end == cuts[window]:
                window, window_start = window + 1, end
            begin = end
        self.sequence += window
        if doc_at < len(self.docs):
            doc_id, done, total = self.docs[doc_at]
            self.docs = [(doc_id, done + begin - starts[doc_at], total), *self.docs[doc_at + 1 :]]
        else:
            self.docs = []
        rest = ids[begin:]
        self.ids, self.held = ([rest] if len(rest) else []), len(rest)
        return rows


PIECE_FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def pack_documents(
    spark: SparkSession, docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, length: int = 2048
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    Documents go by ascending ``doc_id`` (null first) into ranges; in each range windows of at most ``length`` tokens
    follow each other in order, cut where padding plus penalties are least. ``ids`` holds unsigned 32-bit
    little-endian ids. A null or empty text is its end id alone. Repeated rows are packed as often as they occur.
    A document longer than a window spans several. An empty table gives no rows. Other columns are ignored.
    ``sequence_id`` is the range's number times 2 ** 32 plus the window's number; only a range's last window
    can be far from full.
    """
    small_batches(spark)

    def run(batches):
        encode = encoder(vocabulary)
        buffer = _Buffer(length, sentence_ends(encode))
        first = TaskContext.get().partitionId() << 32
        tail = np.array([end_id], dtype=np.int32)

        def out(last: bool):
            rows = buffer.settle(last)
            columns = list(zip(*rows))
            columns[3] = [x.astype("<u4").tobytes() for x in columns[3]]
            columns[5] = [first + x for x in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE_FIELDS)], schema=PIECE_FIELDS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buffer.add(doc_id, np.concatenate((encode.encode(text), tail)))
                if buffer.held >= BLOCK:
                    yield out(False)
        if buffer.held:
            yield out(True)

    ordered = docs.select(C("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
