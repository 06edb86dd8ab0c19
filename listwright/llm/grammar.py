"""Token files compressed by a grammar of repeated id pairs, with random access to every document."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.encoding import encoder, gather
from listwright.llm.storage import Scratch, open_folder, small_batches

C = F.col
MAGIC = b"PAIRS001"
HEAD = struct.Struct("<8sIIIII")
#: Ids of one block: it has its own rules, so a task's memory is bounded and any block can be read alone.
BLOCK = 1 << 21
SLOT_BITS = 20
#: Symbols fit in three bytes.
SHIFT = 24
ROUNDS, PER_ROUND, LEAST, GAIN = 12, 4096, 24, 0.97


def build(ids: np.ndarray, ends: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules ``(left, right)``, symbols, and each document's first symbol; rule k is symbol ``alphabet + k``.

    Each round counts all adjacent pairs, gives the most frequent ones a new symbol each and replaces them from
    left to right. No pair crosses a document's end. Pairs are counted in hashed slots; a slot stands for one
    pair only, whose exact count must reach ``LEAST``.
    """
    symbols = ids.astype(np.int64)
    last = np.zeros(len(symbols), dtype=bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    made = 0
    for _ in range(ROUNDS):
        if len(symbols) < 2:
            break
        codes = (symbols[:-1] << SHIFT) | symbols[1:]
        slots = ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
        counts = np.bincount(slots, minlength=1 << SLOT_BITS)
        often = np.flatnonzero(counts >= LEAST)
        if len(often) > PER_ROUND:
            often = often[np.argpartition(counts[often], -PER_ROUND)[-PER_ROUND:]]
        chosen = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
        chosen[often] = 0
        places = np.flatnonzero((chosen[slots] == 0) & ~last[:-1])
        chosen[slots[places]] = codes[places]
        places = places[chosen[slots[places]] == codes[places]]
        exact = np.bincount(slots[places], minlength=1 << SLOT_BITS)
        good = np.flatnonzero(exact >= LEAST)
        if not len(good) or made + len(good) + alphabet >= 1 << SHIFT:
            break
        number = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
        number[good] = np.arange(len(good))
        places = places[number[slots[places]] >= 0]
        # Of places that overlap, every other one from the left of their run is replaced.
        starts = np.concatenate(([True], np.diff(places) > 1))
        since = np.arange(len(places)) - np.maximum.accumulate(np.where(starts, np.arange(len(places)), 0))
        places = places[since % 2 == 0]
        rules.append(np.stack((chosen[good] >> SHIFT, chosen[good] & ((1 << SHIFT) - 1)), axis=1))
        before = len(symbols)
        symbols[places] = alphabet + made + number[slots[places]]
        last[places] = last[places + 1]
        keep = np.ones(before, dtype=bool)
        keep[places + 1] = False
        symbols, last = symbols[keep], last[keep]
        made += len(good)
        if len(symbols) > GAIN * before:
            break
    firsts = np.concatenate(([0], np.flatnonzero(last) + 1))
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)
    return table, symbols, firsts


def expansions(rules: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of every symbol as runs of one array: ``flat``, ``starts`` and ``lengths`` by symbol."""
    n = alphabet + len(rules)
    lengths = np.ones(n, dtype=np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[alphabet + k] = lengths[a] + lengths[b]
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), dtype=np.int64)
    flat[:alphabet] = np.arange(alphabet)
    for k, (a, b) in enumerate(rules.tolist()):
        at, la, lb = starts[alphabet + k], lengths[a], lengths[b]
        flat[at : at + la] = flat[starts[a] : starts[a] + la]
        flat[at + la : at + la + lb] = flat[starts[b] : starts[b] + lb]
    return flat, starts, lengths


def _three(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").reshape(-1, 1).view(np.uint8)[:, :3]).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
    out[:, :3] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.int64)


def to_bytes(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, alphabet: int) -> bytes:
    """One block: head, document ids and their nulls, first symbols, rules with expansion lengths, symbols."""
    rules, symbols, firsts = build(ids, ends, alphabet)
    _, _, lengths = expansions(rules, alphabet)
    return b"".join((
        HEAD.pack(MAGIC, alphabet, len(doc_ids), len(rules), len(symbols), len(ids)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        firsts.astype("<u4").tobytes(),
        _three(rules.ravel()),
        lengths[alphabet:].astype("<u4").tobytes(),
        _three(symbols),
    ))


class Block:
    """A block's parts; ``document(k)`` and ``token(k, i)`` expand no more than they need."""

    def __init__(self, raw: bytes):
        magic, self.alphabet, docs, rules, symbols, self.n_ids = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        at = HEAD.size
        take = lambda n: raw[at : at + n]
        ids, at = np.frombuffer(take(8 * docs), "<i8"), at + 8 * docs
        null, at = np.frombuffer(take(docs), np.uint8), at + docs
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null)]
        self.firsts, at = np.frombuffer(take(4 * (docs + 1)), "<u4").astype(np.int64), at + 4 * (docs + 1)
        self.rules, at = _wide(take(6 * rules)).reshape(-1, 2), at + 6 * rules
        self.lengths = np.concatenate((np.ones(self.alphabet, np.int64), np.frombuffer(take(4 * rules), "<u4").astype(np.int64)))
        at += 4 * rules
        self.symbols = _wide(take(3 * symbols))
        self._runs = None

    def document(self, k: int) -> np.ndarray:
        if self._runs is None:
            self._runs = expansions(self.rules, self.alphabet)
        flat, starts, lengths = self._runs
        own = self.symbols[self.firsts[k] : self.firsts[k + 1]]
        return gather(flat, starts[own], lengths[own]).astype(np.int32)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block and each document's first place in them, with the end as last."""
        flat, starts, lengths = expansions(self.rules, self.alphabet)
        own = lengths[self.symbols]
        ends = np.concatenate(([0], np.cumsum(own)))
        return gather(flat, starts[self.symbols], own), ends[self.firsts]

    def token(self, k: int, i: int) -> int:
        """Token i of document k: skip by expansion lengths, then walk down the rules."""
        own = self.symbols[self.firsts[k] : self.firsts[k + 1]]
        ends = np.cumsum(self.lengths[own])
        at = int(np.searchsorted(ends, i, side="right"))
        symbol, i = int(own[at]), i - int(ends[at] - self.lengths[own[at]])
        while symbol >= self.alphabet:
            left, right = self.rules[symbol - self.alphabet]
            if i < self.lengths[left]:
                symbol = int(left)
            else:
                symbol, i = int(right), i - int(self.lengths[left])
        return symbol


def write_files(
    spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2
) -> DataFrame:
    """Write the ids of all documents in ascending ``doc_id`` order; return the index, one row per block.

    Index: ``part, block, file, at, bytes, first_id`` (ids before the block in its part) and ``n_ids``. A file is
    named by the attempt that wrote it and only finished tasks return index rows, so a repeated task does no harm.
    A null or empty text is its end id alone; null ids come first; repeated rows stay; an empty table has no block.
    """
    small_batches(spark)

    def run(batches):
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        alphabet = max(encode.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        tail = np.array([end_id], dtype=np.int32)
        held: list[tuple[int | None, np.ndarray]] = []
        state = {"file": None, "name": "", "at": 0, "first": 0, "block": 0, "ids": 0}

        def flush():
            ids = np.concatenate([x for _, x in held])
            raw = to_bytes([d for d, _ in held], ids, np.cumsum([len(x) for _, x in held]), alphabet)
            if state["file"] is None:
                system, path = open_folder(folder)
                name = f"{path}/ids-{part:06d}-{uuid.uuid4().hex}.bin"
                state["file"], state["name"] = system.open_output_stream(name), name.rsplit("/", 1)[1]
            state["file"].write(raw)
            row = [part, state["block"], state["name"], state["at"], len(raw), state["first"], len(ids)]
            state["at"] += len(raw)
            state["first"] += len(ids)
            state["block"] += 1
            state["ids"] = 0
            held.clear()
            return row

        rows = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate((encode.encode(text), tail))
                held.append((doc_id, ids))
                state["ids"] += len(ids)
                if state["ids"] >= BLOCK:
                    rows.append(flush())
        if held:
            rows.append(flush())
        if state["file"] is not None:
            state["file"].close()
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "block", "file", "at", "bytes", "first_id", "n_ids"])

    ordered = docs.select(C("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "part bigint, block bigint, file string, at bigint, bytes bigint, first_id bigint, n_ids bigint")


def read_files(index: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document in the files; ``start`` counts the ids of all documents before."""
    totals = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row a part: the running total over parts is small beside the files.
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - C("n")).alias("base"))
    blocks = index.join(before, "part").select("file", "at", "bytes", (C("base") + C("first_id")).alias("first"))
    blocks = blocks.repartition(max(1, min(index.count(), 10_000)), "file", "at")

    def run(batches):
        system, path = open_folder(folder)
        for batch in batches:
            for name, at, size, first in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(f"{path}/{name}") as file:
                    file.seek(at)
                    block = Block(file.read(size))
                ids, places = block.documents()
                raw, bounds = ids.astype("<u4").tobytes(), (4 * places).tolist()
                for low in range(0, len(block.doc_ids), 512):
                    high = min(low + 512, len(block.doc_ids))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(block.doc_ids[low:high], pa.int64()), pa.array(first + places[low:high], pa.int64()),
                        pa.array([raw[bounds[k] : bounds[k + 1]] for k in range(low, high)], pa.binary()),
                    ], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def encode_and_read(spark: SparkSession, docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Write the files to a new shared folder and read them back."""
    scratch = Scratch(spark, "grammar")
    folder = scratch.path("files")
    index = scratch.keep(write_files(spark, docs, folder, vocabulary, end_id), "index")
    return read_files(index, folder)
