"""Words, hashes and shingles of whole texts, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries of a task's memo of word hashes; a full memo starts anew, results do not change.
MEMO = 300_000


class WordHashes(dict):
    """Memo from a word's bytes to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def fold(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; other letters stay. Lone surrogates are replaced."""
    return (text or "").encode("utf-8", "replace").lower()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of the whole sequence when it is shorter. Nothing for no words."""
    size = min(size, len(hashes))
    if size == 0:
        return hashes
    count = len(hashes) - size + 1
    out = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= hashes[k : k + count]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(gram_hashes(hashes, size))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) == 0 or len(b) == 0:
        return 0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class BareWordHashes(WordHashes):
    """The same with ASCII punctuation taken off both ends; a word of punctuation alone stays as it is."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.strip(PUNCTUATION) or word)
        return got
