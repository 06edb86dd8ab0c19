"""Token ids of whole texts by a tokenizer file, with a memo of the pieces between spaces."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

#: Pieces and words a worker remembers; a full memo starts anew, results do not change.
MEMO, WORDS = 800_000, 400_000
#: The split that a byte-level pre-tokenizer makes by itself.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces in which both regular expression libraries see the same letters, digits and white space.
PLAIN = re.compile(r" ?[\n\x21-\x7e\xa1-\xac\xae-\xff]+\Z")
#: Marks that the split keeps together in one word after letters.
MARKS = ".,;:!?*#$%&|)"
SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0"
BESIDE_SPACE = re.compile(r"\s | \s|^ | $")
CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def vocabulary_path(name: str) -> str:
    """A file's own path, or the place of a public vocabulary on the machine that asks."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.flat, self.starts, self.lengths = array("i"), array("q"), array("q")

    def __missing__(self, piece: str) -> int:
        ids = self.encode(piece)
        at = self[piece] = len(self.starts)
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids) // 4)
        self.flat.frombytes(ids)
        return at

    def reset(self) -> None:
        self.clear()
        del self.flat[:], self.starts[:], self.lengths[:]


def latin(text: str) -> bool:
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return True


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]`` one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(total)]


class TextEncoder:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Both kinds of vocabulary known here never merge across a space between two other characters, so a text is cut
    there and each distinct piece is encoded once. A vocabulary of another kind, a text with the mark of a special
    token and a piece with other characters than Latin-1 go through the library's whole encoder.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind, self.lower = None, False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
            self.kind, pattern = "kept", SPACED
        elif pre.get("type") == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
            split, level = pre["pretokenizers"]
            steps = [n["type"] for n in (normal or {}).get("normalizers", [])]
            if split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and set(steps) <= {"NFC", "Replace", "Lowercase"}:
                self.kind, pattern, self.lower = "dropped", split["pattern"]["Regex"], "Lowercase" in steps
        if self.kind:
            self.pattern = regex.compile(pattern)
            self.letters = str.maketrans(byte_letters())
            self.marks = tuple(t["content"] for t in spec.get("added_tokens", []))
            self.words: dict[str, bytes] = {}
            self.pieces = _Pieces(self._spaced if self.kind == "kept" else self._piece)

    def _spaced(self, piece: str) -> bytes:
        return self._piece(piece, " ")

    def _whole(self, text: str) -> bytes:
        return array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str, space: str = "") -> bytes:
        """The piece's ids as 32-bit integers; bytes take a third of a list's memory."""
        if not piece:
            return b""
        if piece[0] == "\n" and not piece[1:2].isspace() and not self.lower:
            return self._word("\n") + self._piece(piece[1:])
        if not piece.isascii() and not PLAIN.match(piece):
            return self._whole(space + piece)
        if self.lower:
            piece = piece.lower()
        # Most pieces are letters with marks after them: two words of the split.
        letters = piece.rstrip(MARKS)
        if letters.isalpha():
            ids = self._word(space + letters)
            return ids + self._word(piece[len(letters) :]) if len(letters) < len(piece) else ids
        if not PLAIN.match(piece):
            return self._whole(space + piece)
        return b"".join(map(self._word, self.pattern.findall(space + piece)))

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            letters = word.translate(self.letters) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = array("i", [t.id for t in self.library.model.tokenize(letters)]).tobytes()
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _cut(self, text: str) -> list[str] | None:
        """Pieces of a text whose spaces and line ends stand alone between other characters, else None."""
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return None
        if not latin(text):
            return None if BESIDE_SPACE.search(text) else text.split(" ")
        if any(c in text for c in SPACES):
            return None
        # A single line end is a word of its own; the text after it has no space.
        return (text if "\n\n" in text or text[-1] == "\n" else text.replace("\n", " \n")).split(" ")

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        if self.kind is None or any(m in text for m in self.marks):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        first = b""
        if self.kind == "kept":
            cut = self._cut(text)
            if cut is None:
                start, *rest = CUT.split(text)
                cut = [start, *(p[1:] for p in rest)]
            first, cut = self._piece(cut[0]), cut[1:]
        else:
            cut = (text.lower() if self.lower and latin(text) else text).replace("\n", " ").split(" ")
        if len(self.pieces) >= MEMO:
            self.pieces.reset()
        at = np.fromiter(map(self.pieces.__getitem__, cut), dtype=np.int64, count=len(cut))
        if not len(at):
            return np.frombuffer(first, dtype=np.int32)
        flat, starts, lengths = (np.frombuffer(x, dtype=d) if len(x) else np.zeros(0, d) for x, d in (
            (self.pieces.flat, np.int32), (self.pieces.starts, np.int64), (self.pieces.lengths, np.int64)))
        rest = gather(flat, starts[at], lengths[at])
        return np.concatenate((np.frombuffer(first, dtype=np.int32), rest)) if first else rest


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(name: str) -> TextEncoder:
    """The encoder of this worker process; its memo serves all tasks that the worker runs."""
    if name not in _ENCODERS:
        _ENCODERS[name] = TextEncoder(vocabulary_path(name))
    return _ENCODERS[name]
