"""Token ids of whole texts by the ``tokenizers`` library, remembered by word.

Byte-level BPE never merges across the pieces that its pattern cuts a text into, so the ids of a
text are those of its pieces in order. No piece has white space but at its start, unless white
space runs on; so a text without such runs is cut into chunks before each space, which plain string
functions do. An ``Encoder`` finds the distinct chunks of some texts together and looks them up in a
table of bounded size; the pieces of those that are new go to the library's model, which is where it
sends them itself once it has cut a text. A text goes to the library whole if it has other than plain
characters (where two regex engines might class a character differently) or the beginning of one of
the file's added tokens, and so does every text of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa

#: Chunks that a worker remembers at most (about 200 MB), and characters that are cut into chunks at once, or one text.
REMEMBERED, CUT = 1_200_000, 1 << 21
#: Fixed value: the plain characters among ASCII.
_PLAIN_ASCII = bytes([9, 10, 13, *range(32, 127)])
#: Fixed value: characters whose class is the same in every Unicode version since 6.1.
_PLAIN = "[\t\n\r\x20-\x7e¡-ɏ‐-‧€]*"
#: Fixed value: the pattern that byte-level pre-tokenization is defined by.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs that are neither letters, numbers nor white space; ASCII letters; first bytes of plain characters that are letters but for two.
_SIGN, _LETTER, _LEAD = np.zeros((3, 256), bool)
_SIGN[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD[0xC3:0xCA] = True
#: Fixed value: the characters that byte-level models have for bytes. Those that are printed stand for themselves; 0 stays, it stands between pieces here.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = np.arange(256, dtype="<u2")
_BYTE_CHARS[[b for b in range(256) if b not in _PRINTED]] = range(256, 512 - len(_PRINTED))
_BYTE_CHARS[0] = 0


def letters_end(data: np.ndarray) -> np.ndarray:
    """Whether a letter ends with a byte of plain text in UTF-8."""
    out = _LETTER[data]
    out[1:] |= _LEAD[data[:-1]] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    return out


class Encoder:
    """From texts to their ids as little-endian unsigned integers of a width."""

    def __init__(self, path: str, width: str = "<u4", remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width, self.code = np.dtype(width), {2: "H", 4: "I"}[np.dtype(width).itemsize]
        self.table: dict[str, bytes] = {}
        self.remembered = remembered
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.marks = {x["content"][:2].lower() for x in told.get("added_tokens", [])}
        self.cased = any(mark.upper() != mark for mark in self.marks)
        before, cut = told.get("normalizer"), told.get("pre_tokenizer") or {}
        self.pieces, self.folds = None, False
        if before is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
            self.pieces = regex.compile(_BYTE_LEVEL).findall
        elif before and [x.get("type") for x in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and cut.get("type") == "Sequence":
            first = cut["pretokenizers"][0]
            if first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed":
                self.pieces, self.folds = regex.compile(first["pattern"]["Regex"]).findall, True
        self.unicode_plain = regex.compile(_PLAIN).fullmatch

    def plain(self, text: str) -> bool:
        return not text.encode().translate(None, _PLAIN_ASCII) if text.isascii() else bool(self.unicode_plain(text))

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if self.width.isnative else np.asarray(ids, self.width).tobytes()

    def chunks(self, text: str) -> str | None:
        """Parts of a text whose ids follow each other, with 0 between them; None if only the library can tell."""
        if self.pieces is None or not self.plain(text) or self.folds and not unicodedata.is_normalized("NFC", text):
            return None
        said = text.lower() if self.cased else text
        if any(mark in said for mark in self.marks):
            return None
        if self.folds:  # white space is dropped
            return "\0".join(text.lower().split())
        if "\t" in text or "\r" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return "\0".join(self.pieces(text))
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ")

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces by the library's model."""
        told = _BYTE_CHARS[np.frombuffer("\0".join(pieces).encode(), np.uint8)].tobytes().decode("utf-16-le").split("\0")
        model, packed = self.library.model.tokenize, self.packed
        return [packed([token.id for token in model(piece)]) for piece in told] if pieces else []

    def learn(self, new: list[str]) -> None:
        """Puts these chunks into the table."""
        words = [x for x in new if x.isalpha() or x[:1] == " " and x[1:].isalpha()]
        self.table.update(zip(words, self.ids_of(words), strict=True))
        odd = [(x, self.pieces(x)) for x in new if x not in self.table]
        ids = iter(self.ids_of([piece for _, pieces in odd for piece in pieces]))
        self.table.update([(x, b"".join(islice(ids, len(pieces)))) for x, pieces in odd])

    def gathered(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, given as its chunks with 0 between them."""
        raw = np.frombuffer("\1".join(texts).encode(), np.uint8)
        data, breaks = raw[raw > 1], np.flatnonzero(raw < 2)
        if not len(data):
            return [b""] * len(texts)
        ends = breaks - np.arange(len(breaks))
        edge = np.zeros(len(data) + 1, bool)
        edge[[0, -1]] = edge[ends] = True
        edge[1:-1] |= _SIGN[data[1:]] & letters_end(data)[:-1]  # a piece ends there in any case
        bounds = np.flatnonzero(edge)
        met = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        words = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.table.get, words))
        new = [k for k, x in enumerate(ids) if x is None]
        if new:
            known = len(self.table)
            self.learn([words[k] for k in new])
            for k in new:
                ids[k] = self.table[words[k]]
            if len(self.table) > self.remembered:  # what came first is met most often
                for chunk in list(islice(reversed(self.table), len(self.table) - max(known, self.remembered))):
                    del self.table[chunk]
        _, places, told = pa.array(ids, pa.large_binary()).take(met.indices).buffers()
        told = memoryview(told or b"")
        last = np.searchsorted(bounds, np.append(ends[raw[breaks] == 1], len(data)))
        stops = np.frombuffer(places, np.int64)[last].tolist()
        return [told[a:b].tobytes() for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none)."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size + len(texts[at] or "") <= CUT):
                some.append(texts[at] or "")
                size += len(some[-1])
                at += 1
            cut = [self.chunks(t) for t in some]
            told = iter(self.gathered([c for c in cut if c is not None]))
            out += [self.packed(self.library.encode(t, add_special_tokens=False).ids) if c is None else next(told) for t, c in zip(some, cut, strict=True)]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, width: str = "<u4") -> Encoder:
    """One for each worker process, file and width."""
    if (path, width) not in _encoders:
        _encoders.clear()
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]
