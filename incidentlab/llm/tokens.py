"""Token ids by public tokenizer files, with a cache of the words a task has seen.

A text is cut where no token can cross: at white space. Each piece goes
through the library's own model once and is remembered as the bytes of its
ids, so a document is one join of byte strings. Pieces outside the plain
alphabet, and texts with unusual white space, go through the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

# The letters and digits of Latin-1, the split patterns of the two vocabularies restricted to them,
# and the characters that count as white space in one library and not in the other.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
DIGITS = "0-9²³¹¼½¾"
WORD_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
BYTE_PATTERN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"[\n -~¡-¬®-ÿ]*")
UNUSUAL_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")

CACHE_ENTRIES = 300_000
ID_TYPE = np.dtype("<u4")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    """Word to id bytes. It forgets everything when full; the words come again by being asked for."""

    def __init__(self, make, limit=CACHE_ENTRIES):
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


class JsonEncoder:
    """A vocabulary of the tokenizers library.

    ``dropped_space``: white space only separates words (and case folds);
    otherwise white space belongs to the tokens.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        steps = str(self.tokenizer.normalizer)
        self.dropped_space = "Lowercase" in steps
        self.pattern = WORD_PATTERN if self.dropped_space else BYTE_PATTERN
        self.alphabet = _byte_alphabet()
        self.parts = _Cache(self._part)
        self.words = _Cache(self._word)
        self.spaced = _Cache(lambda piece: self._word(piece if piece[:1] == "\n" else " " + piece))

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            stand_in = part.replace(" ", self.alphabet[32])
        else:
            stand_in = part.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(stand_in)]).tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word or not PLAIN.fullmatch(word):
            return self.library(word)
        found = self.pattern.findall(word.lower() if self.dropped_space else word)
        return self.parts[found[0]] if len(found) == 1 else b"".join(map(self.parts.__getitem__, found))

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID_TYPE).tobytes()

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the character at which each starts, by the library."""
        coded = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(coded.ids, ID_TYPE), np.array([a for a, _ in coded.offsets], np.int64)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        if not text:
            return b""
        if self.dropped_space:
            if UNUSUAL_SPACE.search(text):
                return self.library(text)
            return b"".join(map(self.words.__getitem__, text.split()))
        pieces = text.replace("\n", " \n").split(" ")
        if "" not in pieces[1:]:
            return self.words[pieces[0]] + b"".join(map(self.spaced.__getitem__, pieces[1:]))
        if UNUSUAL_SPACE.search(text) or "\t" in text or "\r" in text:
            return self.library(text)
        return b"".join(map(self.words.__getitem__, CHUNK.findall(text)))


class ModelEncoder:
    """A vocabulary of the sentencepiece library."""

    def __init__(self, file: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=file)

    def ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text, num_threads=1), ID_TYPE).tobytes() if text else b""

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.model.encode(text, return_type="proto").pieces
        coded = np.frombuffer(text.encode(), np.uint8)
        char = np.append(np.cumsum((coded & 0xC0) != 0x80) - 1, len(text))  # the library counts bytes
        return np.array([p.id for p in pieces], ID_TYPE), char[np.array([p.begin for p in pieces], np.int64)]


@lru_cache(maxsize=4)
def encoder(file: str) -> JsonEncoder | ModelEncoder:
    """One encoder for each file and Python worker."""
    return ModelEncoder(file) if str(file).endswith(".model") else JsonEncoder(file)


def public_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
