"""Token ids of whole texts by a public tokenizer file, with each distinct piece of text encoded once per worker.

``WordEncoder`` serves tokenizers whose words never reach across white space; ``SpacedEncoder`` serves byte-level
ones whose words may begin with one space. Both cut a text only where the library itself starts a new word, so
their ids are the library's. A piece in plain Latin letters goes straight to the library's merge model; any other
piece goes through the whole library. Texts with special strings are encoded whole or split at those strings
first, and so are texts with separators that Python and the library class differently.
"""

from __future__ import annotations

import os
import re
import struct

# Control characters that Python counts as white space and the library does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
# What a byte-level word can begin with: one space and what follows, or the end of a run of white space.
SEGMENT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Pieces whose words are certain without the library: printable ASCII and the letters of Latin-1.
PLAIN = re.compile(" ?[!-~À-ÖØ-öø-ÿ]+")
# The word patterns of the two vocabularies, over plain pieces.
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+")
PLAIN_SPACED = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ A-Za-zÀ-ÖØ-öø-ÿ0-9]+"
)
CACHED = 400_000

_encoders: dict[tuple[str, str], object] = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoder(kind: type, path: str):
    """One encoder per worker process, kept between tasks."""
    key = (kind.__name__, path)
    if key not in _encoders:
        _encoders[key] = kind(path)
    return _encoders[key]


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, the rest from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Encoder:
    def __init__(self, path: str):
        self.library = load(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.letters = byte_letters()
        self.known: dict = {}

    def _merged(self, word: str) -> list:
        """The tokens of one word of the library's own cutting."""
        if not word.isascii() or word[0] == " ":
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return self.model.tokenize(word)

    def _looked_up(self, pieces: list[str]) -> list:
        known = self.known
        if len(known) > CACHED:  # starts anew, so that its size is bounded
            known = self.known = {}
        try:
            return [known[p] for p in pieces]
        except KeyError:
            for p in set(pieces).difference(known):
                known[p] = self._learned(p)
            return [known[p] for p in pieces]


class WordEncoder(_Encoder):
    """Ids as little-endian unsigned 32-bit integers."""

    def _learned(self, piece: str) -> bytes:
        if not PLAIN.fullmatch(piece):
            ids = self.library.encode(piece, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self._word, PLAIN_WORDS.findall(piece.lower())))

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            tokens = self._merged(word)
            ids = self.known[word] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def ids(self, text: str) -> bytes:
        if ODD_SPACE.search(text) or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(self._looked_up(text.split()))


class SpacedEncoder(_Encoder):
    """Numbers of ids."""

    def _learned(self, piece: str) -> int:
        if not PLAIN.fullmatch(piece):
            return len(self.library.encode(piece, add_special_tokens=False).ids)
        return sum(map(self._word, PLAIN_SPACED.findall(piece)))

    def _word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.known[word] = len(self._merged(word))
        return n

    def count(self, text: str) -> int:
        if ODD_SPACE.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return len(parts) - 1 + sum(self.count(p) for p in parts)
        return sum(self._looked_up(SEGMENT.findall(text)))
