"""Byte-level BPE through the tokenizers library, remembered by word.

The library takes most of its time for words that it has already seen. So a text is cut where a
space stands before a character that isn't white space, which always starts a new match of the
pattern; each distinct piece is matched and encoded by the library and remembered by the worker, in
two generations, so that frequent words stay when the older one goes.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from functools import lru_cache

import numpy as np
import regex

from .common import remembers

#: Pieces in a generation of a worker's memory; forgetting changes no result.
BOUND = 350_000
_SPACE, _CUT = regex.compile(r"\s"), regex.compile(r" (?=\S)")
#: Alternatives of a pattern by which a space and letters are one match, and marks behind them another.
_LETTERS, _MARKS = r" ?\p{L}+", r" ?[^\s\p{L}\p{N}]+"
_TAIL = ".,;:!?#*$%&()[]{}<>|-_/\\\""


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


_CHARS = "".join(byte_chars())
_BYTES = codecs.charmap_build(_CHARS)


def to_chars(data: bytes) -> str:
    """Each byte's character."""
    return codecs.charmap_decode(data, "strict", _CHARS)[0]


def to_bytes(chars: str) -> bytes:
    """The byte that each character stands for: the table reversed."""
    return codecs.charmap_encode(chars, "strict", _BYTES)[0]


def _packed(tokens) -> bytes:
    return array("I", [t.id for t in tokens]).tobytes()


class _Wide(Exception):
    """A space stands before white space or the end: only then can it not start a match."""


class _Memory(dict):
    """Remembers what make gives for a key; entries of the older generation that are asked for again
    come over to the newer one."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= BOUND:
            self.older = self.copy()
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Ids of whole texts under a tokenizers model and a pattern; as packed little-endian uint32."""

    def __init__(self, model, pattern: str, added: dict[str, int] | None = None):
        self.model = model
        #: Strings that are one id each, wherever they stand; texts are cut at them first.
        self.added = {s: array("I", [i]).tobytes() for s, i in (added or {}).items()}
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.added, key=len, reverse=True))) if added else None
        self.match = regex.compile(pattern).findall
        self.letters = {_LETTERS, _MARKS} <= set(pattern.split("|"))
        self.pieces = _Memory(self._ids)
        self.words = _Memory(self._word)

    def _ids(self, piece: str) -> bytes:
        """Ids of one match of the pattern."""
        return _packed(self.tokens(piece))

    def _word(self, word: str) -> bytes:
        """Ids of a space and word; _Wide, and nothing is remembered, if white space follows the space."""
        if not word or _SPACE.match(word):
            raise _Wide
        if self.letters:
            if word.isalpha():
                # Letters of ASCII are their own characters, and a space's is the 33rd.
                return self._ids(f" {word}") if not word.isascii() else _packed(self.model.tokenize(_CHARS[32] + word))
            stem = word.rstrip(_TAIL)
            if stem.isalpha():
                return self.words[stem] + self.pieces[word[len(stem) :]]
        return b"".join(map(self.pieces.__getitem__, self.match(f" {word}")))

    def rest(self) -> None:
        """Between tasks only the newer generation is kept."""
        self.words.older, self.pieces.older = {}, {}

    def tokens(self, piece: str):
        """The library's tokens of one match, over its bytes' characters: id, value and offsets."""
        return self.model.tokenize(to_chars(piece.encode()))

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.added):
            return self._plain(text)
        return b"".join(self.added.get(part) or self._plain(part) for part in self.cut.split(text) if part)

    def _plain(self, text: str) -> bytes:
        try:
            return self._joined(text.split(" "))
        except _Wide:
            return self._joined(_CUT.split(text))

    def _joined(self, parts: list[str]) -> bytes:
        # A leading space is an empty first piece; every later piece has its space again.
        first = b"".join(map(self.pieces.__getitem__, self.match(parts[0])))
        del parts[0]
        return first + b"".join(map(self.words.__getitem__, parts))


@lru_cache(maxsize=4)
def json_encoder(path: str, pattern: str) -> Encoder:
    """For a tokenizers file whose pre-tokenizer is byte level with the given pattern; its added tokens'
    strings are their ids, as in the library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    added = library.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
        raise ValueError("added tokens that depend on what stands beside them")
    return Encoder(library.model, pattern, {t.content: i for i, t in added.items()})


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> tuple[Encoder, list[str]]:
    """An encoder for a rank file, and the characters of each id.

    The rank rule joins the neighbours whose joint bytes have the least rank, so every way to cut a
    token in two known ones is a merge, in the order of the tokens' ranks; a whole match that is a
    token stays one.
    """
    from tokenizers.models import BPE

    ranks = read_ranks(path)
    name = {t: to_chars(t) for t in ranks}
    merges = [
        (name[t[:i]], name[t[i:]])
        for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
    ]
    model = BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    table = [""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        table[r] = name[t]
    return Encoder(model, pattern), table


def _forget() -> None:
    json_encoder.cache_clear()
    rank_encoder.cache_clear()


remembers("tokens", _forget)
