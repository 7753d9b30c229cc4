"""Cached encoders over public vocabulary files; the files' paths are parameters and stay where they are."""

from __future__ import annotations

import re
from array import array
from sys import byteorder

from tokenizers import Tokenizer

_ENCODERS: dict[tuple, "UnitEncoder"] = {}
#: Between two characters that are no white space in any reading of it, a space always ends a piece.
_SAFE_SPACE = re.compile("(?<=[^\\s᠎​-‏⁠﻿]) (?=[^\\s᠎​-‏⁠﻿])")
#: Characters of the longest unit that is cached.
LONG = 1 << 12
#: ASCII signs but the apostrophe, which can start a piece of its own kind.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if byteorder == "big":
        out.byteswap()
    return out.tobytes()


def units_of(text: str) -> list[str]:
    """The text cut at single spaces that end a piece for certain; the spaces are dropped."""
    if not text:
        return []
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or not text.replace("\n", "").isprintable():
        return _SAFE_SPACE.split(text)
    return text.split(" ")


def sign_tail(unit: str) -> int:
    """Where a letter or digit ends and a run of ASCII signs goes on to the unit's end; else 0."""
    head = unit.rstrip(_SIGNS)
    return len(head) if len(head) < len(unit) and head[-1:].isalnum() and head[-1] <= "\xff" else 0


def line_break(unit: str) -> int:
    """Where the unit's first line feed stands if it is between two printing characters; else 0."""
    at = unit.find("\n")
    inside = 0 < at < len(unit) - 1 and unit[at - 1].isprintable() and unit[at - 1] != " " and unit[at + 1].isprintable() and unit[at + 1] != " "
    return at if inside else 0


class UnitEncoder(dict):
    """Unit of text -> its ids, through the tokenizers library, in a cache of bounded size.

    Both vocabularies split a text into pieces before they merge, and a piece never goes past a single
    space between two other characters. So a text is cut there, each unit is encoded once, and ids are
    joined: the same ids as for the whole text, without encoding common words again and again.
    keeps_space: whether a unit takes the space before it (byte-level BPE) or drops it (word-end BPE).
    The string of an added token, as "<|endoftext|>", is that one token, as the library has it; a text that may
    hold one goes through the library whole. The cache is bounded by its units' bytes as well as their number.
    """

    def __init__(self, path: str, keeps_space: bool, most: int = 600_000, most_chars: int = 1 << 25):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.keeps_space, self.most, self.most_chars, self.chars = keeps_space, most, most_chars, 0
        # the byte-level alphabet for what a plain unit may hold: a space and Latin letters
        table = {32: 0x120} | {b: b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(128, 256)}
        rest = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.alphabet = table | {b: 256 + i for i, b in enumerate(rest)}

    def _word(self, unit: str) -> bytes | None:
        """The ids of a unit that is one piece for certain: Latin-1 letters only, after an optional space."""
        word = unit[1:] if self.keeps_space and unit[:1] == " " else unit
        if not word.isalpha() or (not word.isascii() and max(word) > "\xff"):
            return None
        piece = unit if self.keeps_space else unit.lower()
        if piece.isascii():
            piece = piece.replace(" ", "Ġ")
        else:
            piece = piece.encode().decode("latin-1").translate(self.alphabet)
        return _packed([t.id for t in self.model.tokenize(piece)])

    def __missing__(self, unit: str) -> bytes:
        out = self._word(unit)
        if out is None:
            if at := sign_tail(unit):
                return self[unit[:at]] + self[unit[at:]]
            if at := line_break(unit):
                return self[unit[:at]] + (self["\n"] if self.keeps_space else b"") + self[unit[at + 1 :]]
            out = _packed(self.library.encode(unit, add_special_tokens=False).ids)
        if len(self) >= self.most or self.chars >= self.most_chars:
            self.clear()
            self.chars = 0
        if len(unit) <= LONG:  # longer ones hardly come again
            self[unit] = out
            self.chars += len(unit)
        return out

    def _may_hold_added(self, text: str) -> bool:
        """Case is let alone, as the library may look for their strings in lower-cased text."""
        low = text.lower()
        return any(a in low for a in self.added)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self._may_hold_added(text):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        units = units_of(text)
        if self.keeps_space:
            units[1:] = [" " + u for u in units[1:]]
        return b"".join(map(self.__getitem__, units))


def encoder(path: str, keeps_space: bool) -> UnitEncoder:
    """One for each process and file: a Python worker keeps its cache from task to task."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(path, keeps_space)
    return _ENCODERS[key]
