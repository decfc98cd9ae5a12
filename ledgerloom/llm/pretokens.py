"""Pre-tokens of texts as the tokenizer file of the word-end BPE cuts them.

Texts of Latin letters, which are nearly all, are cut by one compiled pattern; any other text goes through
the library's own normaliser and splitter, so both give the library's pieces. Special strings in a text are
single pieces, as is the library's default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: The contractions that the tokenizer file splits off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Code points of the fast path: tab, newline, carriage return, printable ASCII, Latin letters, common quotes and dashes.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-―‘-„•…€]*")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x21, 0x250) if unicodedata.category(chr(c))[0] == kind and chr(c) == chr(c).lower())


@lru_cache(1)
def _pattern() -> re.Pattern:
    letters, numbers = _class("L"), _class("N")
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")


#: Kinds of bytes: letters, digits, others, and those that need the slow way (quotes, controls, most of Unicode).
LETTER, DIGIT, OTHER, SLOW = range(4)


def _byte_kinds() -> np.ndarray:
    out = np.full(256, SLOW, np.uint8)
    out[0x21:0x7F] = OTHER
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[ord("'")] = SLOW
    return out


_KINDS = _byte_kinds()


def cut_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slow, folded, starts): which words need ``Cutter.pieces``, the bytes folded, and the first byte of each pre-token.

    Words of ASCII and of letters U+00C0 to U+00FF are cut here: runs of letters, single digits, runs of others.
    """
    kind, folded = _KINDS[data], data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    lead = data == 0xC3
    second = np.zeros_like(lead)
    second[1:] = lead[:-1]
    letter = second & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
    upper |= letter & (data < 0x9F)
    folded[upper] += 32
    kind[letter] = LETTER
    kind[:-1][letter[1:]] = LETTER
    heads = offsets[:-1]
    kind[np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))] = SLOW  # may start a special string
    slow = np.add.reduceat(kind == SLOW, heads) > 0 if len(heads) else np.zeros(0, bool)
    start = np.ones(len(data), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    start[heads] = True
    return slow, folded, np.flatnonzero(start)


class Cutter:
    """Cuts texts for one tokenizer file; ``specials`` maps special strings to ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.specials = {x["content"]: x["id"] for x in added}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._find = _pattern().findall

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order, normalised but not yet byte-mapped; special strings stand as themselves."""
        if self._special and "<|" in text:
            out: list[str] = []
            for i, part in enumerate(self._special.split(text)):
                out += [part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self._find(text.lower())
        if not text:
            return []
        clean = self.tokenizer.normalizer.normalize_str(text)
        return [clean[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]
