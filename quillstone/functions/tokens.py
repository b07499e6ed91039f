"""The token estimate of whole texts inside a Python task: one table of kinds over the basic plane, runs found by differences."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from functools import cache

import numpy as np

from . import fixed

SYMBOL, LETTER, ARABIC, DIGIT, CJK, BLANK, ASTRAL, NUMERAL = range(8)


def _kind(c: int) -> int:
    if 0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7AF or 0xF900 <= c <= 0xFAFF:
        return CJK
    if c in (9, 10, 13, 32, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) or 0x2000 <= c <= 0x200A:
        return BLANK
    letter = unicodedata.category(chr(c))[0] in "LM"
    if 0x750 <= c <= 0x77F or 0xFB50 <= c <= 0xFEFF or (0x600 <= c <= 0x6FF and letter):
        return ARABIC
    if 48 <= c <= 57:
        return DIGIT
    return LETTER if letter else NUMERAL if 0x660 <= c <= 0x669 or 0x6F0 <= c <= 0x6F9 else SYMBOL


@cache
def _kinds() -> np.ndarray:
    return np.array([_kind(c) if not 0xD800 <= c <= 0xDFFF else SYMBOL for c in range(0x10000)], np.uint8)


#: What a character of each kind costs, and the kinds whose runs are at least a token each.
_EACH = np.array([fixed.SYMBOL, fixed.LETTER, fixed.ARABIC, fixed.DIGIT, fixed.CJK, fixed.BLANK, fixed.ASTRAL, fixed.SYMBOL], np.int64)
_WHOLE = np.array([False, True, True, True, False, False, False, False])


def _runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs of a kind, their kinds and hundredths; a symbol after a blank costs more."""
    if text.isascii():
        kind = _kinds()[np.frombuffer(text.encode(), np.uint8)]
    else:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[c] if c.max() < 0x10000 else np.where(c < 0x10000, _kinds()[np.minimum(c, 0xFFFF)], np.where((c >= 0x20000) & (c <= 0x2FA1F), CJK, ASTRAL)).astype(np.uint8)
    first = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))
    of = kind[first]
    cost = np.concatenate((first[1:], [len(kind)]))
    cost -= first
    cost *= _EACH[of]
    np.maximum(cost, 100, out=cost, where=_WHOLE[of])
    cost[1:] += ((of[1:] == SYMBOL) & (of[:-1] == BLANK)) * (fixed.SYMBOL - fixed.BLANK)
    return first, of, cost


def hundredths(text: str, after_blank: bool = False) -> int:
    """Hundredths of a token: runs of letters and digits, at least a token each, and single characters of other kinds. after_blank: a blank stands before the text."""
    return int(_runs(text)[2].sum()) + (lead(text) if after_blank else 0) if text else 0


class Counted:
    """A text whose stretches' hundredths are told without reading it again: sums over the runs before, and the parts of the first and last."""

    __slots__ = ("first", "length", "of", "upto")

    def __init__(self, text: str):
        self.length = len(text)
        first, of, cost = _runs(text) if text else (np.zeros(0, np.int64),) * 3
        self.first, self.of, self.upto = first.tolist(), of.tolist(), [0, *np.cumsum(cost).tolist()]

    def hundredths(self, a: int, b: int) -> int:
        if a >= b:
            return 0
        if a == 0 and b == self.length:
            return self.upto[-1]
        i, j = bisect_right(self.first, a) - 1, bisect_right(self.first, b - 1) - 1
        part = lambda k, n: max(100, n * _COST[k]) if k in (LETTER, ARABIC, DIGIT) else n * _COST[k]
        if i == j:
            return part(self.of[i], b - a)
        set_off = fixed.SYMBOL - fixed.BLANK if self.of[j] == SYMBOL and self.of[j - 1] == BLANK else 0
        return part(self.of[i], self.first[i + 1] - a) + self.upto[j] - self.upto[i + 1] + part(self.of[j], b - self.first[j]) + set_off


_COST = _EACH.tolist()


def blank(text: str) -> bool:
    """Whether a text is all of blanks, one at least."""
    return bool(text) and all(ord(c) < 0x10000 and _kinds()[ord(c)] == BLANK for c in text)


def lead(text: str) -> int:
    """What a blank before the text adds to its hundredths."""
    c = ord(text[0]) if text else 0xFFFF
    return fixed.SYMBOL - fixed.BLANK if text and c < 0x10000 and _kinds()[c] == SYMBOL else 0


def estimate(text: str) -> int:
    return -(-hundredths(text) // 100)
