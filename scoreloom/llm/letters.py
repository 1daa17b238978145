"""Code-point tables that reduce texts to comparable words, for whole batches at once."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Results of the table besides a code point: between words, and dropped.
BREAK, DROP = 0, 1
#: Code points from here on hold only ideographs, tags and variation selectors.
_TOP = 0x30000
_TABLE: np.ndarray | None = None


def plain_char(ch: str) -> int:
    """What one character becomes: a lower-case base letter, BREAK or DROP."""
    if unicodedata.category(ch) in ("Cf", "Mn"):
        return DROP
    low = unicodedata.normalize("NFD", ch.lower())
    base = [c for c in low if unicodedata.category(c) != "Mn"]
    if not base:
        return DROP
    if len(base) > 1:  # a letter that isn't an accented one, such as a Hangul syllable
        base = [ch.lower()[0]]
    c = base[0]
    if c == "đ":
        return ord("d")
    return ord(c) if c.isalnum() else BREAK


def table() -> np.ndarray:
    """For every code point below _TOP what it becomes; made once a worker."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(_TOP + 1, np.uint32)
        for i in range(_TOP):
            if not 0xD800 <= i < 0xE000:
                t[i] = plain_char(chr(i))
        _TABLE = t
    return _TABLE


def plain_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as one array of code points, and where each text ends.

    Words are the runs of letters and digits without accents, case and invisible
    format characters. One blank (32) stands before and after every word; a text
    without words is a single blank.
    """
    raw = np.frombuffer("\n".join(t.replace("\n", " ") for t in texts).encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(raw == 10)
    codes = table()[np.minimum(raw, _TOP)]
    high = raw >= _TOP
    if high.any():
        codes[high] = [plain_char(chr(c)) for c in raw[high].tolist()]
    codes[ends] = 10
    codes = codes[codes != DROP]
    # A text's end counts as white space of its own, 10; runs of breaks become one blank.
    gap = codes == BREAK
    gap[1:] &= ~(gap[:-1] | (codes[:-1] == 10))
    if len(gap):
        gap[0] = False
    keep = (codes != BREAK) | gap
    codes = codes[keep]
    codes[codes == BREAK] = 32
    # No blank at a text's end; the mark itself then serves as one.
    tail = np.flatnonzero((codes[:-1] == 32) & (codes[1:] == 10)) if len(codes) > 1 else np.array([], np.int64)
    if len(codes) and codes[-1] == 32:
        tail = np.append(tail, len(codes) - 1)
    codes = np.delete(codes, tail)
    framed = np.empty(len(codes) + 2, np.uint32)
    framed[0] = framed[-1] = 10
    framed[1:-1] = codes
    return framed, np.flatnonzero(framed == 10)
