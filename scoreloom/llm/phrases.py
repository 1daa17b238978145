"""Multi-pattern search for fixed phrases, in texts with or without accents."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import ahocorasick


def bare(text: str) -> str:
    """Lower case without accents."""
    out = unicodedata.normalize("NFD", text.lower().replace("đ", "d"))
    return "".join(c for c in out if not unicodedata.combining(c))


def automaton(groups: dict[str, Iterable[str]], make: bool = True) -> ahocorasick.Automaton:
    """Automaton over lower-case text; a match gives the kinds of its phrase, each with its length.

    Every phrase is found as written and, if it has accents, without them too.
    With `make` off, more phrases may be added before it is made.
    """
    a = ahocorasick.Automaton()
    for kind, phrases in groups.items():
        for p in phrases:
            low = unicodedata.normalize("NFC", p.lower())
            for form in {low, bare(low)} if bare(low).isascii() else {low}:
                a.add_word(form, (*a.get(form, ()), (kind, len(form))))
    if make:
        a.make_automaton()
    return a


def whole_word(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither begins nor ends inside a word."""
    before, after = text[start - 1 : start], text[end : end + 1]
    return not (before.isalnum() and text[start].isalnum()) and not (after.isalnum() and text[end - 1].isalnum())


def spans(a: ahocorasick.Automaton, text: str) -> dict[str, list[tuple[int, int]]]:
    """Where the phrases of each kind stand in a lower-case text."""
    out: dict[str, list[tuple[int, int]]] = {}
    for last, kinds in a.iter(text):
        for kind, n in kinds:
            start, end = last + 1 - n, last + 1
            if whole_word(text, start, end):
                out.setdefault(kind, []).append((start, end))
    return out


def coverage(found: Iterable[tuple[int, int]]) -> int:
    """Characters under the union of the spans."""
    total = reach = 0
    for start, end in sorted(found):
        if end > reach:
            total += end - max(start, reach)
            reach = end
    return total
