"""Whether a text stops where a sentence ends, by endings learned from texts themselves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache

from scoreloom.llm.phrases import bare as plain

#: Tokens of context; how often a context must have been seen to count.
CONTEXT, SEEN = 10, 4
#: Shares from which a text that is as long as a storage limit still counts as finished.
SURE_END, SURE_LAST = 0.9, 0.3
#: From so many occurrences on, the words before a word are known.
OFTEN = 30
#: Share of sentence ends from which a context counts as an end.
IS_END = 0.5
#: Below this share even a full stop after a number is no sentence end, but a cut number;
#: so it is if the context has that many tokens.
NO_END, NO_END_CONTEXT = 0.02, 3
#: Below this share of texts that finish with such a sentence, one without a stop was cut.
IS_LAST = 0.02

#: Characters at the end of a text in which dots after it are looked for.
DOTTED = 20

_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|\S")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_STOP = ".!?。！？।"
#: Marks that may follow a finished sentence.
_CLOSERS = "*_\"'`)]}»”’~ \t\r\n​﻿"
_TAIL_MARK = re.compile(r"(?:\s|[☀-➿⭐-⯿️\U0001f000-\U0001faff])+$")
_DOTS = re.compile(r"(?:\s*(?:\[\s*(?:\.{3,}|…)\s*\]|\(\s*(?:\.{3,}|…)\s*\)|\.{3,}|…))+\s*$")
#: Whole lines that may follow the last sentence: a rule, a formula, the end of a proof.
_REMARK = re.compile(r"\n\s*(?:[-*_=]{3,}|(?:\\\[|\$\$)?\s*\\boxed\{[^\n]*\}\s*(?:\\\]|\$\$)?|\(?(?:đpcm|dpcm|q\.?e\.?d\.?|hết|end)\.?\)?)\s*$", re.I)
_BULLET = re.compile(r"\n[ \t]*(?:[*#>+-]{1,2}|\d{1,2}[.)])\s*$|\s(?:\*{1,2}|\#{1,3})$")
_RECURRING = re.compile(r"\d[.,]\d*?(\d+)\1+$|\d[.,]\d{3,}$")


_plain = lru_cache(50_000)(plain)


def tokens(line: str) -> list[str]:
    """Lower-case tokens of one line: numbers as 0, names inside a sentence as one N."""
    out: list[str] = []
    for t in _TOKEN.findall(line):
        if t[0].isdigit():
            out.append("0")
        elif t[0].isupper() and out and out[-1] not in _STOP and t.lower() != t and len(t) > 1:
            if out[-1] != "N":
                out.append("N")
        else:
            out.append(_plain(t))
    return out


@lru_cache(50_000)
def _of_line(line: str) -> tuple[tuple[str, ...], str]:
    """Sentences of a line that a stop follows, and what none follows, as tokens with blanks between."""
    out, start = [], 0
    ts = tokens(line)
    for i, t in enumerate(ts):
        if t in _STOP:
            if i > start:
                out.append(" ".join(ts[start:i]))
            start = i + 1
    return tuple(out), " ".join(ts[start:])


def _sentences(text: str) -> Iterable[tuple[str, bool, bool]]:
    """(tokens, whether they end there, whether the text does too) of each sentence or line.

    What no stop and no line break follows may have been cut, as may what dots
    follow at the end of the text, so it is no ending.
    """
    out: list[tuple[str, bool, bool]] = []
    core = trimmed(text)
    # Numbers are one token each, so that lines that differ in them are read once.
    lines = _NUMBER.sub("0", core).split("\n")
    for n, line in enumerate(lines, 1):
        ended, rest = _of_line(line.strip().strip("*"))
        out += [(s, True, False) for s in ended]
        if rest:
            out.append((rest, n < len(lines), False))
    if out:
        s, ended, _ = out[-1]
        ended = ended and not (core[-1] in ".…])" and _DOTS.search(core[-DOTTED:]))
        out[-1] = s, ended, ended
    return out


def sentence_counts(texts: Iterable[str]) -> Counter[tuple[str, bool, bool]]:
    """How many times each of `_sentences` occurs in the texts."""
    return Counter(s for text in texts for s in _sentences(text))


def context_counts(sentences: Iterable[tuple[str, bool, bool, int]], counts: dict[str, list[int]] | None = None) -> dict[str, list[int]]:
    """For each context how often it was seen, a sentence ended after it, and the text did too; added to `counts`."""
    counts = {} if counts is None else counts
    for s, ended, finished, n in sentences:
        padded = ["^", *s.split(" ")]
        last = len(padded) - 1
        for i in range(1, last + ended):
            ctx = ""
            for k in range(i, max(-1, i - CONTEXT), -1):
                ctx = padded[k] + " " + ctx
                c = counts.get(ctx)
                if c is None:
                    c = counts[ctx] = [0, 0, 0]
                c[0] += n
                if i == last:
                    c[1] += n
                    c[2] += n * finished
    return counts


def is_decided(seen: int, ends: int, lasts: int) -> bool:
    """Whether no longer context can tell more than this one."""
    return ends == 0 or ends == seen and lasts in (0, ends)


def begun(line: str) -> str:
    """The line with a name in place of its last letter, which a single capital may have begun."""
    before, _, last = line.rpartition(" ")
    return f"{before} N".lstrip() if len(last) == 1 and last.isalpha() else line


def start_counts(sentences: Iterable[tuple[str, int]], lines: set[str]) -> Counter[str]:
    """How many sentences begin as each of the lines does, the whole line and the beginning of a word included."""
    sizes = sorted({len(x) for x in lines})
    out: Counter[str] = Counter()
    for s, n in sentences:
        for k in sizes:
            if k > len(s):
                break
            if s[:k] in lines:
                out[s[:k]] += n
    return out


def trimmed(text: str) -> str:
    """The text without white space and remarks after its last sentence."""
    core = text.rstrip(" \t\r\n\u200b\ufeff")
    while (m := _REMARK.search(core)) and m.start():
        core = core[: m.start()].rstrip()
    return core


class EndingModel:
    """For each context of up to CONTEXT tokens, how often a sentence ended after it."""

    def __init__(self, known: dict[str, tuple[int, int, int]], last_lines: frozenset[str]):
        self.known, self.last_lines = known, last_lines

    @classmethod
    def fit(cls, texts: Iterable[str]) -> EndingModel:
        """The model of texts that fit in memory; equal ones count once."""
        # Sentences are counted before their contexts are, as many texts share them.
        sentences = sentence_counts(dict.fromkeys(texts))
        counts = context_counts((*s, n) for s, n in sentences.items())
        known = {}
        for ctx, c in counts.items():
            # A longer context is kept only where the shorter one is undecided.
            shorter = ctx.split(" ", 1)[1]
            if c[0] >= SEEN and not (shorter and is_decided(*counts[shorter])):
                known[ctx] = (c[1], c[0], c[2])
        whole, finals = Counter(), Counter()
        for (s, ended, _), n in sentences.items():
            whole[s] += n
            finals[s] += 0 if ended else n
        lines = cls.candidates((x for x, n in finals.items() if n >= 2 * SEEN), known)
        starts = start_counts(whole.items(), lines | {begun(x) for x in lines})
        return cls(known, cls.usual({x: whole[x] for x in lines}, starts))

    @staticmethod
    def candidates(lines: Iterable[str], known: dict[str, tuple[int, int, int]]) -> set[str]:
        """The lines whose last word is a known one."""
        return {x for x in lines if x.rsplit(" ", 1)[-1] + " " in known}

    @staticmethod
    def usual(whole: dict[str, int], starts: dict[str, int]) -> frozenset[str]:
        """Lines that many texts have at their very end, such as a closing remark of whole words.

        However many texts were cut at one place, most that begin so go on. A number
        alone is a result, however many lines begin with one.
        """
        return frozenset(x for x, n in whole.items() if x == "0" or n >= IS_END * (starts[x] + (starts.get(begun(x), 0) if begun(x) != x else 0)))

    def end_share(self, text: str) -> tuple[float, float, int] | None:
        """How often sentences end where this text does, how often texts end with
        such a sentence, and the tokens of context that say so; None if the last
        word is unknown."""
        line = text.rstrip().rsplit("\n", 1)[-1].strip().strip("*")
        ts = tokens(line)
        while ts and ts[-1] in _STOP:
            ts.pop()
        start = max((i + 1 for i, t in enumerate(ts) if t in _STOP), default=0)
        if " ".join(ts[start:]) in self.last_lines:
            return 1.0, 1.0, CONTEXT
        padded = ["^", *ts[start:]]
        if len(padded) == 1:
            return None
        share, last, depth, ctx = None, 1.0, 0, ""
        for k in range(len(padded) - 1, max(-1, len(padded) - 1 - CONTEXT), -1):
            ctx = padded[k] + " " + ctx
            if (e := self.known.get(ctx)) is None:
                break  # beyond a decided context nothing longer is kept
            share, depth = e[0] / e[1], depth + 1
            if e[0] >= SEEN:
                last = e[2] / e[0]
        return None if share is None else (share, last, depth)


_DELIMITER = re.compile(r"\\[\[\]()]|\*\*|```|\$\$|[()\[\]{}]")
#: Delimiters that close what they open; the others are closed by their counterpart, and of
#: brackets any closes any, as in half-open intervals.
_SAME = frozenset(("**", "```", "$$"))
_OPENING, _CLOSING = frozenset("([{") | {"\\[", "\\("}, frozenset(")]}") | {"\\]", "\\)"}


def open_delimiters(text: str) -> bool:
    """Whether a bracket, a formula, bold type or a code block is open at the end, by a stack of delimiters.

    A closing mark that nothing opened, as in `a)`, closes nothing; one that closes
    an outer delimiter closes those inside it.
    """
    stack: list[str] = []
    for d in _DELIMITER.findall(text):
        if d in _SAME:
            if d in stack:
                while stack.pop() != d:
                    pass
            else:
                stack.append(d)
        elif d in _OPENING:
            stack.append(d)
        elif d in _CLOSING:
            k = len(stack) - 1
            while k >= 0 and (stack[k] in _SAME or (len(stack[k]) != len(d))):
                k -= 1
            if k >= 0:
                del stack[k:]
    return bool(stack)


def is_cut(text: str, model: EndingModel, whole: str | None = None, limited: Callable[[str], bool] | None = None) -> bool:
    """Whether the text stops inside a word or a sentence, with or without dots after the cut.

    `limited` tells whether a text is as long as a storage limit of its source: such
    a text is cut unless it ends as finished ones surely do. Of other texts an open
    delimiter, and then the ending itself decides. `whole`, if given, is another
    wording of the same result: a last number that is only the beginning of the
    number there was cut, and one that is the same was not.
    """
    core = text.rstrip()
    if core[-1:] in (".", "!", "?") and core[-2:-1].isalpha():
        return False
    core = trimmed(core)
    if not core:
        return False
    dotted = False
    if core[-1] in ".…])" and (m := _DOTS.search(core)):
        before = core[: m.start()].rstrip()
        if _RECURRING.search(before) and m[0].strip() in ("...", "…"):
            return False  # a number that goes on
        core, dotted = before, True
    if _BULLET.search(core) or core.endswith("\ufffd"):
        return True  # a list item, bold type or a character that was begun
    bare = _TAIL_MARK.sub("", core).rstrip(_CLOSERS)
    if not bare:
        return False
    end = bare[-1]
    if limited and end not in _STOP and (limited(text) or dotted and limited(core)):
        found = model.end_share(bare)
        if found is None or found[0] < SURE_END or found[1] < SURE_LAST:
            return True
    if open_delimiters(core):
        return True
    if end in _STOP:
        # A full stop after digits may be a cut number.
        if end != "." or not bare[-2:-1].isdigit():
            return False
        found = model.end_share(bare)
        return found is not None and found[0] < NO_END and found[2] >= NO_END_CONTEXT
    if end in ":,;=+-×÷/<>≈(\\" or core[-1] in ":,;=+×÷≈(":
        return True
    found = model.end_share(bare)
    if found is None:
        ts = tokens(bare)
        if len(ts) <= 3 and "0" in ts:
            return False  # a bare result
        return any(c.isalpha() for c in bare[-3:])
    share, last, depth = found
    if depth == 1 and model.known[tokens(bare)[-1] + " "][1] >= OFTEN and len(bare.rsplit("\n", 1)[-1].split()) >= 2:
        return True  # a frequent word after one that it never follows: the beginning of another
    if share < IS_END or last < IS_LAST and depth >= 2:
        return True
    if whole and (n := re.search(r"\d+(?:[.,]\d+)*$", bare)):
        numbers = re.findall(r"\d+(?:[.,]\d+)*", whole)
        return n[0] not in numbers and any(x.startswith(n[0]) for x in numbers[-2:])
    return False
