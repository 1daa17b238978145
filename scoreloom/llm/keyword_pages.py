"""Pages of repeated keywords, links, hashtags or product offers instead of sentences."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import compress

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scoreloom.llm.suffix_automaton import SuffixAutomaton, covered
from scoreloom.session import spread

#: Words that hold clauses together, by language; texts without accents are compared without.
CLAUSE_WORDS = """
là và của cho với các những được không khi thì mà nếu nên vì để từ trong này đó rồi lại cùng cũng đã đang sẽ hãy bị
như theo mỗi vào ra trên dưới qua ta em mình hỏi bao nhiêu phải còn tất cả sau trước bằng đến hơn nhưng do đây từng
the of and is are was were to that a an with from this these it its each how if then than by at on as be has have
they their we what which when where after before but not find only instead
el los las una que por para con les des est une dans pour sur der die und das ist mit nicht dan yang untuk dengan dari
""".split()

#: A phrase is a keyword of its page if it has at most so many words, occurs so often, and makes up this share.
PHRASE_WORDS, PHRASE_COUNT, PHRASE_SHARE = 6, 6, 0.10
#: Share of a segment's words under keyword phrases, or of its characters under repeated substrings, from which it counts.
STUFFED, REPEATED = 0.35, 0.5
#: So many segments must say a keyword twice.
STUFFED_SEGMENTS = 3

_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"']+", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>.*?</a>", re.I | re.S)
_LINE = re.compile(r"\n|\r|<br\s*/?>|</(?:p|div|li|ul|ol|tr|h\d|td)>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_SENTENCE = re.compile(r"(?<=[.!?。！？…])\s+")
_CRUMB = re.compile(r"\s[>»›→|•·/]\s")
_HASHTAG = re.compile(r"(?<!\S)#\w+")
_PRICE = re.compile(r"\d[\d.,]*\s?(?:đ|₫|d|vnd|vnđ|usd|k)\b|[$€£]\s?\d", re.I)
_LISTMARK = re.compile(r"[,;|]")
#: Words, and the marks that lists of links, breadcrumbs, hashtags and offers are made of.
_TOKEN = re.compile(r"[^\W_]+|://|</?|[#/.>»›→|•·=&?@$€£-]")


def plain(text: str) -> str:
    """Lower case, accents composed, without invisible format characters."""
    out = text.lower()
    if not out.isascii():
        out = _FORMAT.sub("", unicodedata.normalize("NFC", out))
    return out


_FORMAT = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_MARKED = re.compile("[\u0103\u0111\u01a1\u01b0\u1ea0-\u1ef9]")
_CLAUSE = frozenset(CLAUSE_WORDS)
#: Words that make a clause only of what ends as a sentence.
_LIGHT = frozenset("có hay ở gì nào mấy số tìm tính co o gi nao may so tim tinh in for or".split())
_BARE = frozenset("".join(c for c in unicodedata.normalize("NFD", w.replace("đ", "d")) if not unicodedata.combining(c)) for w in CLAUSE_WORDS)
_BROKEN_MARKS = ("Ã", "áº", "á»", "Ä‘")


def mended(text: str) -> str:
    """The text, with UTF-8 that was read as a Western code page turned back where it can be."""
    if not any(m in text for m in _BROKEN_MARKS):
        return text
    raw = bytearray()
    for c in text:
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) < 256:
                raw.append(ord(c))
            else:
                raw += c.encode("utf-8") if c != "�" else b""
    back = raw.decode("utf-8", "ignore")
    return back if sum(map(back.count, _BROKEN_MARKS)) < sum(map(text.count, _BROKEN_MARKS)) else text


class Segment:
    """One line or sentence: its words, and what its form says; of what looks like a list also its tokens with the marks."""

    __slots__ = ("at", "clause", "numeric", "size", "tokens")

    def __init__(self, at: int, size: int, clause: bool, numeric: bool, tokens: list[str] | None = None):
        self.at, self.size, self.clause, self.numeric, self.tokens = at, size, clause, numeric, tokens

    @property
    def loose(self) -> bool:
        """Whether repeats may make it a list: there is no clause and no row of figures in it."""
        return self.tokens is not None or not (self.clause or self.numeric)


def segments(text: str) -> tuple[list[str], list[Segment], frozenset[str]]:
    """The page's words, its segments, and the words that hold its clauses together."""
    text = plain(text)
    glue_words = _CLAUSE if _MARKED.search(text) else _BARE
    words: list[str] = []
    found: list[Segment] = []

    def listed(part: str) -> None:
        tokens = _TOKEN.findall(part)
        own = [t for t in tokens if t[0].isalnum()]
        if own:
            found.append(Segment(len(words), len(own), False, False, tokens))
            words.extend(own)

    for line in _LINE.split(text):
        if not line or line.isspace():
            continue
        anchors = _ANCHOR.findall(line) if "<a" in line else ()
        if anchors:
            line = _TAG.sub(" ", _ANCHOR.sub(" ", line))
            listed(" ".join(anchors))
        elif "<" in line:
            line = _TAG.sub(" ", line)
        for part in _SENTENCE.split(line) if len(line) > 40 else (line,):
            if "://" in part or "www." in part:
                urls = _URL.findall(part)
                rest = _URL.sub(" ", part)
                if urls and len(_WORD.findall(rest)) <= 8 * len(urls):
                    listed(part)
                    continue
                listed(" ".join(urls))
                part = rest
            tokens = _WORD.findall(part)
            n = len(tokens)
            if not n:
                continue
            glue = len(glue_words.intersection(tokens))
            end = part.rstrip()[-1:]
            stop = end in ".!?;:,。…\")"
            if not glue and end in ".!?":
                glue = len(_LIGHT.intersection(tokens))
            clause = n >= 4 and (glue >= 2 and glue * 12 >= n or glue >= 1 and stop and glue * 20 >= n)
            numeric = not clause and 2 * sum(t.isdigit() or len(t) == 1 for t in tokens) >= n
            form = "#" in part and (tags := _HASHTAG.findall(part)) and 2 * len(tags) >= len(part.split())
            if not form and not (clause and stop):
                crumbs = len(_CRUMB.findall(part))
                if crumbs >= 2 and n <= 7 * (crumbs + 1) and not numeric and (glue * 5 < n or end not in ".!?"):
                    form = True
                elif end not in ".!?" and part.count(" - ") + part.count("|") >= 2 and _PRICE.search(part):
                    form = True
            if form:
                listed(part)
                continue
            if clause and n >= 8 and part.count(",") + part.count("|") + part.count(";") >= 4:
                pieces = [p.split() for p in _LISTMARK.split(part)]
                short = sum(len(p) <= 8 for p in pieces)
                if short >= 0.9 * len(pieces) and glue * 12 < n:
                    clause = False
            found.append(Segment(len(words), n, clause, numeric))
            words += tokens
    return words, found, glue_words


def _sequence(words: list[str], parts: list[Segment]) -> tuple[list[str], Sequence[int], list[int]]:
    """The page as symbols, the word of each symbol (-1 for a mark), and after which symbols a block ends.

    Segments of a list's form hold their marks as well, and words that the page has
    once are only words (W) or figures (0) there, so that lists of different links
    repeat their form. Sentences are blocks of their own.
    """
    if all(s.tokens is None for s in parts):
        loose = [s.loose for s in parts]
        return words, range(len(words)), [s.at for k, s in enumerate(parts) if k and not (loose[k] and loose[k - 1])]
    count = Counter(words)
    symbols: list[str] = []
    place: list[int] = []
    ends: list[int] = []
    for s in parts:
        if ends and not s.loose and ends[-1] != len(symbols):
            ends.append(len(symbols))
        if s.tokens is None:
            symbols += words[s.at : s.at + s.size]
            place += range(s.at, s.at + s.size)
        else:
            k = s.at
            for t in s.tokens:
                if t[0].isalnum():
                    symbols.append(t if count[t] > 1 else "0" if t.isdigit() else "W")
                    place.append(k)
                    k += 1
                else:
                    symbols.append(t)
                    place.append(-1)
        if not s.loose:
            ends.append(len(symbols))
        elif not ends:
            ends.append(0)
    return symbols, place, ends


def _repeats(words: list[str], parts: list[Segment], glue_words: frozenset[str]) -> tuple[list[bool], list[bool]]:
    """Which words stand in a repeated substring of two symbols or more, and which in a keyword phrase of the page.

    The automaton is built of the pairs that can matter: those that occur twice
    and once outside of sentences, and those as frequent as a keyword phrase. All
    pairs of a substring that counts are such pairs, so what lies between them is
    replaced by marks that occur once, without changing any result.
    """
    symbols, place, ends = _sequence(words, parts)
    pairs: list = list(zip(symbols, symbols[1:]))
    for e in ends:
        if 0 < e < len(symbols):
            pairs[e - 1] = None
    count = Counter(pairs)
    count[None] = 0
    # Without a frequent pair of words that hold no clauses together there is no keyword at all.
    phrases = any(n >= 2 * STUFFED_SEGMENTS and not glue_words.intersection(p) for p, n in count.items())
    least = max(PHRASE_COUNT, PHRASE_SHARE * len(words) / PHRASE_WORDS)
    wanted = {p for p, n in count.items() if n >= least} if phrases else set()
    at = 0
    for s in parts:
        size = s.size if s.tokens is None else len(s.tokens)
        if s.loose:
            wanted.update(p for p in pairs[at : at + size] if count[p] > 1)
        at += size
    none = [False] * len(words)
    if not wanted:
        return none, none
    compact: list = []
    source: list[int] = []
    last = -1
    for i, p in enumerate(pairs):
        if p in wanted:
            if last != i:
                compact += (-i - 1, symbols[i])
                source += (-1, place[i])
            last = i + 1
            compact.append(symbols[last])
            source.append(place[last])
    automaton = SuffixAutomaton(compact)

    def under(marked: list[bool]) -> list[bool]:
        out = [False] * (len(words) + 1)
        for i in compress(source, marked):
            out[i] = True  # the last place takes the marks
        out.pop()
        return out

    return under(covered(automaton.repeats(), 2)), under(_under_phrases(automaton, len(words))) if phrases else none


def keyword_share(text: str) -> float:
    """Share of a page's words in keyword runs, lists of links, hashtags or offers.

    A segment without clause structure counts when repeated maximal substrings of
    the page cover half of its characters; lists of links, breadcrumbs, hashtags and
    offers are such segments, whose marks repeat as well. Any segment counts when
    phrases that fill the page cover it. Figures and single letters, as in
    multiplication tables and answer keys, never count as keywords.
    """
    if not text or text.isspace():
        return 0.0
    text = mended(text)
    if "&" in text:
        text = html.unescape(text)
    words, parts, glue_words = segments(text)
    total = len(words)
    if total < 5:
        return 0.0
    repeated, phrases = _repeats(words, parts, glue_words)
    stuffed = _stuffed(words, parts, phrases, glue_words) if any(phrases) else [False] * len(parts)
    spam = 0
    for s, full in zip(parts, stuffed):
        if s.loose:
            span = slice(s.at, s.at + s.size)
            if True in repeated[span] and sum(map(len, compress(words[span], repeated[span]))) >= REPEATED * sum(map(len, words[span])):
                spam += s.size
                continue
        if full and (s.tokens is not None or not s.numeric):
            spam += s.size
    return spam / total


def _stuffed(words: list[str], parts: list[Segment], under: list[bool], glue_words: frozenset[str]) -> list[bool]:
    """Which segments are there for a keyword of the page.

    A keyword is a pair of words, none of them one that holds clauses together,
    that single segments say twice, at least STUFFED_SEGMENTS of them. Segments
    with such a pair count if keyword phrases make up the share STUFFED of them;
    a sentence with two numbers, as in exercises, doesn't.
    """
    free = [u and w not in glue_words for w, u in zip(words, under)]
    held: list[set[tuple[str, str]]] = []
    twice: Counter[tuple[str, str]] = Counter()
    for s in parts:
        pairs = Counter((words[i], words[i + 1]) for i in range(s.at, s.at + s.size - 1) if free[i] and free[i + 1])
        held.append(set(pairs))
        twice.update(p for p, n in pairs.items() if n > 1)
    keys = {p for p, n in twice.items() if n >= STUFFED_SEGMENTS}
    return [
        bool(h & keys)
        and sum(free[s.at : s.at + s.size]) >= STUFFED * s.size
        and len({w for w in words[s.at : s.at + s.size] if w.isdigit()}) < 2
        for s, h in zip(parts, held)
    ]


def _under_phrases(automaton: SuffixAutomaton, total: int) -> list[bool]:
    """Which symbols stand in a phrase that is a keyword of a page of so many words."""
    count, length, link = automaton.counts(), automaton.length, automaton.link
    best = [0] * len(count)
    for v in sorted(range(1, len(count)), key=length.__getitem__):
        best[v] = best[link[v]]
        size = min(length[v], PHRASE_WORDS)
        if size >= 2 and size > length[link[v]] and count[v] >= PHRASE_COUNT and count[v] * size >= PHRASE_SHARE * total:
            best[v] = size
    return covered([best[v] for v in automaton.ends], 2)


def keyword_pages(df: DataFrame, id_col: str, text_col: str, over: float = 0.5, out_id: str = "doc_id") -> DataFrame:
    """Pages whose keyword share is above `over`: their id and `keyword_share`.

    One pass (a table of fewer parts than cores is spread first); each page is measured whole and on its own. Null,
    empty and blank texts, and those of fewer than five words, have a share of 0.
    Repeated pages come out each; an empty table gives no row.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            shares = [keyword_share(t) if t else 0.0 for t in batch.column(1).to_pylist()]
            hit = [i for i, s in enumerate(shares) if s > over]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(hit, pa.int64())), pa.array([shares[i] for i in hit], pa.float64())],
                [out_id, "keyword_share"],
            )

    schema = T.StructType([T.StructField(out_id, df.schema[id_col].dataType), T.StructField("keyword_share", T.DoubleType())])
    return spread(df.select(f"`{id_col}`", f"`{text_col}`")).mapInArrow(run, schema)
