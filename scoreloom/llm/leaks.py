"""Evaluation passages inside corpus documents, by q-gram lemma filtering.

A passage of n characters that occurs with at most e edits shares at least
n - q + 1 - q * e of its q-grams with the place where it occurs, all on nearby
diagonals. Shared q-grams are counted in overlapping bands of diagonals; the
regions that meet that count are aligned within their band.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scoreloom.llm.letters import plain_codes
from scoreloom.session import spread

#: Characters of items that one pass holds; more items are searched in blocks.
BLOCK_CHARS = 8_000_000
#: Bits of the table that rejects most q-grams of a document at once.
FILTER_BITS = 22
#: Shared q-grams that are held at once; frequent ones are compared in parts of so many.
PART = 2_000_000
#: What stands between blanks and holds a word.
_HELD = re.compile(r"\S*[^\W_]\S*")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q code points from each position on; q is a power of two."""
    with np.errstate(over="ignore"):
        h, step, factor = codes.astype(np.uint64) + np.uint64(1), 1, _PRIME
        while step < q:
            h = h[:-step] * factor + h[step:]
            factor = factor * factor
            step *= 2
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(32))


class ItemIndex:
    """The words and q-grams of one block of items."""

    def __init__(self, ids: list, texts: list[str], min_words: int, edits: int):
        self.ids, self.min_words, self.edits = ids, min_words, edits
        #: The first of the neighbouring texts that have the same id, as the pieces of one item have.
        self.first = list(range(len(ids)))
        for k in range(1, len(ids)):
            if ids[k] == ids[k - 1]:
                self.first[k] = self.first[k - 1]
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.codes, marks = plain_codes(texts)
        self.start, self.end = marks[:-1], marks[1:]  # each text lies between two marks
        breaks = np.flatnonzero((self.codes == 32) | (self.codes == 10))
        # The end mark of an item bounds its last word as well.
        spans = np.array([], np.int64)
        if len(breaks) > min_words:
            a, b = breaks[:-min_words], breaks[min_words:]
            inside = np.searchsorted(marks, a, "right") == np.searchsorted(marks, b, "left")
            spans, owner = (b - a - 1)[inside], np.searchsorted(marks, a, "right")[inside] - 1
        self.shortest = int(spans.min()) if len(spans) else 0
        self.q = 2
        while self.q < 16 and self.shortest + 1 - 2 * self.q * (1 + edits) > 0:
            self.q *= 2
        self.needed = max(1, self.shortest + 1 - self.q * (1 + edits))
        #: For each item, how many q-grams its shortest run of min_words words shares with any place where it occurs.
        self.needed_of = np.full(len(ids), np.iinfo(np.int64).max)
        if len(spans):
            np.minimum.at(self.needed_of, owner, np.maximum(1, spans + 1 - self.q * (1 + edits)))
        if not self.shortest:
            self.hashes = np.array([], np.uint64)
            return
        h = qgram_hashes(self.codes, self.q)
        at = np.arange(len(h))
        whole = np.searchsorted(marks, at, "left") == np.searchsorted(marks, at + self.q - 1, "right")
        at = at[whole]
        order = np.argsort(h[at], kind="stable")
        self.at, self.hashes = at[order], h[at][order]
        #: The longest run of min_words words, with its edits; shared q-grams farther apart belong to different runs.
        self.longest = int(spans.max()) + edits
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in the documents that share a q-gram with an item, and the slice of the index that holds it."""
        none = np.array([], np.int64)
        if not len(self.hashes) or len(codes) < self.q:
            return none, none, none
        h = qgram_hashes(codes, self.q)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
        h = h[at]
        low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        some = high > low
        return at[some], low[some], high[some]

    def parts(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in the documents and in the items that share a q-gram, in parts of about PART pairs.

        Positions are counted before they are paired: a stretch of a document in
        which fewer than the needed number share a q-gram can hold no passage,
        and goes. Stretches are kept whole; one with more pairs than a part holds,
        as of a phrase that thousands of items share, is paired with the items bit
        by bit, each with whole items.
        """
        at, low, high = self.hits(codes)
        if not len(at):
            return
        first = np.flatnonzero(np.r_[True, np.diff(at) > (self.longest if self.edits else 1)])
        size = np.diff(np.r_[first, len(at)])
        n = high - low
        pairs = np.add.reduceat(n, first)
        enough = size >= self.needed
        part = (np.cumsum(np.where(enough, pairs, 0)) - 1) // PART
        for k in np.unique(part[enough]):
            chosen = np.flatnonzero(enough & (part == k))
            rows = np.concatenate([np.arange(first[c], first[c] + size[c]) for c in chosen])
            blocks = -(-int(n[rows].sum()) // PART)
            if blocks <= 1:
                yield self._paired(at[rows], low[rows], high[rows])
                continue
            # Within equal q-grams the index is in the order of positions, so each block of items is a slice.
            key = self.hashes[low[rows]]
            edges = self.start[np.linspace(0, len(self.start), min(len(self.start), blocks) + 1).astype(np.int64)[1:-1]]
            begin = low[rows]
            for edge in (*edges.tolist(), None):
                stop = high[rows] if edge is None else self._until(key, begin, high[rows], edge)
                some = stop > begin
                if some.any():
                    yield self._paired(at[rows][some], begin[some], stop[some])
                begin = stop

    def _until(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, edge: int) -> np.ndarray:
        """For each slice of the index, where the positions from `edge` on begin, by bisection."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            less = open_ & (self.at[np.minimum(mid, len(self.at) - 1)] < edge)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low

    def _paired(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = high - low
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.at[np.repeat(low, n) + step]

    def regions(self, codes: np.ndarray, marks: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, item, diagonal and position of the shared q-grams in bands that have enough of them.

        Bands overlap by half. q-grams that repeat in the item or the document
        only raise a band's count, so no region is lost.
        """
        doc = np.searchsorted(marks, doc_at, "right") - 1
        item = np.searchsorted(self.start, item_at, "right") - 1
        diagonal = doc_at - item_at + len(self.codes)
        width = 2 * max(1, self.edits)
        pair = (doc * len(self.ids) + item) * (len(codes) + 2 * len(self.codes) + 2 * width)
        kept = np.zeros(len(doc_at), bool)
        for shift in (0, width // 2):
            bands, band, count = np.unique(pair + (diagonal + shift) // width, return_inverse=True, return_counts=True)
            some = np.flatnonzero(count[band] >= self.needed_of[item])
            if self.edits and len(some):
                some = some[self._dense(band[some], item[some], item_at[some])]
            kept[some] = True
        return doc[kept], item[kept], diagonal[kept] - len(self.codes), doc_at[kept]

    def _dense(self, band: np.ndarray, item: np.ndarray, item_at: np.ndarray) -> np.ndarray:
        """Which shared q-grams of a band lie close enough together: as many as an item's shortest run needs, within its length.

        A longer run misses no more q-grams by its edits than the shortest, so every
        stretch of it that is as long as the shortest holds enough of them.
        """
        order = np.lexsort((item_at, band))
        band, item, item_at = band[order], item[order], item_at[order]
        need = self.needed_of[item]
        last = np.arange(len(order)) + need - 1
        inside = np.minimum(last, len(order) - 1)
        # The shortest run has need - 1 + q * (1 + edits) characters, q - 1 of them after its last q-gram.
        close = (last < len(order)) & (band[inside] == band) & (item_at[inside] - item_at <= need - 1 + self.q * self.edits)
        edges = np.zeros(len(order) + 1, np.int64)
        np.add.at(edges, np.flatnonzero(close), 1)
        np.add.at(edges, last[close] + 1, -1)
        out = np.zeros(len(order), bool)
        out[order] = np.cumsum(edges[:-1]) > 0
        return out

    def _aligned(self, codes: np.ndarray, doc, item, diagonal, at) -> set[tuple[int, int]]:
        """Pairs with min_words words in a row that agree character by character on one diagonal."""
        order = np.lexsort((at, diagonal, item, doc))
        doc, item, diagonal, at = doc[order], item[order], diagonal[order], at[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        long = at[last] - at[first] + self.q >= self.shortest
        first, last = first[long], last[long]
        a, z = at[first], at[last] + self.q  # the agreeing characters are [a, z)
        shift = diagonal[first]
        gap, item_gap = codes <= 32, self.codes <= 32
        a -= gap[a - 1] & item_gap[a - shift - 1]
        z += gap[z] & item_gap[z - shift]
        edges = np.r_[0, np.cumsum(gap)]
        enough = edges[z] - edges[a] > self.min_words
        out = set()
        for d, i, lo, hi, s in zip(*(x[enough].tolist() for x in (doc[first], item[first], a, z, shift))):
            x, y = codes[lo:hi], self.codes[lo - s : hi - s]
            if (d, i) not in out and ((x == y) | ((x <= 32) & (y <= 32))).all():
                out.add((d, i))
        return out

    def _windows(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of min_words words of an item begin and end."""
        kept = self.windows.get(item)
        if kept is None:
            text_at, text_end = int(self.start[item]), int(self.end[item])
            edge = text_at + np.flatnonzero(self.codes[text_at : text_end + 1] <= 32)
            kept = self.windows[item] = (edge[: -self.min_words] + 1, edge[self.min_words :])
        return kept

    def _aligned_with_edits(self, codes: np.ndarray, bounds: tuple[int, int], item: int, diagonal: np.ndarray, at: np.ndarray) -> bool:
        """Banded edit distance of the item's windows of min_words words, against the document along a region's shared q-grams.

        Only windows that share as many q-grams as their length and edits ask for are
        aligned, each with the stretch of the document that its band spans.
        """
        text_at, text_end = int(self.start[item]), int(self.end[item])
        starts, stops = self._windows(item)
        shared = np.zeros(text_end - text_at + 2, np.int64)
        shared[at - diagonal - text_at + 1] = 1
        shared = np.cumsum(shared)
        held = shared[np.maximum(stops - self.q + 1, starts) - text_at] - shared[starts - text_at]
        near = np.flatnonzero(held >= stops - starts + 1 - self.q * (1 + self.edits))
        if not len(near):
            return False
        low, high = int(diagonal.min()), int(diagonal.max())
        # The windows that share most are tried first.
        for k in near[np.argsort((stops - starts - held)[near], kind="stable")].tolist():
            a, z = int(starts[k]), int(stops[k])
            text = codes[max(bounds[0] + 1, a + low - self.edits) : min(bounds[1], z + high + self.edits)]
            if occurs(self.codes[a:z].tolist(), text.tolist(), self.edits):
                return True
        return False

    def found(self, codes: np.ndarray, marks: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that the alignment confirms."""
        out: set[tuple[int, int]] = set()
        for doc_at, item_at in self.parts(codes):
            doc, item, diagonal, at = self.regions(codes, marks, doc_at, item_at)
            if not len(doc):
                continue
            exact = self._aligned(codes, doc, item, diagonal, at)
            out |= exact
            if not self.edits:
                continue
            # Regions of one pair: neighbouring diagonals and positions.
            order = np.lexsort((at, item, doc))
            doc, item, diagonal, at = doc[order], item[order], diagonal[order], at[order]
            cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(at) > self.longest)])
            last = np.r_[cut[1:], len(at)]
            for b, e in zip(cut.tolist(), last.tolist()):
                d, i = int(doc[b]), int(item[b])
                if (d, i) in out:
                    continue
                bounds = (int(marks[d]), int(marks[d + 1]))
                own, where = diagonal[b:e], at[b:e]
                groups = [slice(None)]
                if own.max() - own.min() > 8 * (self.edits + 1):  # a text that repeats itself: band by band
                    by = np.argsort(own, kind="stable")
                    groups = np.split(by, np.flatnonzero(np.diff(own[by]) > 2 * self.edits) + 1)
                if any(self._aligned_with_edits(codes, bounds, i, own[g], where[g]) for g in groups):
                    out.add((d, i))
        return out


def occurs(want: list[int], text: list[int], edits: int) -> bool:
    """Whether `want` occurs somewhere in `text` with at most so many edits: one column of the alignment a character, as bits of two numbers."""
    mask, high = (1 << len(want)) - 1, 1 << (len(want) - 1)
    at: dict[int, int] = {}
    for k, c in enumerate(want):
        at[c] = at.get(c, 0) | 1 << k
    up, down, score = mask, 0, len(want)  # where the column rises and falls, and its last value
    for c in text:
        same = at.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rises, falls = down | ~(across | up) & mask, up & across
        if rises & high:
            score += 1
        elif falls & high:
            score -= 1
        # The first row stays 0, as an occurrence may begin anywhere.
        rises, falls = rises << 1 & mask, falls << 1 & mask
        fresh = same | down
        up, down = falls | ~(fresh | rises) & mask, rises & fresh
        if score <= edits:
            return True
    return score <= edits


def find_leaks(
    corpus: DataFrame,
    items: DataFrame,
    doc_id: str,
    doc_text: str,
    item_id: str,
    item_text: str,
    min_words: int = 12,
    edits: int = 0,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row (doc_id, item_id) for each document that leaks an item.

    A document leaks an item if it holds a run of at least `min_words`
    consecutive words of it, up to `edits` character edits. Words are the runs of
    letters and digits left after dropping invisible format characters, accents
    and case. The items are the held-out side: they are read to the driver in
    blocks of about `block_chars` characters (a longer item in pieces that share
    their words at the ends) and each block goes over the corpus in one pass; the
    corpus itself never leaves its partitions (one of fewer parts than cores is
    spread first), and documents of any length are searched whole.

    Null, empty and blank texts hold no words and leak nothing; items of fewer
    than `min_words` words can't leak; repeated documents come out each (but those
    of one id once where an item lies in several blocks), a repeated item under each
    of its ids; empty tables give an empty result.
    """
    schema = T.StructType(
        [T.StructField("doc_id", corpus.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType)]
    )
    docs = spread(corpus.select(f"`{doc_id}`", f"`{doc_text}`"))
    spark = corpus.sparkSession
    out, last, shared = None, None, False
    for ids, texts in _blocks(items, item_id, item_text, block_chars, min_words):
        shared |= last is not None and ids[0] == last
        last = ids[-1]
        block = spark.sparkContext.broadcast((ids, texts))
        part = docs.mapInArrow(_searcher(block, min_words, edits, to_arrow_type(schema["item_id"].dataType)), schema)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.distinct() if shared else out


def _pieces(text: str, size: int, min_words: int) -> Iterator[str]:
    """A text in pieces of at least `size` characters; each begins with the last min_words words of the one before, so that none is cut."""
    at = 0
    while len(text) - at > size:
        end, own = at, []
        while end < len(text) and len(own) <= min_words:
            end = min(len(text), end + size)
            while end < len(text) and not text[end].isspace():
                end += 1
            own = [m.start() for m in _HELD.finditer(text, at, end)]
        yield text[at:end]
        if end == len(text):
            return
        at = own[-min_words]
    yield text[at:]


def _blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int, min_words: int) -> Iterator[tuple[list, list[str]]]:
    ids: list = []
    texts: list[str] = []
    held = 0
    rows = items.select(f"`{item_id}`", f"`{item_text}`").where(f"`{item_text}` IS NOT NULL")
    for i, whole in rows.toLocalIterator():
        for t in _pieces(whole, block_chars, min_words):
            if ids and held + len(t) > block_chars:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
    if ids:
        yield ids, texts


def _searcher(block, min_words: int, edits: int, item_type):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        index = None
        for batch in batches:
            if index is None:
                index = ItemIndex(*block.value, min_words, edits)
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                # So many texts at once as have about a million characters.
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= 1_000_000):
                    size += len(texts[end] or "")
                    end += 1
                codes, marks = plain_codes([t or "" for t in texts[at:end]])
                # Pieces of one item have its id.
                pairs = sorted({(d, index.first[i]) for d, i in index.found(codes, marks)})
                if pairs:
                    docs = batch.column(0).take(pa.array([at + d for d, _ in pairs]))
                    ids = pa.array([index.ids[i] for _, i in pairs], type=item_type)
                    yield pa.RecordBatch.from_arrays([docs, ids], ["doc_id", "item_id"])
                at = end

    return run
