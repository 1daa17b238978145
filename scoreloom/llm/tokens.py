"""Encoding of a corpus by a public byte-level BPE vocabulary.

Distinct words are inserted into a trie. Each node keeps the last token of the
encoding of its prefix; the encoding of any prefix is then the encoding of the
prefix without that token, plus the token, so prefixes that words share are
encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scoreloom.session import spread

#: The word pattern published with the vocabulary, with the white
#: space class written out so that every engine agrees on it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

#: Nodes and pieces kept by one worker before its trie or cache starts anew.
MAX_NODES = 1_000_000
MAX_PIECES = 250_000
#: Words of more bytes than this are encoded without entering the trie.
LONG_WORD = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: one base64 token and id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: join the adjacent pair of the lowest rank until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class PrefixTrie:
    """Trie over the bytes of words, with the last-token state of every prefix."""

    def __init__(self, ranks: dict[bytes, int], max_nodes: int = MAX_NODES):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.max_nodes = max_nodes
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.length: list[int] = [0]

    def _follows(self, left: int, left_bytes: bytes, right: int, right_bytes: bytes) -> bool:
        """Whether the two tokens stand side by side in an encoding."""
        key = (left, right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 4 * self.max_nodes:
                self.pairs.clear()
            ok = self.pairs[key] = merge(left_bytes + right_bytes, self.ranks) == [left, right]
        return ok

    def _last(self, word: bytes, end: int, tokens: list[int], lengths: list[int]) -> tuple[int, int]:
        """Last token of word[:end] and its length, from the states of the shorter prefixes."""
        ranks = self.ranks
        for start in range(max(0, end - self.longest), end):
            piece = word[start:end]
            t = ranks.get(piece)
            if t is None:
                continue
            if start == 0:
                if self._whole(t, piece):
                    return t, end
            else:
                p = tokens[start]
                if self._follows(p, word[start - lengths[start] : start], t, piece):
                    return t, end - start
        raise ValueError("the vocabulary lacks a byte")

    def _whole(self, token: int, piece: bytes) -> bool:
        key = (-1, token)
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs[key] = merge(piece, self.ranks) == [token]
        return ok

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word; new trie nodes are made depth first along the word."""
        n = len(word)
        if word in self.ranks and n > 1 and self._whole(self.ranks[word], word):
            return [self.ranks[word]]
        tokens, lengths = [-1] * (n + 1), [0] * (n + 1)
        if n > LONG_WORD:
            for end in range(1, n + 1):
                tokens[end], lengths[end] = self._last(word, end, tokens, lengths)
        else:
            if len(self.token) > self.max_nodes:
                self.clear()
            node, child, state, size = 0, self.child, self.token, self.length
            for end in range(1, n + 1):
                key = node << 8 | word[end - 1]
                nxt = child.get(key)
                if nxt is None:
                    t, k = self._last(word, end, tokens, lengths)
                    nxt = child[key] = len(state)
                    state.append(t)
                    size.append(k)
                tokens[end], lengths[end] = state[nxt], size[nxt]
                node = nxt
        out, end = [], n
        while end:
            out.append(tokens[end])
            end -= lengths[end]
        out.reverse()
        return out


class Encoder:
    """Texts to ids. Pieces between single blanks are looked up in a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], max_pieces: int = MAX_PIECES):
        import re

        import regex

        self.trie = PrefixTrie(ranks)
        self.words = regex.compile(PATTERN).findall
        self.runs = re.compile(rf"[{SPACE}] [{SPACE}]").search
        self.max_pieces = max_pieces
        self.word_ids: dict[str, bytes] = {}
        self.first, self.next = _Pieces(self, ""), _Pieces(self, " ")

    def _word(self, word: str) -> bytes:
        ids = self.word_ids.get(word)
        if ids is None:
            import numpy as np

            if len(self.word_ids) >= self.max_pieces:
                self.word_ids.clear()
            ids = np.array(self.trie.encode(word.encode("utf-8", "replace")), np.int32).tobytes()
            if len(word) <= LONG_WORD:
                self.word_ids[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of one text, as packed 32-bit integers.

        A blank before a word belongs to it, so a text may be cut before each
        single blank; only where blanks and other white space meet do the words
        depend on more than one piece, and such texts are split as a whole.
        """
        if "  " in text or self.runs(text):
            return b"".join(map(self._word, self.words(text)))
        parts = text.split(" ")
        head = self.first[parts[0]]
        return head + b"".join(map(self.next.__getitem__, parts[1:])) if len(parts) > 1 else head


class _Pieces(dict):
    """Cache of pieces' ids; a missing piece is split into words and encoded."""

    def __init__(self, encoder: Encoder, before: str):
        self.encoder, self.before = encoder, before

    def __missing__(self, piece: str) -> bytes:
        e = self.encoder
        if len(self) >= e.max_pieces:
            self.clear()
        ids = b"".join(map(e._word, e.words(self.before + piece)))
        if len(piece) <= LONG_WORD:
            self[piece] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a rank file; it lasts as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(read_ranks(path))
    return _ENCODERS[path]


def encode_corpus(df: DataFrame, id_col: str, text_col: str, ranks_path: str, out_id: str = "doc_id") -> DataFrame:
    """One row a document: its id and `ids`, the list of its token ids.

    There is no shuffle and no state beyond a worker's bounded caches: every
    partition streams through its own trie. Special tokens are never produced;
    text that looks like one is ordinary text. An empty or a null text has an
    empty list, a null id stays null, repeated rows come out each. Lone
    surrogates, which UTF-8 can't hold, count as '?'.
    """

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = encoder(ranks_path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = [encode(t) if t else b"" for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(packed) + 1, np.int64)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                values = np.frombuffer(b"".join(packed), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [out_id, "ids"])

    schema = T.StructType([T.StructField(out_id, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(df.select(f"`{id_col}`", f"`{text_col}`")).mapInArrow(run, schema)
