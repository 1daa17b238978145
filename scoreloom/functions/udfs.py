"""Arrow UDFs for scores that no built-in expresses. They get whole batches, never rows."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility forms folded, letters composed; null stays null."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one big number per word."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        match = at.get(w, 0)
        keep = row & match
        row = ((row + keep) | (row - keep)) & full
    return len(a) - row.bit_count()


def _words(text: str | None) -> list[str]:
    return [w for w in (text or "").split(" ") if w]


def _grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[k:] for k in range(n))))


def overlap(n: int = 1):
    """A function of two texts: shared, n_a and n_b, counts of their n-grams of words with repetition; linear in their length."""

    @F.pandas_udf("shared bigint, n_a bigint, n_b bigint")
    def counted(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            p, r = _grams(_words(x), n), _grams(_words(y), n)
            out.append((sum((p & r).values()), p.total(), r.total()))
        return pd.DataFrame(out, columns=["shared", "n_a", "n_b"], dtype="int64")

    return counted


@F.pandas_udf(T.DoubleType())
def cosine_counts(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the counts of two texts' words; 0 if one has none."""

    def one(x: str | None, y: str | None) -> float:
        p, r = Counter(_words(x)), Counter(_words(y))
        if not p or not r:
            return 0.0
        return sum(k * r[w] for w, k in p.items() if w in r) / (math.sqrt(sum(k * k for k in p.values())) * math.sqrt(sum(k * k for k in r.values())))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """F of the longest common subsequence of words; 0 if a text has none."""

    def one(c: str | None, r: str | None) -> float:
        a, b = _words(c), _words(r)
        n = lcs_length(a, b) if a and b else 0
        return 2 * n / (len(a) + len(b)) if n else 0.0

    return pd.Series([one(c, r) for c, r in zip(candidate, reference)], dtype="float64")


def sentence_bleu(candidate: list[str], reference: list[str], orders: int = 4, epsilon: float = 0.1, only: bool = False) -> float:
    """BLEU with equal weights; an order without a match counts epsilon matches. With `only`, of the last order alone."""
    if not candidate or not reference:
        return 0.0
    logs = 0.0
    for n in range(1, orders + 1):
        have, want = _grams(candidate, n), _grams(reference, n)
        shared = (have & want).total()
        if n == 1 and not shared:
            return 0.0
        p = (shared or epsilon) / max(1, have.total())
        logs = math.log(p) if only else logs + math.log(p) / orders
    brevity = 1.0 if len(candidate) > len(reference) else math.exp(1 - len(reference) / len(candidate))
    return brevity * math.exp(logs)


METRICS = (
    "precision", "recall", "f1", "rouge1_p", "rouge1_r", "rouge1_f", "rouge2_p", "rouge2_r", "rouge2_f", "rougel_p", "rougel_r", "rougel_f",
    "bleu", "bleu1", "bleu2", "bleu3", "bleu4", "meteor",
)


def text_metrics_of(candidate: str | None, reference: str | None) -> tuple[float, ...]:
    """All METRICS of one pair of cleaned texts; every one is 0 if a text has no words."""
    a, b = _words(candidate), _words(reference)
    if not a or not b:
        return (0.0,) * len(METRICS)

    def prf(shared: float, n: int, m: int) -> tuple[float, float, float]:
        p, r = shared / n if n else 0.0, shared / m if m else 0.0
        return p, r, 2 * p * r / (p + r) if p + r else 0.0

    one, two = (prf((x & y).total(), x.total(), y.total()) for x, y in ((_grams(a, n), _grams(b, n)) for n in (1, 2)))
    longest = prf(lcs_length(a, b), len(a), len(b))
    orders = [sentence_bleu(a, b, n, only=True) for n in (1, 2, 3, 4)]
    return (*one, *one, *two, *longest, sentence_bleu(a, b), *orders, meteor_exact(a, b))


@F.pandas_udf(T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS]))
def text_metrics(candidate: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """All METRICS of cleaned texts in one pass."""
    return pd.DataFrame([text_metrics_of(c, r) for c, r in zip(candidate, reference)], columns=METRICS, dtype="float64")


@F.pandas_udf(T.DoubleType())
def bleu(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([sentence_bleu(_words(c), _words(r)) for c, r in zip(candidate, reference)], dtype="float64")


def meteor_exact(candidate: list[str], reference: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR with exact matches only: weighted mean less a penalty for matches in pieces."""
    free: dict[str, list[int]] = {}
    for i, w in reversed(list(enumerate(reference))):
        free.setdefault(w, []).append(i)
    pairs = [(i, free[w].pop()) for i, w in enumerate(candidate) if free.get(w)]
    if not pairs:
        return 0.0
    pieces = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    p, r = len(pairs) / len(candidate), len(pairs) / len(reference)
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (pieces / len(pairs)) ** beta)


@F.pandas_udf(T.DoubleType())
def meteor(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([meteor_exact(_words(c), _words(r)) for c, r in zip(candidate, reference)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all, by longest matching blocks; 0 if a text is null."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)], dtype="float64")


def hashed_vector(tokens: list[str], size: int = 64) -> list[float]:
    """An offline stand-in for a text encoder: counts of letter trigrams of the tokens, signed and spread by their hash."""
    import zlib

    out = [0.0] * size
    for t in tokens:
        padded = f"^{t}$"
        for k in range(max(1, len(padded) - 2)):
            h = zlib.crc32(padded[k : k + 3].encode())
            out[h % size] += 1.0 if h >> 31 else -1.0
    return out


def text_cosine(encode=hashed_vector):
    """A function of two texts: the cosine of their vectors by an encoder of token lists; 0 if a text is empty."""

    @F.pandas_udf(T.DoubleType())
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np

        def one(x: str | None, y: str | None) -> float:
            p, r = _words(x), _words(y)
            if not p or not r:
                return 0.0
            u, v = np.asarray(encode(p)), np.asarray(encode(r))
            size = float(np.linalg.norm(u) * np.linalg.norm(v))
            return float(u @ v) / size if size else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return cosine


def token_similarity_of(candidate: list[str], reference: list[str], encode=hashed_vector) -> tuple[float, float, float]:
    """Precision, recall and F of the greatest cosine of each token's vector with one of the other text."""
    import numpy as np

    if not candidate or not reference:
        return 0.0, 0.0, 0.0

    def unit(tokens: list[str]):
        known: dict[str, list[float]] = {}
        m = np.asarray([known.setdefault(t, encode([t])) if t not in known else known[t] for t in tokens], float)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    # Different tokens only: a repeated one has the same greatest cosine.
    c, cn = np.unique(candidate, return_counts=True)
    r, rn = np.unique(reference, return_counts=True)
    close = unit(c.tolist()) @ unit(r.tolist()).T
    p, q = float(close.max(1) @ cn / cn.sum()), float(close.max(0) @ rn / rn.sum())
    return p, q, 2 * p * q / (p + q) if p + q else 0.0


def token_similarity(encode=hashed_vector):
    """A function of two texts: precision, recall and f by `token_similarity_of`, with any encoder of tokens."""

    @F.pandas_udf("precision double, recall double, f double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([token_similarity_of(_words(x), _words(y), encode) for x, y in zip(a, b)], columns=["precision", "recall", "f"], dtype="float64")

    return similarity
